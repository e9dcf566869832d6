"""Secret scan with DataFrame functions only: fixed patterns, and a randomness battery over encoded tokens.

Base kinds, leftmost and non-overlapping for each kind, judged after the match (a failing match still uses up its
text): `assign` (a key word, `:` or `=`, a value of six characters or more), `access` (`AKIA` and capitals or digits,
20 characters or more), `hex` (24 lower-case hex digits or more).

The method adds kind `random`. Candidate tokens are maximal runs of at least 20 encoding characters outside base spans.
The smallest alphabet that holds a token is taken as its encoding, and three tests judge it as a sample of that alphabet:
chi-squared for uniform symbols, runs (Wald-Wolfowitz about the middle of the alphabet, and of capitals, small letters,
digits and marks against what the alphabet's shares of them give), and lag-one serial correlation. They are combined by
Bonferroni: four times the least p, which is small for words, paths and rulers and uniform for
secrets. Benjamini-Hochberg over all documents says which tokens are refuted as random, at a false discovery rate `fdr`
(of refuted tokens, so many may be secrets after all) and within strata of token length, since the power of the tests
grows with it. What is not refuted is reported. Tokens of letters only count from 28 letters on, some 130 bits: in
shorter ones the tests tell words too badly from secrets. P-values are counted in bins of a tenth of a decade: the
histogram has at most 4 x 200 rows whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

# Patterns and alphabets.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABETS = (
    (r"^[0-9]+$", "0123456789"),
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    (r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    (r"^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (r"^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
STRATA = (28, 40, 64)
KINDS = ("assign", "access", "hex", "random")
LETTERS = 28
BINS = 200


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches as array<struct<start,end,hit>>, hit being the group; code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hits = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["w"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["h"].alias("hit"))
        return F.when(x["w"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    zipped = F.arrays_zip(pieces.alias("p"), whole.alias("w"), hits.alias("h"))
    found = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(empty)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value written into the plan once."""
    return F.transform(F.array(value), body)[0]


def upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), by the rational approximation of Abramowitz and Stegun 26.2.17 (error below 1e-7 for z < 5)."""

    def tail(q: Column) -> Column:
        # Coefficients of the approximation.
        poly = F.aggregate(F.array(*map(F.lit, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530))), F.lit(0.0), lambda acc, c: (acc + c) * q["t"])
        upper = F.exp(-q["x"] * q["x"] / 2) / math.sqrt(2 * math.pi) * poly
        return F.when(q["z"] >= 0, upper).otherwise(1 - upper)

    return _let(z, lambda x: _let(F.struct(x.alias("z"), F.abs(x).alias("x"), (1 / (1 + 0.2316419 * F.abs(x))).alias("t")), tail))


def _class_of(sign: str) -> str:
    return "A" if sign.isupper() else "a" if sign.islower() else "0" if sign.isdigit() else "+"


def _class_changes(alphabet: str) -> tuple[float, float]:
    """How likely neighbours of a sample differ in class, and the covariance of one such event with the next."""
    shares = [sum(_class_of(x) == c for x in alphabet) / len(alphabet) for c in "Aa0+"]
    change = 1 - sum(p * p for p in shares)
    return change, sum(p * (1 - p) ** 2 for p in shares) - change**2


def randomness(token: Column) -> Column:
    """struct<encoding, n, p_uniform, p_runs, p_classes, p_serial, p_random>; null where no alphabet holds the token or it is too short."""
    body = F.rtrim(token, F.lit("="))

    def known(a: str) -> Column:
        change, along = _class_changes(a)
        return F.struct(F.lit(a).alias("signs"), F.lit(change).alias("change"), F.lit(along).alias("along"))

    alphabet = F.coalesce(*(F.when(F.regexp_like(body, F.lit(r)), known(a)) for r, a in ALPHABETS))
    signs = "".join(dict.fromkeys("".join(a for _, a in ALPHABETS)))

    def battery(x: Column) -> Column:
        b, codes, n, k = x["body"], x["codes"], x["n"], x["k"]
        zero, v = F.lit(0.0), 2 / (9 * (k - 1))
        pairs = F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("x"), F.slice(codes, 2, F.size(codes) - 1).alias("y"))

        def p_values(m: Column) -> Column:
            p_uniform = upper_tail((F.cbrt(F.greatest(k / n * m["squares"] - n, zero) / (k - 1)) - (1 - v)) / F.sqrt(v))
            p_runs = F.when((m["mean"] > 2) & (n > 2), 2 * upper_tail(F.abs(m["runs"] - m["mean"]) / F.sqrt((m["mean"] - 1) * (m["mean"] - 2) / (n - 1)))).otherwise(0.0)
            p_serial = F.when(m["power"] > 0, 2 * upper_tail(F.abs(m["product"] / m["power"] + 1 / n) * F.sqrt(n))).otherwise(0.0)
            spread = (n - 1) * x["change"] * (1 - x["change"]) + 2 * (n - 2) * x["along"]
            p_classes = F.when(spread > 0, 2 * upper_tail(F.abs(m["changes"] - (n - 1) * x["change"]) / F.sqrt(spread))).otherwise(1.0)
            return F.struct(k.cast("int").alias("encoding"), F.size(codes).alias("n"), p_uniform.alias("p_uniform"), p_runs.alias("p_runs"), p_classes.alias("p_classes"), p_serial.alias("p_serial"))

        high, centre = x["high"], x["centre"]
        classes = F.split(F.translate(x["body"], signs, "".join(map(_class_of, signs))), "")
        changes = _let(classes, lambda c: F.size(F.filter(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(c, i) != F.get(c, i - 1))).cast("double"))
        measured = F.struct(
            F.aggregate(F.array_distinct(codes), zero, lambda acc, c: acc + F.pow(F.size(F.filter(codes, lambda d: d == c)).cast("double"), F.lit(2.0))).alias("squares"),
            (2 * high * (n - high) / n + 1).alias("mean"),
            (1 + F.aggregate(pairs, zero, lambda acc, q: acc + F.when((q["x"] >= k / 2) != (q["y"] >= k / 2), 1.0).otherwise(0.0))).alias("runs"),
            F.aggregate(codes, zero, lambda acc, c: acc + (c - centre) * (c - centre)).alias("power"),
            F.aggregate(pairs, zero, lambda acc, q: acc + (q["x"] - centre) * (q["y"] - centre)).alias("product"),
            changes.alias("changes"),
        )
        found = _let(measured, p_values)
        return _let(found, lambda t: F.struct(t["encoding"], t["n"], t["p_uniform"], t["p_runs"], t["p_classes"], t["p_serial"], F.least(4 * F.least(t["p_uniform"], t["p_runs"], t["p_classes"], t["p_serial"]), F.lit(1.0)).alias("p_random")))

    def sample(x: Column) -> Column:
        codes = F.transform(F.split(x["body"], ""), lambda s: F.instr(x["alphabet"]["signs"], s).cast("double") - 1)
        k = F.length(x["alphabet"]["signs"]).cast("double")
        zero = F.lit(0.0)

        def moments(y: Column) -> Column:
            n = F.size(y["codes"]).cast("double")
            high = F.aggregate(y["codes"], zero, lambda acc, c: acc + F.when(c >= y["k"] / 2, 1.0).otherwise(0.0))
            return F.struct(y["body"], y["codes"], n.alias("n"), y["k"], y["change"], y["along"], high.alias("high"), (F.aggregate(y["codes"], zero, lambda acc, c: acc + c) / n).alias("centre"))

        return _let(_let(F.struct(x["body"], codes.alias("codes"), k.alias("k"), x["alphabet"]["change"], x["alphabet"]["along"]), moments), battery)

    named = F.struct(body.alias("body"), alphabet.alias("alphabet"))
    least = F.when(F.regexp_like(body, F.lit("[0-9]")), 20).otherwise(LETTERS)
    return _let(named, lambda x: F.when(x["alphabet"].isNotNull() & (F.length(x["body"]) >= least), sample(x)))


def _stratum(n: Column) -> Column:
    return sum((F.when(n >= s, 1).otherwise(0) for s in STRATA), F.lit(0))


def _bin(p: Column) -> Column:
    return F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-30)))), F.lit(BINS - 1)).cast("int")


def _tokens(text: Column) -> Column:
    """Spans of candidate tokens with their tests."""
    tested = F.transform(_spans(text, TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), randomness(s["hit"]).alias("t")))
    return F.filter(tested, lambda s: s["t"].isNotNull())


def refuted_bins(docs: DataFrame, text: str = "text", fdr: float = 0.05) -> list[int]:
    """For each stratum of length, the lowest bin of p that Benjamini-Hochberg refutes over all tokens (BINS: none)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tokens = docs.where(F.regexp_like(body, F.lit(TOKEN))).select(F.explode(_tokens(body)["t"]).alias("t"))
    rows = tokens.groupBy(_stratum(F.col("t.n")).alias("s"), _bin(F.col("t.p_random")).alias("b")).count().collect()  # at most 4 x BINS rows
    out = []
    for s in range(len(STRATA) + 1):
        counts = {r["b"]: r["count"] for r in rows if r["s"] == s}
        total, seen, best = sum(counts.values()), 0, BINS
        for b in sorted(counts, reverse=True):
            seen += counts[b]
            if 10 ** (-b / 10) * total <= fdr * seen:
                best = b
        out.append(best)
    return out


def find_secrets(docs: DataFrame, text: str = "text", fdr: float = 0.05) -> DataFrame:
    """docs with the column `secret_spans`: array<struct<start,kind_no,end>> by start, then kind as in KINDS.

    A null text counts as empty and has no spans; texts of any length are scanned whole; repeated rows are each scanned;
    an empty table stays empty. A column of docs named secret_spans is replaced.
    """
    lowest = F.array(*map(F.lit, refuted_bins(docs, text, fdr)))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def of(kind: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind_no"), s["end"].alias("end")))

    assign = F.filter(_spans(body, ASSIGN, 2), lambda s: F.length(s["hit"]) >= 6)
    access = F.filter(_spans(body, ACCESS), lambda s: F.length(s["hit"]) >= 20)
    base = F.concat(of(0, assign), of(1, access), of(2, _spans(body, HEX)))

    def random(spans: Column) -> Column:
        def kept(s: Column) -> Column:
            outside = ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
            return (_bin(s["t"]["p_random"]) < F.element_at(lowest, _stratum(s["t"]["n"]) + 1)) & outside

        return F.concat(spans, of(3, F.filter(_tokens(body), kept)))

    return docs.withColumn("secret_spans", F.array_sort(_let(base, random)))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options: float) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans): a row for each row of docs."""
    found = find_secrets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", **options).select("doc_id", "secret_spans")
    spans = F.col("secret_spans")

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind_no"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    base = F.filter(spans, lambda s: s["kind_no"] < 3)
    return found.select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(spans).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **options: float) -> DataFrame:
    """docs with each span of secrets, overlapping ones taken together, replaced by mark; null texts stay null."""
    column = unused(docs, "spans")[0]
    found = find_secrets(docs.withColumnRenamed("secret_spans", column), text, **options)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        new = F.concat(acc["out"], F.array(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, new).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))

    clean = F.aggregate("secret_spans", start, step, finish)
    return found.withColumn(text, F.when(F.size("secret_spans") > 0, clean).otherwise(F.col(text))).drop("secret_spans").withColumnRenamed(column, "secret_spans")
