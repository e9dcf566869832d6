"""Language ID by mixture inference: EM over n-gram likelihoods, languages chosen by penalised likelihood.

Texts are lower-cased; everything but letters becomes one space. Letter n-grams of one to three signs are hashed into
a fixed number of features. A language is a smoothed distribution over the features, counted over a bounded sample of
labelled documents. A document is a mixture of languages: starting from the likeliest single language, the language by
which the likelihood rises steepest is added and expectation-maximisation re-estimates all proportions; the set stops
growing when the gain in log-likelihood is below the penalty (half of log of the number of n-grams for each further
language, times `caution`, since overlapping n-grams repeat their evidence). The prediction is the language with the
largest proportion, which is its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, unused

FEATURES, ORDERS = 1 << 15, 3
#: Labelled documents that the model is fitted on at most, about (a hash of doc_id chooses them).
SAMPLE = 20_000
UNKNOWN = "und"
#: Characters taken at a time, to bound memory on very long texts.
BLOCK = 1 << 20


@dataclass
class Model:
    """Languages and their feature probabilities (features x languages)."""

    languages: list[str]
    chances: np.ndarray


def _features(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in a text."""
    counts = np.zeros(FEATURES, np.int64)
    before = np.zeros(0, np.uint64)
    for at in range(0, len(text), BLOCK):
        signs = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        kinds, back = np.unique(signs, return_inverse=True)
        signs = np.where(np.array([chr(c).isalpha() for c in kinds.tolist()])[back], signs, np.uint64(0))
        signs = np.concatenate([before, signs]) if at else np.concatenate([[np.uint64(0)], signs])
        new = np.ones(len(signs), bool)
        new[1:] = (signs[1:] != 0) | (signs[:-1] != 0)
        signs = signs[new]
        key = signs
        for order in range(1, ORDERS + 1):
            if order > 1:
                key = key[:-1] * np.uint64(0x1F123BB5) + signs[order - 1 :]
            letters = signs[order - 1 :] if order == 1 else signs[order - 2 : len(signs) - 1] + signs[order - 1 :]
            old = max(0, len(before) - order + 1) if at else 0
            hashed = (key + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 15)
            counts += np.bincount(hashed[old:][letters[old:] != 0].astype(np.int64), minlength=FEATURES)
        before = signs[-(ORDERS - 1) :]
    return counts


def _has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _em(chances: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Proportions of the languages and the log-likelihood."""
    share, total = start, counts.sum()
    for _ in range(rounds):
        weight = counts / (chances @ share)
        new = share * (weight @ chances) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-4:
            break
    return share, float(counts @ np.log(chances @ share))


def infer(model: Model, text: str | None, caution: float = 3.0) -> dict[str, float]:
    """Proportions of the languages chosen for one text, the largest first; nothing for texts without letters."""
    if not model.languages or not _has_letters(text):
        return {}
    counts = _features(text)
    at = np.nonzero(counts)[0]
    if not len(at):
        return {}
    counts, chances = counts[at].astype(float), model.chances[at]
    total = counts.sum()
    single = counts @ np.log(chances)
    chosen = [int(single.argmax())]
    share, best = np.ones(1), float(single.max())
    while len(chosen) < len(model.languages):
        slope = (counts / (chances[:, chosen] @ share)) @ chances / total
        slope[chosen] = 0
        new = int(slope.argmax())
        if slope[new] <= 1.001:
            break
        more, likely = _em(chances[:, [*chosen, new]], counts, np.append(share * 0.9, 0.1))
        if likely - best <= caution * 0.5 * np.log(total + 1):
            break
        chosen, share, best = [*chosen, new], more, likely
    order = np.argsort(-share, kind="stable")
    return {model.languages[chosen[i]]: float(min(1.0, share[i])) for i in order}


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, train: Column | None = None) -> Model:
    """Count features by language over rows with train true (all if None), a language, and a place in the sample."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if train is not None:
        rows = rows.where(train)
    labelled = rows.count()
    if labelled > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(labelled)) < sample)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for language, t in zip(frame["lang"], frame["text"], strict=True):
                if language not in sums:
                    sums[language] = np.zeros(FEATURES, np.int64)
                sums[language] += _features(t)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "counts": [x.tobytes() for x in sums.values()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in frame["counts"])
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "counts": [total.tobytes()]})

    schema = "lang string, counts binary"
    partial = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).mapInPandas(count, schema)
    found = sorted(partial.groupBy("lang").applyInPandas(add, schema).collect())  # a row of fixed size for each language
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in found], float).reshape(-1, FEATURES) + 0.1
    return Model([r.lang for r in found], (counts / counts.sum(axis=1, keepdims=True)).T.copy())


def predicted(docs: DataFrame, model: Model, text: str = "text", caution: float = 3.0) -> Column:
    """A column struct<lang_pred, score> over docs."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.chances))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = Model(*sent.value)
        best = [next(iter(infer(own, t, caution).items()), (UNKNOWN, 0.0)) for t in texts]
        return pd.DataFrame(best, columns=["lang_pred", "score"])

    return predict(F.col(text).cast("string"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that the model may not learn from: remainder 1 of crc32 of doc_id modulo 3."""
    return crc_fold(F.col(doc_id)) == 1


def language_report(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Only text and non-null lang of rows that are not held out are learnt from. `und` with score 0 is given for null
    texts, texts without letters, and all texts if there is nothing to learn from. Ties go to the language that sorts
    first. Repeated rows keep a row each (and count each when learnt from); only the named columns are read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    model = fit(own, train=~held_out())
    rows = own.select("doc_id", held_out().alias("held_out"), predicted(own, model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def known_language(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows in which no language is found; all columns stay as they are, whatever their names.

    Rows with a null text or without letters go, as do all rows if there is nothing to learn from; repeated rows are each
    judged, and an empty table stays empty.
    """
    model = fit(docs, text, lang, doc_id, train=~held_out(doc_id))
    name = unused(docs, "language")[0]
    return docs.withColumn(name, predicted(docs, model, text)["lang_pred"]).where(F.col(name) != UNKNOWN).drop(name)
