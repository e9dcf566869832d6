"""Registered queries of the stream engine over frames made from the event table, and the SQL that checks them.

The SQL shares fragments: FRAMES (the frames of modulus 16), POW (affine powers of the reseeding generator) and the
like. They restate the operators for DuckDB, which has HUGEINT where the operators use limbs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import generators as G
from ..functions.fixedpoint import big, clamp24
from ..operators import control, decode, encode, generated, kernels, messages, render, samples, signalling
from ..sources.synthetic import OPENING_BITS, event_frames, plant_bits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def frames_sql(files: int = 16) -> str:
    return f"""frames AS (SELECT user_id % {files} AS file_id, row_number() OVER (PARTITION BY user_id % {files} ORDER BY event_id) - 1 AS frame,
((event_id*1664525 + user_id*1013904223 + 12345) & 16777215) - 8388608 AS l,
((event_id*22695477 + user_id*69069 + 1) & 16777215) - 8388608 AS r FROM events)"""


def powers_sql(count: int) -> str:
    return f"""RECURSIVE pow(n, a, c) AS (SELECT 0::BIGINT, 1::BIGINT, 0::BIGINT UNION ALL
SELECT n + 1, (a::HUGEINT * 1664525 % 4294967296)::BIGINT, ((c::HUGEINT * 1664525 + 1013904223) % 4294967296)::BIGINT FROM pow WHERE n < {count})"""


def walk_sql(start: int, poly: int, count: str) -> str:
    """A register stepped a byte of zeros at a time, that is eight bit steps."""
    return f"""bitwalk(i, s) AS (SELECT 0::BIGINT, {start}::BIGINT UNION ALL SELECT i + 1, xor(s >> 1, (s & 1) * {poly}) FROM bitwalk WHERE i < 8 * ({count})),
walk AS (SELECT i // 8 AS n, s FROM bitwalk WHERE i % 8 = 0)"""


FRAMES = frames_sql()
FRAMES4 = frames_sql(4)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modulus-4 frames with the opening packet at bit 8 + file_id from frame 10 + 3 * file_id on; file 3 has none."""
    frames = event_frames(spark, sf_dir, 4)
    parts = [plant_bits(frames.where(F.col("file_id") == f), OPENING_BITS, F.lit(10 + 3 * f), 8 + f) for f in range(3)]
    return parts[0].union(parts[1]).union(parts[2]).union(frames.where("file_id = 3"))


PLANTED = f"""{FRAMES4}, planted AS (SELECT file_id, frame, CASE WHEN file_id < 3 AND frame BETWEEN 10 + 3 * file_id AND 10 + 3 * file_id + 146
AND (xor(l, r) >> (8 + file_id)) & 1 <> substr('{OPENING_BITS}', (frame - 10 - 3 * file_id + 1)::INT, 1)::BIGINT THEN xor(l, 1::BIGINT << (8 + file_id)::INT) ELSE l END AS l, r FROM frames)"""

MAGIC_LIST = "[" + ", ".join(str(control.MAGIC >> i & 1) for i in range(40)) + "]"
FOUND = f"""{PLANTED}, ks AS (SELECT unnest(range(8, 16)) AS k), bits AS (SELECT file_id, frame, k, (xor(l, r) >> k) & 1 AS bit FROM planted, ks),
regs AS (SELECT file_id, frame, k, list(bit) OVER (PARTITION BY file_id, k ORDER BY frame ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS w FROM bits),
hits AS (SELECT file_id, frame - 39 AS sync_frame, k, row_number() OVER (PARTITION BY file_id ORDER BY frame, k) AS rn FROM regs WHERE w = {MAGIC_LIST}::BIGINT[]),
streams AS (SELECT file_id, sync_frame, k FROM hits WHERE rn = 1),
sbits AS (SELECT b.file_id, b.frame - s.sync_frame AS pos, b.bit FROM bits b JOIN streams s ON b.file_id = s.file_id AND b.k = s.k WHERE b.frame >= s.sync_frame)"""


def _field(at: int, n: int) -> str:
    return f"sum(CASE WHEN pos BETWEEN {at} AND {at + n - 1} THEN bit * (1::BIGINT << (pos - {at})::INT) ELSE 0 END)::BIGINT"


HEADS = f"""{FOUND}, heads AS (SELECT file_id, {_field(42, 5)} AS orig_rate, {_field(47, 5)} AS src_rate, {_field(52, 5)} AS render_filter, {_field(69, 4)} AS auth_level FROM sbits GROUP BY file_id HAVING max(pos) >= 79)"""
SCANNED = f"""{HEADS}, scanned AS (SELECT f.file_id, h.orig_rate IS NOT NULL AS found, s.sync_frame, s.k, h.orig_rate, h.src_rate, h.auth_level, h.auth_level >= 9 AS studio
FROM (SELECT DISTINCT file_id FROM planted) f LEFT JOIN streams s USING (file_id) LEFT JOIN heads h USING (file_id))"""


# --- finding and describing streams -------------------------------------------------------------------------------


@query(f"WITH {SCANNED} SELECT * FROM scanned")
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files hold a stream, where, and what its opening packet says."""
    return control.scan(planted(spark, sf_dir), None)


@query(
    f"""WITH {SCANNED}, entries AS (SELECT 'files' AS kind, NULL::BIGINT AS value FROM scanned UNION ALL SELECT 'streams', NULL FROM scanned WHERE found
UNION ALL SELECT 'studio', NULL FROM scanned WHERE studio UNION ALL SELECT 'orig_rate', orig_rate FROM scanned WHERE found
UNION ALL SELECT 'auth_level', auth_level FROM scanned WHERE found UNION ALL SELECT 'channel_bit', k FROM scanned WHERE found)
SELECT kind, value, count(*) AS n FROM entries GROUP BY kind, value"""
)
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.stats(control.scan(planted(spark, sf_dir), None))


@query(f"WITH {FOUND} SELECT * FROM streams")
def magic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.find_streams(planted(spark, sf_dir))


@query(
    f"""WITH {HEADS} SELECT file_id, CASE WHEN orig_rate = 10 THEN '192 kHz' ELSE '?' END AS original, CASE WHEN src_rate = 8 THEN '48 kHz' ELSE '?' END AS carrier,
[20, 18, 16, 15][{_field(59, 2)} + 1]::BIGINT AS depth, 'studio' AS level FROM sbits JOIN heads USING (file_id) GROUP BY file_id, orig_rate, src_rate"""
)
def stream_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = planted(spark, sf_dir)
    heads = control.opening_fields(frames, control.find_streams(frames))
    depth = F.element_at(F.array(*map(F.lit, control.RENDER_DEPTHS)), (F.col("render_bitdepth") + 1).cast("int")).cast("bigint")
    return heads.select("file_id", control.rate_name(F.col("orig_rate")).alias("original"), control.rate_name(F.col("src_rate")).alias("carrier"), depth.alias("depth"), F.when(F.col("auth_level") >= control.STUDIO, "studio").otherwise("green").alias("level"))


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    frames = planted(spark, sf_dir)
    streams = control.find_streams(frames)
    return frames, streams, control.packets(control.channel_bits(frames, streams))


@query()
def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _parsed(spark, sf_dir)[2]
    return found.select("file_id", "session", "offset", "type", control.type_name(F.col("type")).alias("type_name"), "bits", "checksum", "datasync", "items")


@query(f"WITH {HEADS} SELECT file_id, 5::INT AS type, 1::BIGINT AS n FROM heads JOIN (SELECT file_id, max(pos) AS m FROM sbits GROUP BY file_id) USING (file_id) WHERE m >= 146")
def packet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.packet_counts(_parsed(spark, sf_dir)[2])


@query()
def stream_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, streams, found = _parsed(spark, sf_dir)
    return control.info(found, streams)


@query(
    f"""WITH {HEADS}, n AS (SELECT file_id, count(*) AS frames FROM planted GROUP BY file_id), m AS (SELECT file_id, max(pos) AS m FROM sbits GROUP BY file_id)
SELECT file_id, 147::DOUBLE * 48000 / frames AS bits_per_second FROM heads JOIN n USING (file_id) JOIN m USING (file_id) WHERE m >= 146"""
)
def data_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _, found = _parsed(spark, sf_dir)
    return control.data_rate(found, frames)


FRAGMENTS = """frag AS (SELECT user_id % 8 AS file_id, event_id AS "offset", user_id % 3 AS metadata_type, event_id % 5 AS fragment_number, (event_id % 5 = 4)::INT AS is_last, hex(event_type) AS h FROM events)"""


@query(
    f"""WITH {FRAGMENTS}, b AS (SELECT *, sum((fragment_number = 0)::INT) OVER (PARTITION BY file_id ORDER BY "offset") AS blob FROM frag),
g AS (SELECT file_id, blob, string_agg(h, '' ORDER BY "offset") AS h, max(is_last) > 0 AS complete, arg_min(metadata_type, "offset") FILTER (fragment_number = 0) AS metadata_type FROM b GROUP BY file_id, blob),
k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY blob DESC) AS rn FROM g)
SELECT file_id, metadata_type, (length(h) // 2)::BIGINT AS size, complete, h AS data_hex FROM k WHERE rn = 1"""
)
def metadata_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = F.col("event_id") % 5
    rows = events.select((F.col("user_id") % 8).alias("file_id"), F.col("event_id").alias("offset"), (F.col("user_id") % 3).alias("metadata_type"), number.alias("fragment_number"), (number == 4).cast("int").alias("is_last"), F.col("event_type").cast("binary").alias("data"))
    return control.metadata(rows).select("file_id", "metadata_type", "size", "complete", F.hex("data").alias("data_hex"))


UPDATES = f"""{FRAMES}, ev AS (SELECT file_id, frame, CASE WHEN frame % 2 = 0 THEN l & 63 END AS scale, CASE WHEN frame % 3 = 0 THEN r & 127 END AS level FROM frames WHERE l % 97 = 0 OR r % 89 = 0)"""


@query(
    f"""WITH {UPDATES}, g AS (SELECT file_id, frame // 32 AS "group", frame + 480 AS at FROM frames WHERE frame % 32 = 0)
SELECT g.file_id, g."group", (SELECT arg_max(scale, frame) FROM ev WHERE ev.file_id = g.file_id AND ev.frame <= g.at AND scale IS NOT NULL) AS scale,
(SELECT arg_max(level, frame) FROM ev WHERE ev.file_id = g.file_id AND ev.frame <= g.at AND level IS NOT NULL) AS level FROM g"""
)
def params_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_frames(spark, sf_dir)
    events = frames.where("l % 97 = 0 or r % 89 = 0").select("file_id", "frame", F.when(F.col("frame") % 2 == 0, F.col("l").bitwiseAND(big(63))).alias("scale"), F.when(F.col("frame") % 3 == 0, F.col("r").bitwiseAND(big(127))).alias("level"))
    return control.in_force(events, frames, ["scale", "level"])


@query(
    f"""WITH {FRAMES}, bits AS (SELECT file_id, frame AS pos, (xor(l, r) >> 8) & 1 AS bit FROM frames), sp AS (SELECT file_id, frame AS "offset", frame + 16 AS b, frame + 16 + (l & 255) AS e FROM frames WHERE frame % 300 = 7)
SELECT sp.file_id, sp."offset", sum(bit)::BIGINT AS ones, count(*) AS n, max(pos - b) AS last FROM sp JOIN bits ON bits.file_id = sp.file_id AND pos >= b AND pos < e GROUP BY sp.file_id, sp."offset" """
)
def payload_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_frames(spark, sf_dir)
    bits = frames.select("file_id", F.col("frame").alias("pos"), samples.control_bit(8).alias("bit"))
    spans = frames.where("frame % 300 = 7").select("file_id", big(0).alias("base"), F.col("frame").alias("offset"), F.lit(1).alias("type"), F.col("l").bitwiseAND(big(255)).alias("size"))
    return control.payload_bits(bits, spans).groupBy("file_id", "offset").agg(F.sum("bit").alias("ones"), F.count(F.lit(1)).alias("n"), F.max("n").alias("last"))


# --- single frames --------------------------------------------------------------------------------------------------


@query(f"WITH {FRAMES} SELECT file_id, " + ", ".join(f"sum((xor(l, r) >> {k}) & 1)::BIGINT AS ones_{k}" for k in range(8, 16)) + ", count(*) AS n FROM frames GROUP BY file_id")
def control_bit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_frames(spark, sf_dir)
    return frames.groupBy("file_id").agg(*[F.sum(samples.control_bit(k)).alias(f"ones_{k}") for k in control.BITS], F.count(F.lit(1)).alias("n"))


@query(f"WITH {FRAMES} SELECT file_id, frame, l & 255 AS l_byte, r & 255 AS r_byte, l & -256 AS l_cleared, r & -256 AS r_cleared FROM frames")
def low_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.low_bytes(event_frames(spark, sf_dir)).drop("l", "r")


def _digit_sql(c: str, cls: int) -> str:
    v = f"((({c} >> 8) + {samples.DIGIT_BIAS}) & 4294967295)"
    return f"((({v}::HUGEINT * {samples.CLASS_RECIPROCALS[cls]}) % 4294967296 * {samples.CLASS_LEVELS[cls]}) // 4294967296)::BIGINT"


def _add_digits(cls: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return samples.digits(event_frames(spark, sf_dir), cls).groupBy("file_id", "digit").agg(F.count(F.lit(1)).alias("n"))

    run.__name__ = f"carrier_digits_class{cls}"
    query(f"WITH {FRAMES}, d AS (SELECT file_id, {_digit_sql('l', cls)} AS digit FROM frames UNION ALL SELECT file_id, {_digit_sql('r', cls)} FROM frames) SELECT file_id, digit, count(*) AS n FROM d GROUP BY file_id, digit")(run)


for _cls in (1, 2, 3):
    _add_digits(_cls)


@query(
    f"""WITH {FRAMES}, d AS (SELECT file_id, frame * 2 AS n, {_digit_sql('l', 1)} AS digit FROM frames UNION ALL SELECT file_id, frame * 2 + 1, {_digit_sql('r', 1)} FROM frames),
b AS (SELECT file_id, n // 5 AS bn, sum(digit * 3 ** (4 - n % 5))::BIGINT AS byte, count(*) AS have FROM d GROUP BY file_id, bn) SELECT file_id, bn AS n, byte & 255 AS byte FROM b WHERE have = 5"""
)
def digit_bytes_class1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.digit_bytes(samples.digits(event_frames(spark, sf_dir), 1), 1)


WRAP = "(((({x}) + 2147483648) & 4294967295) - 2147483648)"
_GAIN, _SHIFT = samples.gain_of_scale(203)


@query(
    f"""WITH {FRAMES} SELECT file_id, frame, ((l + 128 - (r & 255)) & -256) + (r & 255) AS dithered, least(greatest(l + r, -8388608), 8388607) AS clamped,
{WRAP.format(x=f'((l * {_GAIN}) >> {32 + _SHIFT}) * 203')} AS stepped, (({WRAP.format(x='l * 16')}) * 1518500250) >> 32 AS refined FROM frames"""
)
def fixed_point_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_frames(spark, sf_dir)
    return frames.select(
        "file_id",
        "frame",
        samples.dither_round(F.col("l"), F.col("r").bitwiseAND(big(255))).alias("dithered"),
        clamp24(F.col("l") + F.col("r")).alias("clamped"),
        samples.gain_step(F.col("l"), _GAIN, _SHIFT, 203).alias("stepped"),
        samples.refine_scaled(F.col("l"), 1518500250).alias("refined"),
    )


def _fold_sql(o: str, i: str, full: int) -> str:
    over = f"xor(({i} & -512) * 2 - ({o} & -512), ({o} >> 31) & -512) - {full}"
    return f"(CASE WHEN {over} > 0 THEN {o} + xor({over}, ({o} >> 31) & -512) ELSE {o} END) & -513"


@query(f"WITH {FRAMES} SELECT file_id, frame, {_fold_sql('l', 'r', 8388608)} AS folded FROM frames")
def full_scale_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_frames(spark, sf_dir)
    return frames.select("file_id", "frame", samples.fold(F.col("l"), F.col("r"), 8388608)[0].alias("folded"))


def _place_sql(s: str, step: int, wanted: str) -> str:
    inside = f"(({s} & -{step}) + {wanted})"
    below = f"(CASE WHEN {inside} > {s} THEN {inside} - {step} ELSE {inside} END)"
    return f"(CASE WHEN {below} + {step} > 8388607 THEN {below} WHEN {below} < -8388607 THEN {below} + {step} WHEN {s} - {below} <= {below} + {step} - {s} THEN {below} ELSE {below} + {step} END)"


@query(
    f"""WITH {FRAMES}, a AS (SELECT file_id, frame, l, {_place_sql('r', 256, '((frame * 7) & 255)')} AS r FROM frames),
p AS (SELECT file_id, frame, {_place_sql('l', 1024, '((xor(frame % 2, (r >> 9) & 1) & 1) * 512 + ((frame * 5) & 255))')} AS l, r FROM a)
SELECT file_id, frame, l, r, (xor(l, r) >> 9) & 1 AS bit, l & 255 AS l_byte, r & 255 AS r_byte FROM p"""
)
def place_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_frames(spark, sf_dir)
    placed = samples.place_frame(frames, 9, F.col("frame") % 2, F.col("frame") * 5, F.col("frame") * 7)
    return placed.select("file_id", "frame", "l", "r", samples.control_bit(9).alias("bit"), F.col("l").bitwiseAND(big(255)).alias("l_byte"), F.col("r").bitwiseAND(big(255)).alias("r_byte"))


@query(f"WITH {FRAMES} SELECT file_id, max(greatest(abs(l), abs(r))) AS peak, 0::BIGINT AS \"index\" FROM frames GROUP BY file_id HAVING max(greatest(abs(l), abs(r))) <= 8388607 * 0.999 UNION ALL SELECT file_id, max(greatest(abs(l), abs(r))), 1 FROM frames GROUP BY file_id HAVING max(greatest(abs(l), abs(r))) > 8388607 * 0.999")
def headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.headroom(event_frames(spark, sf_dir))


@query(f"WITH {FRAMES}, b AS (SELECT file_id, frame >> 8 AS block, count(*) AS n_frames FROM frames GROUP BY file_id, frame >> 8) SELECT file_id, block, n_frames, n_frames = 256 AS complete, CASE WHEN n_frames = 256 THEN 1280 ELSE 0 END::BIGINT AS until_end, CASE WHEN CASE WHEN n_frames = 256 THEN 1280 ELSE 0 END < 300 THEN 0 WHEN file_id * 16 > 143 THEN 3 WHEN file_id * 16 <= 15 THEN 5 ELSE 2 END::BIGINT AS indicator FROM b")
def auth_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = samples.auth_blocks(event_frames(spark, sf_dir), 256, 1280)
    return found.withColumn("indicator", samples.indicator(F.col("file_id") * 16, F.col("until_end"), big(300)))


def _add_policy(policy: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return samples.run_in(event_frames(spark, sf_dir), policy)

    run.__name__ = f"passthrough_{policy}"
    query(sql)(run)


_add_policy("hold", f"WITH {FRAMES} SELECT file_id, frame * 2 + c AS out_frame, l, r FROM frames, (SELECT unnest([0, 1]) AS c)")
_add_policy("drop", f"WITH {FRAMES} SELECT file_id, frame AS out_frame, l, r FROM frames WHERE false")
_add_policy("raw", f"WITH {FRAMES} SELECT file_id, frame AS out_frame, l, r FROM frames")


@query("SELECT DISTINCT o_orderkey % 40 AS code, CASE (o_orderkey % 40) >> 3 WHEN 0 THEN 44100 WHEN 1 THEN 48000 WHEN 2 THEN 64000 ELSE 0 END * (1::BIGINT << ((o_orderkey % 40) & 7)::INT) AS hz FROM orders WHERE o_orderkey % 40 < 32")
def rate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    code = (F.col("o_orderkey") % 40).alias("code")
    return orders.select(code).distinct().where("code < 32").select("code", G.rate_hz(F.col("code")).alias("hz"))


# --- positions, checks and filters ----------------------------------------------------------------------------------


@query(f"WITH {powers_sql(1024)}, {FRAMES} SELECT file_id, frame, (((l & 4294967295)::HUGEINT * a + c) % 4294967296)::BIGINT AS state FROM frames JOIN pow ON n = frame % 512 * 2")
def generator_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.stepped(event_frames(spark, sf_dir), F.col("l"), F.col("frame") % 512, 512).select("file_id", "frame", "state")


def _seed_sql(salt: int, block: str) -> str:
    return f"((({salt} + {block})::HUGEINT * ({salt} + {block})) % 4294967296)"


@query(
    f"""WITH {powers_sql(4096)}, {FRAMES}, d AS (SELECT file_id, frame * 2 AS o, l & 255 AS x FROM frames UNION ALL SELECT file_id, frame * 2 + 1, r & 255 FROM frames)
SELECT file_id, o AS "offset", xor(x, ((({_seed_sql(G.DESCRAMBLER_SALT, '(o // 4096)')} * a + c) % 4294967296)::BIGINT >> 24)) AS byte FROM d JOIN pow ON pow.n = o % 4096 + 1"""
)
def descramble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.descramble(generated.channel_bytes(event_frames(spark, sf_dir)))


def _draw_sql(j: int) -> str:
    return f"((({_seed_sql(1234567, '(frame // 2048)')} * p{j}.a + p{j}.c) % 4294967296 * 203) // 4294967296)::BIGINT"


@query(
    f"""WITH {powers_sql(8192)}, {FRAMES} SELECT file_id, frame, {_draw_sql(1)} AS l0, {_draw_sql(2)} AS r0, {_draw_sql(3)} AS l1, {_draw_sql(4)} AS r1 FROM frames
JOIN pow p1 ON p1.n = frame % 2048 * 4 + 1 JOIN pow p2 ON p2.n = frame % 2048 * 4 + 2 JOIN pow p3 ON p3.n = frame % 2048 * 4 + 3 JOIN pow p4 ON p4.n = frame % 2048 * 4 + 4"""
)
def output_dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.output_dither(event_frames(spark, sf_dir), 1234567, 203)


@query(
    f"""WITH RECURSIVE {FRAMES}, w AS (SELECT file_id, frame // 32 AS block, (frame % 32) * 2 AS i, l & 4294967295 AS x FROM frames UNION ALL SELECT file_id, frame // 32, (frame % 32) * 2 + 1, r & 4294967295 FROM frames),
fold(file_id, block, i, k, s) AS (SELECT DISTINCT file_id, block, 0::BIGINT, 0, 0::BIGINT FROM w UNION ALL
SELECT f.file_id, f.block, CASE WHEN f.k = 32 THEN f.i + 1 ELSE f.i END, CASE WHEN f.k = 32 THEN 0 ELSE f.k + 1 END, CASE WHEN f.k = 32 THEN xor(f.s, w.x) ELSE xor(f.s >> 1, (f.s & 1) * {G.CRC32_POLY}) END
FROM fold f JOIN w ON w.file_id = f.file_id AND w.block = f.block AND w.i = f.i)
SELECT file_id, block, arg_max(s, i) AS crc FROM fold WHERE k = 0 GROUP BY file_id, block"""
)
def group_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.group_checks(event_frames(spark, sf_dir))


_CYCLE = signalling.message_cycle(signalling.stream_word(8, 10, 2, True))
_CYCLE_BITS = "".join(f"{b:08b}" for b in _CYCLE)
_CHANGES = {c: "[" + ", ".join(str(x[i]) for x in signalling.CHANGES) + "]" for i, c in enumerate("lr")}
ANNOTATED = f"""{FRAMES}, {walk_sql(0xFFFFFFFF, G.CRC24_POLY, "SELECT max(frame) FROM frames")},
placed AS (SELECT file_id, frame, l, r, (s & 14) + (xor(xor(l, r), substr('{_CYCLE_BITS}', (frame % 248 + 1)::INT, 1)::BIGINT) & 1) + 1 AS i FROM frames JOIN walk ON walk.n = frame),
annotated AS (SELECT file_id, frame, l + {_CHANGES['l']}[i] AS l, r + {_CHANGES['r']}[i] AS r FROM placed)"""


@query(f"WITH RECURSIVE {ANNOTATED} SELECT * FROM annotated")
def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signalling.annotate(event_frames(spark, sf_dir), signalling.stream_word(8, 10, 2, True))


@query(f"WITH {FRAMES} SELECT file_id, frame, substr('{_CYCLE_BITS}', (frame % 248 + 1)::INT, 1)::BIGINT AS signal FROM frames")
def watermark_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = signalling.annotate(event_frames(spark, sf_dir), signalling.stream_word(8, 10, 2, True))
    return signalling.read_back(marked).select("file_id", "frame", "signal")


def _render_sql(ratio: int) -> str:
    def total(c: str, row: tuple[int, ...]) -> str:
        return " + ".join(f"coalesce(lag({c}, {n}) OVER w, 0) * {t}" for n, t in enumerate(row) if t)

    phases = " UNION ALL ".join(f"SELECT file_id, frame * {ratio} + {p} AS out_frame, {total('l', row)} AS l, {total('r', row)} AS r FROM frames WINDOW w AS (PARTITION BY file_id ORDER BY frame)" for p, row in enumerate(render.PLAIN[ratio]))
    return f"""WITH RECURSIVE {FRAMES}, {walk_sql(1, G.CRC24_POLY, f"SELECT {ratio} * max(frame) + {ratio} FROM frames")},
lcg(n, s) AS (SELECT 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, (s * 1664525 + 1013904223) & 4294967295 FROM lcg WHERE n < (SELECT {ratio} * max(frame) + {ratio} FROM frames)),
o AS ({phases}), d AS (SELECT o.*, walk.s AS w, (CASE WHEN lcg.s >= 2147483648 THEN lcg.s - 4294967296 ELSE lcg.s END) >> 8 AS n FROM o JOIN walk ON walk.n = out_frame JOIN lcg ON lcg.n = out_frame)
SELECT file_id, out_frame, (l + w + n) >> 24 AS l, (r + w - n) >> 24 AS r FROM d"""


@query(_render_sql(2))
def render2_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.interpolate(event_frames(spark, sf_dir), 2)


@query(_render_sql(4))
def render4_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.interpolate(event_frames(spark, sf_dir), 4)


@query()
def render2_requantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.requantise(render.interpolate(event_frames(spark, sf_dir), 2, render.FILTER_8[2]), 2)


@query(f"WITH {FRAMES} SELECT file_id, frame, coalesce(lag((l * 40000) >> 16, 15) OVER w, 0) AS oldest, coalesce(lag((r * 40000) >> 16, 3) OVER w, 0) AS third, (l * 40000) >> 16 AS newest FROM frames WINDOW w AS (PARTITION BY file_id ORDER BY frame)")
def pair_ring_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = samples.pair_ring(event_frames(spark, sf_dir), 40000)
    return ring.select("file_id", "frame", F.col("ring")[0]["l"].alias("oldest"), F.col("ring")[12]["r"].alias("third"), F.col("ring")[15]["l"].alias("newest"))



# --- recurrences: one ordered pass a file -----------------------------------------------------------------------------


def _reconstruct(spark: SparkSession, sf_dir: str, long: bool) -> DataFrame:
    frames = event_frames(spark, sf_dir).withColumns({c: F.shiftright(c, 4) for c in "lr"})
    residuals = frames.select("file_id", "frame", (F.col("l") % 900).alias("p"), (F.col("r") % 700).alias("q"))
    return kernels.reconstructed(frames, residuals, generated.output_dither(frames, 1234567, 203), long=long)


@query()
def reconstruct_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconstruct(spark, sf_dir, False)


@query()
def reconstruct_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconstruct(spark, sf_dir, True)


@query()
def symbol_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.decoded_symbols(generated.channel_bytes(event_frames(spark, sf_dir)), 64)


@query()
def channel_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a channel that carries one record, the event names as symbol payloads, and a sync, for each file."""

    def write(frame):
        import pandas as pd

        w = messages.MessageWriter()
        w.record(25)
        for name in frame.sort_values("event_id")["event_type"]:
            w.message(5, name.encode())
        w.sync(2, 25, len(w.data))
        file_id = int(frame["file_id"].iat[0])
        return pd.DataFrame({"file_id": file_id, "offset": range(len(w.data)), "byte": list(w.wire())})

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 8).alias("file_id"), "event_id", "event_type")
    wire = events.groupBy("file_id").applyInPandas(write, "file_id bigint, offset bigint, byte bigint")
    return messages.histogram(messages.messages(generated.descramble(wire)))


ORACLE["channel_messages"] = """SELECT user_id % 8 AS file_id, 5::INT AS type, count(*) AS n, sum(length(event_type))::BIGINT AS bytes FROM events GROUP BY user_id % 8
UNION ALL SELECT DISTINCT user_id % 8, 4, 1, 40 FROM events UNION ALL SELECT DISTINCT user_id % 8, 3, 1, 0 FROM events"""


def _tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two tones each, as long as the event files."""
    frames = event_frames(spark, sf_dir)
    t = F.col("frame").cast("double")
    left = F.sin(t * (0.011 + F.col("file_id") * 0.001)) * 3000000 + F.sin(t * 0.37) * 2000000
    right = F.sin(t * 0.013 + 1) * 3500000 + F.sin(t * 0.31) * 1500000
    return frames.select("file_id", "frame", F.floor(left).cast("bigint").alias("l"), F.floor(right).cast("bigint").alias("r"))


@query()
def encode_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(_tones(spark, sf_dir))


@query()
def encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode(encode.encode(_tones(spark, sf_dir)))


@query()
def decode_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _tones(spark, sf_dir)
    return encode.verify(source, decode.decode(encode.encode(source)))


@query()
def wrap_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of streams that wrapping the event frames makes."""
    return control.scan(encode.wrap(event_frames(spark, sf_dir, 4)), None)


ORACLE["wrap_carrier"] = "SELECT DISTINCT user_id % 4 AS file_id, true AS found, 0::BIGINT AS sync_frame, 8::BIGINT AS k, 9::BIGINT AS orig_rate, 8::BIGINT AS src_rate, 0::BIGINT AS auth_level, false AS studio FROM events"


@query()
def residual_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.layer(encode.encode(_tones(spark, sf_dir)))


@query()
def extra_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.extra(encode.encode(_tones(spark, sf_dir)))


def _lags_sql(c: str, taps: tuple[int, ...], first: int) -> str:
    return " + ".join(f"coalesce(lag({c}, {n + first}) OVER w, 0) * {k}" if n + first else f"{c} * {k}" for n, k in enumerate(taps))


@query(
    f"""WITH {FRAMES}, a AS (SELECT file_id, frame, l, r, (l * 4294967296 + {_lags_sql('l', kernels.C[4:8], 1)}) >> 32 AS lu, (r * 4294967296 + {_lags_sql('r', kernels.C[4:8], 1)}) >> 32 AS ru
FROM frames WINDOW w AS (PARTITION BY file_id ORDER BY frame))
SELECT *, ({_lags_sql('lu', kernels.C[8:22], 0)}) >> 32 AS lv, ({_lags_sql('ru', kernels.C[8:22], 0)}) >> 32 AS rv FROM a WINDOW w AS (PARTITION BY file_id ORDER BY frame)"""
)
def long_filter_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.long_filter(event_frames(spark, sf_dir))
