"""The control channel: finding it, parsing its packets, describing and counting streams.

Search is a window over each file: a 40-bit register per candidate bit is doubled up from shorter ones (1, 2, 4, ...)
with lags that share one sort. Framing depends on what came before, so packets are parsed one file at a time by a
kernel over packed bits, fed with blocks of frames; blocks keep rows narrow (a bit a frame) on the way there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import generators as G
from ..functions.fixedpoint import big, bit_at, shr

# The 40 bits that open a stream, where the channel may lie, packet types, bit depths of a renderer.
MAGIC, MAGIC_BITS = 0x11319207D5, 40
BITS = range(8, 16)
TYPE_NAMES = ("hole", "reconstruction", "data", "terminate", "authentication", "datasync", "packet 6", "metadata", "key")
RENDER_DEPTHS = (20, 18, 16, 15)
STUDIO = 9
SCAN_FRAMES = 5 * 48000

#: The layout of packets, as (field, bits) after the 4-bit type; None skips.
DATASYNC = ((None, 36), ("stream_pos_flag", 1), (None, 1), ("orig_rate", 5), ("src_rate", 5), ("render_filter", 5), ("unknown_1", 2), ("render_bitdepth", 2), ("unknown_2", 4), ("auth_info", 4), ("auth_level", 4), ("item_count", 7))
ITEMS = {
    0: ((("stage2_dither", 2), ("gain_index", 4), ("level", 7), ("lag", 7)), (("start_pos", 27), (None, 1))),
    1: ((("scale_index", 6), ("carrier_class", 2), ("variant", 1), ("salt_select", 2)), (("sync_mode", 8), ("consumed_lo", 1), ("offset", -12))),
    2: ((("scale_index", 6), ("salt_select", 2)), (("sync_mode", 3), ("consumed_lo", 1), ("offset", -12))),
    3: ((("iv", 64), ("start_pos", 32)), ()),
}
MOST_ITEMS = 16


def find_streams(frames: DataFrame) -> DataFrame:
    """(file_id, sync_frame, k): the first frame of the opening packet and its bit; files without one have no row."""
    order = Window.partitionBy("file_id").orderBy("frame")
    rows = frames.select("file_id", "frame", *[bit_at(F.col("l").bitwiseXOR(F.col("r")), k).alias(f"r{k}") for k in BITS])
    width = 1
    while width < 32:
        lagged = {f"b{k}": F.lag(f"r{k}", width).over(order) for k in BITS}
        if width == 8:
            rows = rows.withColumns({f"e{k}": F.lag(f"r{k}", 32).over(order) for k in BITS})
        rows = rows.withColumns(lagged).withColumns({f"r{k}": F.col(f"b{k}").bitwiseOR(F.shiftleft(F.col(f"r{k}"), width)) for k in BITS})
        width *= 2
    hits = [F.when((F.col(f"e{k}") == MAGIC & 255) & (F.col(f"r{k}") == MAGIC >> 8), F.lit(k)) for k in BITS]
    found = rows.select("file_id", "frame", F.coalesce(*hits).alias("k")).where("k is not null")
    first = found.groupBy("file_id").agg(F.min(F.struct("frame", "k")).alias("m"))
    return first.select("file_id", (F.col("m.frame") - (MAGIC_BITS - 1)).alias("sync_frame"), F.col("m.k").cast("bigint").alias("k"))


def channel_bits(frames: DataFrame, streams: DataFrame) -> DataFrame:
    """(file_id, pos, bit) of each stream, from its first frame on."""
    rows = frames.join(streams.select("file_id", "sync_frame", "k"), "file_id").where(F.col("frame") >= F.col("sync_frame"))
    return rows.select("file_id", (F.col("frame") - F.col("sync_frame")).alias("pos"), shr(F.col("l").bitwiseXOR(F.col("r")), F.col("k")).bitwiseAND(big(1)).alias("bit"))


class Bits:
    """A read position in packed bits, least significant first, with the check register of what was read."""

    def __init__(self, bits: np.ndarray, pos: int, seed: int):
        self.bits, self.pos, self.check, self.short = bits, pos, seed, False

    def take(self, n: int) -> int:
        signed, n = n < 0, abs(n)
        if self.pos + n > len(self.bits):
            self.short, self.pos = True, self.pos + n
            return 0
        value = 0
        for i, b in enumerate(self.bits[self.pos : self.pos + n].tolist()):
            value |= b << i
            self.check = (self.check >> 1 | b << 31) ^ G.CRC2_POLY * (self.check & 1)
        self.pos += n
        return value - (1 << n) if signed and value >> n - 1 else value

    def fields(self, layout: tuple) -> dict:
        return {name: value for name, n in layout if (value := self.take(n)) is not None and name}

    def zeros(self, n: int) -> None:
        for _ in range(n):
            self.check = self.check >> 1 ^ G.CRC2_POLY * (self.check & 1)


def _datasync(c: Bits) -> dict:
    d = c.fields(DATASYNC)
    sizes = [c.take(8) for _ in range(d["item_count"])]
    types = [c.take(8) for _ in range(d["item_count"])]
    d["stream_position"] = c.take(32) if d["stream_pos_flag"] else 0
    d["items"] = []
    for size, kind in list(zip(sizes, types, strict=True))[:MOST_ITEMS]:
        begin = c.pos
        always, positioned = ITEMS.get(kind, ((), ()))
        values = c.fields(always + (positioned if d["stream_pos_flag"] else ()))
        c.take(max(0, size - (c.pos - begin)))  # the declared size wins
        if c.short:
            break
        d["items"].append({"type": kind, "size": size, "fields": values, "ready": c.pos})
    return d


def _body(kind: int, c: Bits) -> dict | None:
    """The fields of a packet after its type; None for a type that is none."""
    if kind == 0:
        size = c.take(4)
        size = c.take(12) if size == 15 else size
        c.take(size)
        return {"size": size}
    if kind in (1, 6):
        size = c.take(12)
        c.take(size)
        return {"size": size}
    if kind == 2:
        unknown, size = c.take(8), c.take(12)
        c.take(size)
        return {"unknown": unknown, "size": size}
    if kind == 3:
        return {"bits_to_end": c.take(17)}
    if kind == 4:
        return {"auth_level": c.take(4), "data": bytes(c.take(8) for _ in range(384))}
    if kind == 5:
        return _datasync(c)
    if kind == 7:
        head = c.fields((("metadata_type", 7), ("is_last", 1), ("fragment_number", 12), ("size", 8)))
        return head | {"size": head["size"] + 1, "data": bytes(c.take(8) for _ in range(head["size"] + 1))}
    if kind == 8:
        size, unknown = c.take(12), c.take(32)
        c.take(max(0, size - 32))
        return {"size": size, "unknown": unknown}
    return None


def _find_magic(bits: np.ndarray, start: int) -> int:
    """Where the opening bits next begin, -1 if nowhere."""
    text = bits[start:].astype(np.uint8).tobytes()
    at = text.find(bytes(MAGIC >> i & 1 for i in range(MAGIC_BITS)))
    return -1 if at < 0 else at + start


def parse_packets(bits: np.ndarray) -> Iterator[dict]:
    """Packets of a channel that opens at bit 0, sessions after a loss included.

    A failed check or an unknown type is a loss: a row of type -1, and the search goes on behind the bits that had been
    buffered by then (to the next multiple of 1024 from the session's start, when packets are looked at). base is where
    the session's bits begin, offset counts from there.
    """
    base, session = 0, 0
    while base >= 0:
        window, pos = bits[base:], 0
        if len(window) < 80:
            return
        position = 0
        if window[40]:
            at = 80 + 16 * int(sum(int(b) << i for i, b in enumerate(window[73:80])))
            if len(window) < at + 32:
                return
            position = int(sum(int(b) << i for i, b in enumerate(window[at : at + 32].tolist())))
        lost = False
        while not lost:
            c = Bits(window, pos, position & 15)
            kind = c.take(4)
            if c.short:
                return
            body = _body(kind, c)
            if body is not None and c.short:
                return
            end = c.pos
            if body is not None:
                c.zeros(-(end - pos) % 32)
                expect, check = c.check & 15, c.take(4)
                if c.short:
                    return
                lost = expect != check
            else:
                lost = True
            if lost:
                seen = min(len(window), -(-c.pos // 1024) * 1024)
                yield {"session": session, "base": base, "offset": pos, "type": -1, "bits": 0, "body": {}, "position": position}
                base, session = _find_magic(bits, base + seen), session + 1
                break
            yield {"session": session, "base": base, "offset": pos, "type": kind, "bits": c.pos - pos, "body": body, "position": position, "checksum": check, "seed": position & 15}
            if kind == 5 and body["stream_pos_flag"]:
                position = body["stream_position"]
            position += c.pos - pos
            pos = c.pos


PACKETS = """file_id bigint, session int, base bigint, offset bigint, type int, bits bigint, checksum int, checksum_seed int, position bigint,
size bigint, unknown bigint, bits_to_end bigint, auth_level int, metadata_type int, is_last int, fragment_number int, data binary,
datasync struct<stream_pos_flag:int,orig_rate:int,src_rate:int,render_filter:int,unknown_1:int,render_bitdepth:int,unknown_2:int,auth_info:int,auth_level:int,item_count:int,stream_position:bigint>,
items array<struct<type:int,size:int,ready:bigint,fields:map<string,decimal(20,0)>>>"""


def _row(file_id: int, p: dict) -> dict:
    from decimal import Decimal

    b = p["body"]
    out = {"file_id": file_id, **{k: p.get(k) for k in ("session", "base", "offset", "type", "bits", "checksum", "position")}, "checksum_seed": p.get("seed")}
    out |= {k: b.get(k) for k in ("size", "unknown", "bits_to_end", "metadata_type", "is_last", "fragment_number", "data")}
    out["auth_level"] = b.get("auth_level") if p["type"] == 4 else None
    sync = p["type"] == 5
    out["datasync"] = {k: b[k] for k in b if k != "items"} if sync else None
    out["items"] = [{"type": i["type"], "size": i["size"], "ready": i["ready"], "fields": {k: Decimal(v) for k, v in i["fields"].items()}} for i in b["items"]] if sync else None
    return out


def packets(bits: DataFrame, block: int = 4096) -> DataFrame:
    """Packets of channel bits (file_id, pos, bit), losses as rows of type -1; the columns are PACKETS.

    Bits are packed into strings of `block` positions first, so what one file gathers is its frames in bytes.
    """
    from pyspark.sql import types as T

    held = bits.groupBy("file_id", F.floor(F.col("pos") / block).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "bit"))), lambda x: x["bit"].cast("string")), "").alias("text"))
    schema = T._parse_datatype_string(PACKETS)
    names = [f.name for f in schema.fields]

    def parse(frame: pd.DataFrame) -> pd.DataFrame:
        text = "".join(frame.sort_values("block")["text"])
        file_id = int(frame["file_id"].iat[0])
        rows = [_row(file_id, p) for p in parse_packets(np.frombuffer(text.encode(), np.uint8) - 48)]
        return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype="object") for n in names})

    return held.groupBy("file_id").applyInPandas(parse, schema)


def type_name(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == i, F.lit(n)) for i, n in enumerate(TYPE_NAMES)), F.lit("lost"))


def rate_name(code: Column) -> Column:
    """A rate code in words."""
    hz = G.rate_hz(code)
    whole = F.concat(shr(hz / 1000, 0).cast("string"), F.lit(" kHz"))
    return F.when(hz == 0, F.concat(F.lit("code "), code.cast("string"))).when(hz % 1000 != 0, F.concat(F.format_number(hz / 1000, 1), F.lit(" kHz"))).otherwise(whole)


def opening_fields(frames: DataFrame, streams: DataFrame) -> DataFrame:
    """The header of each opening packet as columns, without the kernel: 80 bits after the start."""
    head = channel_bits(frames, streams).where(F.col("pos") < 80).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "bit"))).alias("all"))
    head = head.where(F.size("all") == 80)
    columns, at = [], 4
    for name, n in DATASYNC:
        if name:
            part = F.slice(F.transform("all", lambda x: x["bit"]), at + 1, n)
            columns.append(F.aggregate(F.reverse(part), big(0), lambda acc, b: acc * 2 + b).alias(name))
        at += n
    return head.select("file_id", *columns)


def scan(frames: DataFrame, limit: int | None = SCAN_FRAMES) -> DataFrame:
    """A row for each file: (file_id, found, sync_frame, k, orig_rate, src_rate, auth_level, studio). Only the first
    `limit` frames are searched (None: all)."""
    seen = frames if limit is None else frames.where(F.col("frame") < limit)
    streams = find_streams(seen)
    heads = streams.join(opening_fields(seen, streams), "file_id", "left")
    files = frames.select("file_id").distinct()
    rows = files.join(heads, "file_id", "left")
    return rows.select("file_id", F.col("orig_rate").isNotNull().alias("found"), "sync_frame", "k", "orig_rate", "src_rate", "auth_level", (F.col("auth_level") >= STUDIO).alias("studio"))


def stats(scanned: DataFrame) -> DataFrame:
    """(kind, value, n): files, streams, studio streams, and streams by original rate, auth level and channel bit."""
    found = F.col("found")
    entry = [("files", F.lit(True), None), ("streams", found, None), ("studio", found & F.col("studio"), None), ("orig_rate", found, "orig_rate"), ("auth_level", found, "auth_level"), ("channel_bit", found, "k")]
    kinds = F.array(*[F.when(ok, F.struct(F.lit(kind).alias("kind"), (F.col(c) if c else F.lit(None)).cast("bigint").alias("value"))) for kind, ok, c in entry])
    rows = scanned.select(F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("e"))
    return rows.groupBy("e.kind", "e.value").agg(F.count(F.lit(1)).alias("n"))


def info(found: DataFrame, streams: DataFrame) -> DataFrame:
    """What each stream holds: packets, losses, resyncs, authentication packets, where it ends."""
    ok = F.col("type") >= 0
    end = F.when(F.col("type") == 3, F.col("base") + F.col("offset") + 21 + F.col("bits_to_end"))
    rows = found.groupBy("file_id").agg(
        F.count_if(ok).alias("packets"),
        F.count_if(~ok).alias("errors"),
        F.greatest(F.count_if(F.col("type") == 5) - 1, F.lit(0)).cast("bigint").alias("resyncs"),
        F.count_if(F.col("type") == 4).alias("auth_packets"),
        F.max_by(end, F.when(F.col("type") == 3, F.col("base") + F.col("offset"))).alias("end"),
        F.sum(F.when(ok & (F.col("type") != 0), F.col("bits")).otherwise(0)).alias("data_bits"),
    )
    return rows.join(streams, "file_id").select("file_id", "k", "sync_frame", "packets", "errors", "resyncs", "auth_packets", (F.col("sync_frame") + F.col("end")).alias("end_frame"), "data_bits")


def packet_counts(found: DataFrame) -> DataFrame:
    """(file_id, type, n) of what was parsed."""
    return found.where("type >= 0").groupBy("file_id", "type").agg(F.count(F.lit(1)).alias("n"))


def data_rate(found: DataFrame, frames: DataFrame, rate: int = 48000) -> DataFrame:
    """(file_id, bits_per_second) of packets that are not holes."""
    n = frames.groupBy("file_id").agg(F.count(F.lit(1)).alias("frames"))
    bits = found.groupBy("file_id").agg(F.sum(F.when(F.col("type") > 0, F.col("bits")).otherwise(0)).alias("bits"))
    return bits.join(n, "file_id").select("file_id", (F.col("bits") * rate / F.col("frames")).alias("bits_per_second"))


def metadata(fragments: DataFrame) -> DataFrame:
    """(file_id, metadata_type, size, complete, data): the last blob of each file from its fragments.

    fragments: (file_id, offset, metadata_type, fragment_number, is_last, data). Fragment 0 starts a blob anew; those
    before the first one start one too.
    """
    order = Window.partitionBy("file_id").orderBy("offset")
    rows = fragments.withColumn("blob", F.sum(F.when(F.col("fragment_number") == 0, 1).otherwise(0)).over(order))
    blobs = rows.groupBy("file_id", "blob").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("data").alias("hex")))).alias("all"), F.min_by("metadata_type", F.when(F.col("fragment_number") == 0, F.col("offset"))).alias("metadata_type"), F.max("is_last").alias("complete"))
    last = blobs.groupBy("file_id").agg(F.max_by(F.struct("all", "metadata_type", "complete"), "blob").alias("b"))
    data = F.unhex(F.array_join(F.transform("b.all", lambda x: x["hex"]), ""))
    return last.select("file_id", F.col("b.metadata_type").alias("metadata_type"), F.length(data).cast("bigint").alias("size"), (F.col("b.complete") > 0).alias("complete"), data.alias("data"))


def payload_bits(bits: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, offset, n, bit): the bits inside reconstruction packets: a range join, narrowed by blocks of positions."""
    width = 4096
    spans = found.where("type = 1").select("file_id", (F.col("base") + F.col("offset")).alias("offset"), (F.col("base") + F.col("offset") + 16).alias("begin"), (F.col("base") + F.col("offset") + 16 + F.col("size")).alias("stop"))
    spans = spans.where("stop > begin").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("stop") - 1) / width))))
    rows = bits.withColumn("block", F.floor(F.col("pos") / width)).join(spans, ["file_id", "block"])
    return rows.where("pos >= begin and pos < stop").select("file_id", "offset", (F.col("pos") - F.col("begin")).alias("n"), "bit")


def in_force(events: DataFrame, frames: DataFrame, columns: list[str], group: int = 32, ahead: int = 480) -> DataFrame:
    """(file_id, group, columns...): the latest values known at each group: those announced up to `ahead` frames on.

    events: (file_id, frame, columns...), null where an event leaves a value as it was. An as-of join by one sort.
    """
    groups = frames.where(F.col("frame") % group == 0).select("file_id", (F.col("frame") / group).cast("bigint").alias("group"), (F.col("frame") + ahead).alias("at"))
    blank = [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in columns]
    rows = events.select("file_id", F.lit(None).cast("bigint").alias("group"), F.col("frame").alias("at"), *columns).union(groups.select("file_id", "group", "at", *blank))
    order = Window.partitionBy("file_id").orderBy("at", F.col("group").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = rows.select("file_id", "group", *[F.last(c, ignorenulls=True).over(order).alias(c) for c in columns])
    return known.where("group is not null")
