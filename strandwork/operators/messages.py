"""The data channel: framed messages over descrambled bytes, one stream at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import generators as G

# Bytes after the first of a message's header, by type (one, a size, for all others).
HEADER_REST = {0: 0, 1: 1, 2: 1, 3: 1, 4: 5}
RECORD_A, RECORD_B, PAYLOAD = 8, 32, 254
_TABLE = G.register_table(G.CRC2_POLY).tolist()

MESSAGES = """file_id bigint, offset bigint, type int, size int, check int, check_ok boolean, stream_id bigint, kind int, flag int, word bigint,
mismatch boolean, part_a binary, part_b binary, payload binary"""


def check_nibble(data: bytes, offset: int) -> int:
    """The check of a message's bytes after its first."""
    reg = offset & 0xFFFFFFFF
    for b in data:
        reg = (b << 24 | reg >> 8) ^ _TABLE[reg & 255]
    return reg & 15


def _sync(rest: bytes) -> dict:
    first = rest[0]
    kind, has_id, has_word = first >> 2 & 15, first & 1, first >> 1 & 1
    ident = int.from_bytes(rest[:3], "little") & ~0x3F if has_id else None
    tail = rest[3:7] if has_id else rest[1:5]
    return {"kind": kind, "flag": has_word, "stream_id": ident, "word": int.from_bytes(tail, "little") if has_word else 0}


def _same_stream(mine: int, other: int) -> bool:
    """Ids agree in three six-bit fields."""
    return not ((mine ^ other) & 0xFC0 or (mine ^ other) & 0x3F000 or (mine >> 16 ^ other >> 16) & 0xFC)


def parse_messages(data: bytes) -> Iterator[dict]:
    """Messages of a stream that opens with a parameter record (type 4); a failed check, a sync of another stream or a
    record later on ends the stream. A message that is cut off at the end is not given."""
    at, ident, len_a = 0, None, 0
    while at < len(data):
        kind, check = data[at] & 15, data[at] >> 4
        if (at == 0) != (kind == 4):
            return
        rest = HEADER_REST.get(kind, 1)
        if kind == 3:
            if at + 1 >= len(data):
                return
            rest = 1 + 2 * (data[at + 1] & 1) + 4 * (data[at + 1] >> 1 & 1)
        head = data[at + 1 : at + 1 + rest]
        if len(head) < rest:
            return
        row = {"offset": at, "type": kind, "check": check, "mismatch": False}
        size = 0
        if kind == 4:
            ident, len_a, size = int.from_bytes(head[:3], "little"), head[3], head[3] + head[4]
            row["stream_id"] = ident
        elif kind == 3:
            found = _sync(head)
            if found["kind"] in (2, 5):
                row |= found
                if found["stream_id"] is not None and not _same_stream(ident, found["stream_id"]):
                    yield row | {"size": 0, "mismatch": True, "check_ok": False}
                    return
                ident = row["stream_id"] = found["stream_id"] if found["stream_id"] is not None else ident
        elif kind != 0:
            size = head[0]
        payload = data[at + 1 + rest : at + 1 + rest + size]
        if len(payload) < size:
            return
        if kind == 4:
            tail = size - len_a
            row |= {"part_a": payload[: min(len_a, RECORD_A)], "part_b": payload[len_a : len_a + (RECORD_B if tail > 31 else tail)]}
        ok = check_nibble(head + payload, at) == check
        yield row | {"size": size, "check_ok": ok, "payload": payload}
        if not ok:
            return
        at += 1 + rest + size


def messages(data: DataFrame, block: int = 8192) -> DataFrame:
    """Messages of descrambled channel bytes (file_id, offset, byte); the columns are MESSAGES."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "byte"))), lambda x: F.lpad(F.hex(x["byte"]), 2, "0")), "")
    held = data.groupBy("file_id", F.floor(F.col("offset") / block).alias("block")).agg(F.unhex(text).alias("data"))
    schema = T._parse_datatype_string(MESSAGES)
    names = [f.name for f in schema.fields]

    def parse(frame: pd.DataFrame) -> pd.DataFrame:
        whole = b"".join(map(bytes, frame.sort_values("block")["data"]))
        rows = [m | {"file_id": int(frame["file_id"].iat[0])} for m in parse_messages(whole)]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype="object") for n in names})

    return held.groupBy("file_id").applyInPandas(parse, schema)


def routed(found: DataFrame) -> DataFrame:
    """(file_id, type, data): the payloads of types 2 and 5, each cut to 254 bytes, joined in order."""
    rows = found.where("type in (2, 5)").groupBy("file_id", "type").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex(F.substring("payload", 1, PAYLOAD)).alias("hex")))).alias("all"))
    return rows.select("file_id", "type", F.unhex(F.array_join(F.transform("all", lambda x: x["hex"]), "")).alias("data"))


def histogram(found: DataFrame) -> DataFrame:
    """(file_id, type, n, bytes) of a stream's messages."""
    return found.groupBy("file_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


class MessageWriter:
    """Writes messages; `wire` hides them under the scrambler."""

    def __init__(self) -> None:
        self.data = bytearray()

    def _put(self, kind: int, rest: bytes) -> None:
        self.data += bytes([kind | check_nibble(rest, len(self.data)) << 4]) + rest

    @staticmethod
    def stream_id(scale_index: int) -> int:
        return (scale_index & 63) * (1 << 6 | 1 << 12 | 1 << 18)

    def record(self, scale_index: int, seeds: bytes = bytes(8), state: bytes = bytes(32)) -> None:
        self._put(4, self.stream_id(scale_index).to_bytes(3, "little") + bytes([8, 32]) + seeds + state)

    def message(self, kind: int, payload: bytes) -> None:
        payload = payload[:255]
        self._put(kind, bytes([len(payload)]) + payload)

    def sync(self, kind: int, scale_index: int, check: int | None = None) -> None:
        ident = self.stream_id(scale_index)
        first = ident & 0xC0 | 1 | (2 if check is not None else 0) | (kind & 15) << 2
        self._put(3, bytes([first]) + ident.to_bytes(3, "little")[1:] + (b"" if check is None else check.to_bytes(4, "little")))

    def idle(self, n: int) -> None:
        for _ in range(n):
            self._put(0, b"")

    def pad_to(self, size: int) -> None:
        self.idle(max(0, size - len(self.data)))

    def wire(self) -> bytes:
        return bytes(np.frombuffer(bytes(self.data), np.uint8) ^ scrambler_bytes(len(self.data)))


def scrambler_bytes(n: int, start: int = 0) -> np.ndarray:
    """The scrambler's bytes from an offset of the channel on."""
    return scrambler_at(np.arange(start, start + n))


def scrambler_at(at: np.ndarray) -> np.ndarray:
    """The scrambler's bytes at offsets of the channel."""
    batch = 2 * G.BATCH_PAIRS
    at = at.astype(np.uint64)
    a, c = (np.array(x, np.uint64) for x in zip(*G.powers(batch + 1), strict=True))
    seed = (np.uint64(G.DESCRAMBLER_SALT) + at // np.uint64(batch)) & np.uint64(G.WORD)
    seed = seed * seed & np.uint64(G.WORD)
    k = (at % np.uint64(batch)).astype(np.int64) + 1
    return ((a[k] * seed + c[k] & np.uint64(G.WORD)) >> np.uint64(24)).astype(np.uint8)
