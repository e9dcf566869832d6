"""Byte-level BPE: batched numpy merge rounds, and the decoding that turns ids into text again.

A block of texts is split into words, and each different word is merged once. The symbols of all of them lie in one
flat array. Neighbouring pairs are looked up by binary search over the sorted pair keys; each round takes the lowest
rank of every word and merges all its places at once (of overlapping places, as in a run of one letter, every second).
A merge only makes pairs of higher rank, so this equals merging one pair at a time. Only pairs beside a merge are looked
up again, and words that have no pair left leave the array.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges, as published with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that are encoded at a time: more take more memory and fewer merges.
BLOCK = 4 << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Arrays of one vocabulary: sorted pair keys with their ranks, merged ids by rank, ids of bytes, bytes of ids."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    of_byte: np.ndarray
    pieces: list[bytes]
    specials: dict[str, int]
    splitter: object = None
    words: object = None

    of_bytes: object = None

    def byte_ranks(self, ranks) -> np.ndarray:
        """The ranks of all pairs of bytes."""
        if self.of_bytes is None:
            first, second = np.divmod(np.arange(1 << 16), 256)
            self.of_bytes = ranks(self.of_byte[first], self.of_byte[second])
        return self.of_bytes

    def ready(self) -> None:
        if self.words is None:
            self.words = regex.compile(PATTERN).findall
            longest = sorted(self.specials, key=len, reverse=True)
            self.splitter = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else None


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    if model["type"] != "BPE" or spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    back = {c: b for b, c in letters.items()}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, i in (vocab | added).items():
        pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return Vocabulary(keys[order], order.astype(np.int32), merged, np.array([vocab[letters[b]] for b in range(256)]), pieces, added)


def merge_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and where each word's begin (and the last one's end)."""
    none = np.int32(len(v.keys))

    def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(v.keys, key), none - 1)
        return np.where(v.keys[at] == key, v.ranks[at], none)

    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    ids = v.of_byte[data].astype(np.int32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    rank = np.full(len(ids), none)
    inner = np.nonzero(owner[:-1] == owner[1:])[0]
    rank[inner] = v.byte_ranks(ranks)[data[inner].astype(np.int64) << 8 | data[inner + 1]]  # of the pair that a symbol forms with the next one of its word
    done_ids, done_owner = [], []
    while len(ids):
        starts = np.concatenate([[0], np.nonzero(owner[1:] != owner[:-1])[0] + 1])
        lowest = np.minimum.reduceat(rank, starts)
        least = np.repeat(lowest, np.diff(np.append(starts, len(ids))))
        places = np.nonzero((rank == least) & (rank != none))[0]
        first = np.concatenate([[True], np.diff(places) != 1])[: len(places)]
        run_start = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
        places = places[(np.arange(len(places)) - run_start) % 2 == 0]
        keep = np.ones(len(ids), bool)
        if (lowest == none).any():
            over = least == none
            done_ids.append(ids[over])
            done_owner.append(owner[over])
            keep = ~over
        ids[places] = v.merged[rank[places]]
        rank[places] = none
        keep[places + 1] = False
        after = np.cumsum(keep, dtype=np.int32) - 1
        ids, owner, rank = ids[keep], owner[keep], rank[keep]
        new = after[places]
        beside = np.zeros(len(ids) + 1, bool)
        beside[new] = beside[new - 1] = True
        new = np.nonzero(beside[: max(len(ids) - 1, 0)])[0]
        within = owner[new] == owner[new + 1]
        rank[new[~within]] = none
        new = new[within]
        rank[new] = ranks(ids[new], ids[new + 1])
    ids = np.concatenate([*done_ids, np.empty(0, np.int32)])
    owner = np.concatenate([*done_owner, np.empty(0, np.int32)])
    order = np.argsort(owner, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def decode_bytes(v: Vocabulary, ids: Iterable[int]) -> str:
    """The text of ids, special tokens as their strings; bytes that are no UTF-8 become replacement characters."""
    return b"".join([v.pieces[i] for i in ids]).decode("utf-8", "replace")


#: A space and what makes it no beginning of a word.
_LOOSE = re.compile(r" (?=\s|$)").search
_LOOSE_ASCII = tuple(f" {chr(c)}" for c in range(128) if chr(c).isspace())


def _is_loose(text: str) -> bool:
    """Whether a space stands before white space or at the end."""
    if text.isascii():
        return text[-1] == " " or any([pair in text for pair in _LOOSE_ASCII])
    return _LOOSE(text) is not None


def _split(v: Vocabulary, text: str) -> list[str]:
    """Words of a text; special tokens stand alone and are never split."""
    if v.splitter is None or not any(s in text for s in v.specials):
        return v.words(text)
    return [w for part in v.splitter(text) if part for w in ([part] if part in v.specials else v.words(part))]


def _gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[offsets[i] : offsets[i + 1]] of index one after another, and where each begins and the last ends."""
    sizes = offsets[index + 1] - offsets[index]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(offsets[index] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Numbers(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


def encode_block(v: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and where each text's begin (and the last one's end).

    A space before something that isn't white space always begins a word, so where no other space occurs a text falls
    apart at its spaces, and each different piece is split by the pattern once. Other texts are split as a whole.
    """
    v.ready()
    spaced, exact = Numbers(), Numbers()
    index = array("q")  # units of all texts: spaced pieces as they are numbered, exact words as ~number
    counts = [0]
    for t in texts:
        if t and (_is_loose(t) or v.splitter is not None and any(s in t for s in v.specials)):
            index.extend([~exact[w] for w in _split(v, t)])
        elif t:
            first, *rest = t.split(" ")
            index.extend([~exact[w] for w in v.words(first)])
            index.extend(map(spaced.__getitem__, rest))
        counts.append(len(index))
    pieces = list(spaced)
    letters = np.fromiter(map(str.isalpha, pieces), bool, len(pieces))  # a space and letters are one word
    single, several = np.nonzero(letters)[0], np.nonzero(~letters)[0]
    words = Numbers(exact)
    inside = [list(map(words.__getitem__, v.words(" " + pieces[i]))) for i in several.tolist()]
    plain = [b"" if w in v.specials else w.encode("utf-8", "surrogatepass") for w in words]
    plain += [b" " + pieces[i].encode() for i in single.tolist()]
    ids, begins = merge_words(v, plain)
    if not v.specials.keys().isdisjoint(words):  # special tokens are one id each
        parts = [ids[begins[i] : begins[i + 1]] for i in range(len(plain))]
        for w in v.specials.keys() & words.keys():
            parts[words[w]] = np.array([v.specials[w]], np.int32)
        ids, begins = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    # Members of the units: of spaced pieces first, then of exact words, which are their own.
    sizes = np.ones(len(pieces) + len(exact), np.int64)
    sizes[several] = list(map(len, inside))
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    members = np.empty(firsts[-1], np.int64)
    members[firsts[single]] = len(words) + np.arange(len(single))
    members[firsts[len(pieces)] :] = np.arange(len(exact))
    at, _ = _gather(np.arange(len(members)), firsts, several)
    members[at] = list(chain.from_iterable(inside))
    member_ids, member_ends = _gather(ids, begins, members)
    units = np.frombuffer(index, np.int64)
    flat, ends = _gather(member_ids, member_ends[firsts], np.where(units < 0, len(pieces) + ~units, units))
    return flat, ends[np.array(counts)]


def blocks(texts: list[str | None], chars: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters."""
    low, size = 0, 0
    for high, t in enumerate(texts, 1):
        size += len(t or "")
        if size >= chars or high == len(texts):
            yield low, high
            low, size = high, 0


def tokenized(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """The columns of keep, n_tokens, ids_sha256, decoded_sha256, and with ids also `ids` (array<int>), for every row.

    Whole texts are encoded as ordinary text in which special tokens count as such; a null text counts as empty (no
    tokens, hashes of nothing). Repeated rows keep a row each, an empty table gives an empty result, and only the named
    columns are read, so others cannot clash. The vocabulary (of fixed size) is sent to the executors with the task.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(vars(load_vocabulary(path)))
    kept = [f.name for f in docs.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(**vocabulary.value)
        decimal = [str(i).encode() for i in range(len(v.pieces))].__getitem__
        piece = v.pieces.__getitem__
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for low, high in blocks(texts):
                flat, ends = encode_block(v, texts[low:high])
                id_hash, text_hash = [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = flat[a:b].tolist()
                    id_hash.append(hashlib.sha256(b",".join(map(decimal, own))).hexdigest())
                    whole = b"".join(map(piece, own)).decode("utf-8", "replace")
                    text_hash.append(hashlib.sha256(whole.encode()).hexdigest())
                columns = [c.slice(low, high - low) for c in batch.columns[1:]] + [pa.array(np.diff(ends), pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, kept + ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(text).cast("string").alias("__text"), *keep).mapInArrow(run, schema)
