"""Operator 8: removal of long repeats by a range-partitioned, sparsely sampled suffix array.

A byte is removed if a MATCH-byte string over it also starts in a document with a smaller id. Sorting every
suffix would move fifty times the corpus, so suffixes start at anchors only: a string of MATCH bytes holds
MATCH - GRAM + 1 grams, and the gram of least hash is its anchor. Equal strings have equal anchors, so no
match is lost, and each string belongs to exactly one anchor.

1. Distinct texts, compressed, are dealt by text hash into chunks, each with its least id. Copies stay behind: a
   task sends a text once, however many of its rows hold it.
2. Each chunk sends the hashes of its anchors to ranges of leading gram bytes. The ranges come from sampled
   splitters (quantiles of an anchor sample in proportion to the ranges), so a range holds all suffixes with its
   leading bytes and equal strings never lie on two sides of a boundary.
3. A range answers which anchors occur in more than one text; a chunk then sends, for those only, the bytes
   that the anchor's strings span, once for each distinct span (a passage that a third of all documents
   share costs one span for each chunk). A hot gram, with very many different spans, would overfill its range: its
   strings are dealt out by a hash of all their bytes instead.
4. Strings are sorted by multikey sort over eight-byte words, ties only, and for each the smallest document id is
   found; strings from larger ids are covered, and the chunk removes what they cover. Sixty-four bit hashes only
   choose what to compare; spans and strings count as equal if their bytes are.
5. Rows join the results of their texts. Only the row of the least id keeps more than a short text.

This departs from the plain method in two points: only suffixes at shared anchors are sorted, and the local sort is
NumPy's (by words, ties only) instead of a recursive multikey quicksort. The result is exact.

Defined cases: a null text is empty; texts shorter than MATCH keep everything; null ids count as larger
than every id; equal ids never cover each other; repeated rows get equal results; very long texts are hashed in
slices but lie in one chunk; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transloom.llm.common import once, small_batches

MATCH = 50
GRAM = 16
#: Grams of a string.
SPREAD = MATCH - GRAM + 1
#: Text bytes of a chunk and of a range, on the mean, and bytes that are hashed at once in a task.
CHUNK_BYTES = 4 << 20
RANGE_BYTES = 4 << 20
SLICE_BYTES = 1 << 20
#: From so many text bytes on, chunks and ranges grow with the root of the input (up to GROWTH times), so that what
#: a chunk sends to a range does not shrink to single hashes.
STEADY_BYTES = 1 << 34
GROWTH = 8
#: A gram that so many texts of a chunk have is dense there; one that is dense in more than HOT_CHUNKS chunks, or is
#: in more than MOST_CHUNKS at all, is hot.
DENSE = 32
HOT_CHUNKS = 16
MOST_CHUNKS = 4096
#: Of the texts that are sampled for splitters every so manieth anchor counts; keys drawn for each range, and texts at least.
THIN = 8
KEYS_PER_RANGE = 64
SAMPLE_TEXTS = 400
NO_ID = (1 << 63) - 1

_SPAN = SPREAD - 1 + MATCH
_WIDE = -(-_SPAN // 8) * 8
_ODD = np.random.default_rng(11).integers(1, 1 << 63, size=_WIDE // 8, dtype=np.uint64) | np.uint64(1)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _rolling(buf: np.ndarray) -> np.ndarray:
    """32-bit hashes of the GRAM bytes from each position on (never 0); GRAM is a power of two."""
    with np.errstate(over="ignore"):
        h = (buf.astype(np.uint32) + np.uint32(0x7F4A7C15)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        step = 1
        while step < GRAM:
            h = h[:-step] * np.uint32(0x85EBCA77) + h[step:]
            h ^= h >> np.uint32(13)
            step *= 2
        h *= np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(16)
    return h | np.uint32(1)


def _slide(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + SPREAD] for every i."""
    width = 1
    while 2 * width <= SPREAD:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = SPREAD - width
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string start, last string start) of all strings inside the texts [starts, ends) of ``buf``."""
    empty = np.empty(0, np.int64)
    if len(buf) < MATCH:
        return empty, empty, empty
    h = _rolling(buf)
    low = _slide(h, np.minimum)  # for each string start
    valid = np.zeros(len(buf) + 1, np.int8)
    long = ends - starts >= MATCH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - MATCH + 1, -1)
    valid = np.cumsum(valid[: len(low)], dtype=np.int8).astype(bool)
    low[~valid] = 0
    high = np.concatenate([np.zeros(SPREAD - 1, np.uint32), low, np.zeros(SPREAD - 1, np.uint32)])
    is_anchor = _slide(high, np.maximum)[: len(h)] == h
    anchor = np.nonzero(is_anchor)[0]
    string = np.nonzero(valid)[0]
    if not len(string):
        return empty, empty, empty
    before = np.cumsum(is_anchor, dtype=np.int32)
    j = before[string] - is_anchor[string]  # the first anchor at or after each string's start
    value, least = h[anchor], low[string]
    todo = np.nonzero(value[j] != least)[0]
    while len(todo):
        j[todo] += 1
        todo = todo[value[j[todo]] != least[todo]]
    cut = np.nonzero((j[1:] != j[:-1]) | (string[1:] != string[:-1] + 1))[0]
    first, last = np.r_[0, cut + 1], np.r_[cut, len(string) - 1]
    return anchor[j[first]], string[first], string[last]


def grams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram bytes as one column of S16, 46-bit hash) at positions."""
    rows = np.ascontiguousarray(buf[at[:, None] + np.arange(GRAM)])
    words = rows.view("<u8")
    with np.errstate(over="ignore"):
        h = words[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (words[:, 1] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return rows.view(f"S{GRAM}")[:, 0], h >> np.uint64(18)


def span_rows(buf: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes [first, first + length), padded with zeros to a fixed width."""
    at = np.minimum(first[:, None] + np.arange(_WIDE), len(buf) - 1)
    rows = buf[at]
    rows[np.arange(_WIDE) >= length[:, None]] = 0
    return rows


def span_hash(rows: np.ndarray, length: np.ndarray, offset: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        words = np.ascontiguousarray(rows).view("<u8")
        words = words ^ (words >> np.uint64(29))
        h = (words * _ODD).sum(axis=1, dtype=np.uint64) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + offset.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(32))


def multikey_groups(words: np.ndarray) -> np.ndarray:
    """Group number of equal rows of words: sorted by the first word, ties by the next, and so on."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.cumsum(np.r_[False, words[order[1:], 0] != words[order[:-1], 0]])
    for k in range(1, words.shape[1]):
        same = group[1:] == group[:-1]
        tied = np.nonzero(np.r_[same, False] | np.r_[False, same])[0]
        if not len(tied):
            break
        word = words[order[tied], k]
        again = np.lexsort((word, group[tied]))
        order[tied] = order[tied][again]
        word, old = word[again], group[tied][again]
        new = np.zeros(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        new[tied[1:]] |= (word[1:] != word[:-1]) & (old[1:] == old[:-1])
        group = np.cumsum(new)
    out = np.empty(len(order), np.int64)
    out[order] = group
    return out


def same_groups(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Group number of equal rows of bytes, told by their hashes and then compared."""
    order = np.argsort(h, kind="stable")
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(np.r_[False, h[order][1:] != h[order][:-1]][: len(h)])
    first = np.zeros(int(group.max()) + 1 if len(h) else 0, np.int64)
    first[group[::-1]] = np.arange(len(h))[::-1]
    for lo in range(0, len(h), 1 << 16):
        if not np.array_equal(rows[lo : lo + (1 << 16)], rows[first[group[lo : lo + (1 << 16)]]]):
            return multikey_groups(np.ascontiguousarray(rows).view(">u8"))  # two rows of one hash differ
    return group


def string_words(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The MATCH bytes from each start as seven big-endian words; the last has two bytes only."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.empty((len(start), 7), np.uint64)
    for lo in range(0, len(start), 1 << 15):  # the places of all bytes of so many strings at once
        at = start[lo : lo + (1 << 15), None].astype(np.int32 if len(padded) < 1 << 31 else np.int64)
        words[lo : lo + (1 << 15)] = padded[at + np.arange(56, dtype=at.dtype)].view(">u8")
    words[:, 6] >>= np.uint64(64 - 8 * (MATCH - 48))
    return words


def string_hash(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = ((words ^ (words >> np.uint64(29))) * _ODD[:7]).sum(axis=1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _unzipped(packed: pd.Series) -> pd.Series:
    unzip = zstandard.ZstdDecompressor()
    return packed.map(lambda z: unzip.decompress(z) if z else b"", na_action=None)


_unzip = once(_unzipped, T.BinaryType())


def exploded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number inside it) of n[i] things of each owner."""
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)


def six_bytes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(values, number of the blob of each)."""
    rows = [np.frombuffer(b, np.uint8).reshape(-1, 6) for b in blobs]
    wide = np.zeros((sum(map(len, rows)), 8), np.uint8)
    wide[:, :6] = np.concatenate(rows)
    return wide.view("<u8")[:, 0], np.repeat(np.arange(len(rows)), [len(x) for x in rows])


class Chunk:
    """The distinct texts of a chunk, in the order of their hashes, with their least ids."""

    def __init__(self, t: pa.Table):
        unzip = zstandard.ZstdDecompressor()
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("thash", "least", "z")), strict=True))
        self.order = [r[0] for r in rows]
        self.z = [r[2] or b"" for r in rows]
        self.texts = [unzip.decompress(z) if z else b"" for z in self.z]
        self.least = np.array([r[1] for r in rows], dtype=np.int64)

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, buffer, starts, ends) runs of about SLICE_BYTES."""
        i = 0
        while i < len(self.texts):
            j, size = i, 0
            while j < len(self.texts) and (size < SLICE_BYTES or j == i):
                size += len(self.texts[j])
                j += 1
            ends = np.cumsum([len(x) for x in self.texts[i:j]])
            yield i, np.frombuffer(b"".join(self.texts[i:j]), np.uint8), np.r_[0, ends[:-1]], ends
            i = j


def _tail(strings: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Eight bytes a span that tell its length and its anchor's place."""
    out = np.zeros((len(strings), 8), np.uint8)
    out[:, 0], out[:, 1] = strings, offset
    return out


def earlier(words: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether an equal string has a smaller id."""
    if not len(words):
        return np.zeros(0, bool)
    group = multikey_groups(words)
    smallest = np.full(group.max() + 1, NO_ID)
    np.minimum.at(smallest, group, least)
    return smallest[group] < least


def _by_range(ranges: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(ranges, kind="stable")
    edge = np.nonzero(np.diff(ranges[order]))[0] + 1
    for part in np.split(order, edge) if len(order) else ():
        yield int(ranges[part[0]]), part


def deal(rows: DataFrame, chunks: int) -> DataFrame:
    """(pid, thash, least, z) of rows (id, text, thash): a task sends a text once, with its least id so far, and
    at its end the ids that turned out smaller, without the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        sent: dict[bytes, int] = {}
        lowered: dict[bytes, int] = {}

        def table(hashes: list[bytes], least: list[int], z: list[bytes | None]) -> pa.RecordBatch:
            pid = [int.from_bytes(h[:8], "little") % chunks for h in hashes]
            return pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), pa.array(hashes, pa.binary()), pa.array(least, pa.int64()), pa.array(z, pa.binary())], ["pid", "thash", "least", "z"])

        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            new: dict[bytes, int] = {}
            for i, (h, doc_id) in enumerate(zip(hashes, ids, strict=True)):
                if h not in sent:
                    sent[h] = doc_id
                    new[h] = i
                elif doc_id < sent[h]:
                    sent[h] = doc_id
                    if h not in new:
                        lowered[h] = doc_id
            texts = batch.column(1).take(pa.array(list(new.values()), pa.int64())).to_pylist()
            yield table(list(new), [sent[h] for h in new], [zip_.compress(x.encode()) if x else b"" for x in texts])
        yield table(list(lowered), list(lowered.values()), [None] * len(lowered))

    return rows.mapInArrow(run, "pid int, thash binary, least long, z binary")


def _keys(key: np.ndarray) -> np.ndarray:
    """The first eight bytes of grams as signed numbers in the order of the bytes."""
    words = np.ascontiguousarray(np.ascontiguousarray(key).view(np.uint8).reshape(-1, GRAM)[:, :8]).view(">u8")[:, 0]
    return (words.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def splitters(rows: DataFrame, total_bytes: int, total_rows: int, ranges: int) -> list[int]:
    """Quantile boundaries of the leading gram bytes at the anchors of a text sample that grows with the ranges.

    Only the boundaries reach the driver."""
    share = max(SAMPLE_TEXTS / max(1, total_rows), KEYS_PER_RANGE * ranges * THIN * SPREAD / 2 / max(1, total_bytes))
    steps = 1 << 30
    some = rows.where(F.pmod(F.xxhash64("thash"), F.lit(steps)) < F.lit(min(steps, int(share * steps) + 1))).dropDuplicates(["thash"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                buf = np.frombuffer(text.encode(), np.uint8)
                at, _, _ = anchors(buf, np.array([0]), np.array([len(buf)]))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(_keys(grams(buf, at[::THIN])[0]))], ["key"])

    cuts = [i / ranges for i in range(1, ranges)]
    if not cuts:
        return []
    keys = some.mapInArrow(run, "key long")
    return sorted(set(keys.agg(F.percentile_approx("key", cuts, max(10_000, 4 * ranges)).alias("e")).first()["e"] or []))


def remove_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(row struct of ``keep`` or doc_id, n_bytes, removed array<struct<start, stop>>, kept binary) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("thash"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    growth = min(GROWTH, max(1.0, (total["b"] / STEADY_BYTES) ** 0.5))
    chunks, ranges = (max(1, -(-total["b"] // int(size * growth))) for size in (CHUNK_BYTES, RANGE_BYTES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(splitters(rows, total["b"], total["n"], ranges), np.int64)
    # the rows of one chunk lie in one partition, so the grouping needs no other shuffle, and the steps below reuse this one
    dealt = deal(rows, chunks).repartition(parts, "pid")
    texts = dealt.groupBy("pid", "thash").agg(F.min("least").alias("least"), F.max("z").alias("z"))

    def place(key: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, _keys(key), side="right")

    def announce(t: pa.Table) -> pa.Table:
        """(range, pid, hashes): distinct 46-bit anchor hashes; the lowest bit is set if two texts of the chunk have it, the next if DENSE do."""
        chunk, pid = Chunk(t), t.column("pid")[0].as_py()
        parts_h, parts_r, parts_d = [], [], []
        for i, buf, starts, ends in chunk.slices():
            at, _, _ = anchors(buf, starts, ends)
            key, h = grams(buf, at)
            parts_h.append(h), parts_r.append(place(key)), parts_d.append(np.searchsorted(ends, at, side="right") + i)
        h, r, d = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (parts_h, parts_r, parts_d))
        order = np.lexsort((d, h))
        h, r, d = h[order], r[order], d[order]
        new = np.r_[True, h[1:] != h[:-1]][: len(h)]
        other = new.copy()
        other[1:] |= d[1:] != d[:-1]
        first = np.nonzero(new)[0]
        texts_with = np.add.reduceat(other.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        value, r = h[first] << np.uint64(2) | (texts_with > 1).astype(np.uint64) | (texts_with >= DENSE).astype(np.uint64) << np.uint64(1), r[first]
        out = [(k, six_bytes(value[part])) for k, part in _by_range(r)]
        return pa.table({"range": pa.array([k for k, _ in out], pa.int32()), "pid": pa.array([pid] * len(out), pa.int32()), "hashes": pa.array([b for _, b in out], pa.binary())})

    announced = texts.groupBy("pid").applyInArrow(announce, "range int, pid int, hashes binary")

    def answer(t: pa.Table) -> pa.Table:
        """(pid, hashes): the anchors of a range that more than one text has, the low bit set if they are hot."""
        pids = t.column("pid").to_numpy()
        value, owner = from_six_bytes(t.column("hashes").to_pylist())
        h, many, dense = value >> np.uint64(2), (value & np.uint64(1)).astype(bool), (value >> np.uint64(1) & np.uint64(1)).astype(np.int64)
        order = np.argsort(h, kind="stable")
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        first, group = np.nonzero(new)[0], np.cumsum(new) - 1
        count, hot = np.empty(len(h), np.int64), np.empty(len(h), np.uint64)
        count[order] = np.diff(np.r_[first, len(h)])[group]
        hot[order] = (np.add.reduceat(dense[order], first) > HOT_CHUNKS)[group]
        said = h << np.uint64(1) | hot | (count > MOST_CHUNKS).astype(np.uint64)
        out = [(int(pids[k]), six_bytes(said[part])) for k, part in _by_range(np.where(many | (count > 1), owner, -1)) if k >= 0]
        return pa.table({"pid": pa.array([p for p, _ in out], pa.int32()), "hashes": pa.array([b for _, b in out], pa.binary())})

    answered = announced.groupBy("range").applyInArrow(answer, "pid int, hashes binary")
    columns = ["a", "b", "c", "d", "e"]
    wire = ", ".join(["to int", "pid int", *[f"{c} binary" for c in columns]])

    def packet(out: list[tuple], pid: int) -> pa.Table:
        cols = [pa.array([o[0] for o in out], pa.int32()), pa.array([pid] * len(out), pa.int32()), *[pa.array([o[i + 1] for o in out], pa.binary()) for i in range(5)]]
        return pa.table(cols, names=["to", "pid", *columns])

    def spans(t: pa.Table, s: pa.Table) -> pa.Table:
        """Rows for ranges (to from 0): the distinct spans of shared anchors; from ``ranges`` on: strings of hot
        anchors by their hash. Rows for the chunk itself (to < 0): where each span lies, and the strings of hot ones."""
        if not t.num_rows or not s.num_rows:
            return packet([], 0)
        chunk, pid = Chunk(t), t.column("pid")[0].as_py()
        shared = np.sort(from_six_bytes(s.column("hashes").to_pylist())[0])
        hot_bit, shared = (shared & np.uint64(1)).astype(bool), shared >> np.uint64(1)
        cols: list[list[np.ndarray]] = [[] for _ in range(8)]
        for i, buf, starts, ends in chunk.slices():
            at, first, last = anchors(buf, starts, ends)
            if not len(at):
                continue
            key, h = grams(buf, at)
            near = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            mine = shared[near] == h
            at, first, last, key, hot = at[mine], first[mine], last[mine], key[mine], hot_bit[near[mine]]
            if not len(at):
                continue
            length = last - first + MATCH
            raw = span_rows(buf, first, length)
            doc = np.searchsorted(ends, first, side="right")
            strings = (last - first + 1).astype(np.uint8)
            for col, x in zip(cols, (span_hash(raw, length, at - first), place(key), doc + i, first - starts[doc], strings, (at - first).astype(np.uint8), raw, hot), strict=True):
                col.append(x)
        if not cols[0]:
            return packet([], 0)
        h, to, doc, first, strings, offset, raw, hot = (np.concatenate(c) for c in cols)
        number = same_groups(h, np.concatenate([raw, _tail(strings, offset)], axis=1))
        order = np.lexsort((doc, chunk.least[doc], number))
        rep = order[np.r_[True, number[order][1:] != number[order][:-1]]]  # of each distinct span, the place in the text of the least id
        out = []
        for k, part in _by_range(np.where(hot[rep], -1, to[rep])):
            if k >= 0:
                x = rep[part]
                data = raw[x][np.arange(_WIDE) < (strings[x].astype(np.int64) + MATCH - 1)[:, None]]
                out.append((k, _pack(part.astype("<u4")), _pack(strings[x]), _pack(offset[x]), _pack(chunk.least[doc[x]].astype("<i8")), _pack(data)))
        out.append((-1 - pid, _pack(number.astype("<u4")), _pack(doc.astype("<u4")), _pack(first.astype("<u4")), _pack(strings), b""))
        which = np.nonzero(hot[rep])[0]
        if len(which):
            x = rep[which]
            who, nth = exploded(strings[x].astype(np.int64))
            start = x[who] * _WIDE + nth
            words = string_words(raw.ravel(), start)
            sh = string_hash(words)
            group = same_groups(sh, words.view(np.uint8).reshape(len(words), -1))
            ids = chunk.least[doc[x]][who]
            best = np.lexsort((ids, group))
            best = best[np.r_[True, group[best][1:] != group[best][:-1]]]  # by group number
            least = ids[best]
            for k, part in _by_range((sh[best] % np.uint64(ranges)).astype(np.int64)):
                out.append((ranges + k, _pack(part.astype("<u4")), b"", b"", _pack(least[part].astype("<i8")), _pack(words[best[part]])))
            out.append((-1 - pid, _pack(which[who].astype("<u4")), _pack(nth.astype(np.uint8)), _pack(group.astype("<u4")), _pack((ids > least[group]).astype(np.uint8)), b"hot"))
        return packet(out, pid)

    sent = texts.groupBy("pid").cogroup(answered.groupBy("pid")).applyInArrow(spans, wire)

    def covered_spans(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sender, number, covered strings as bits) of the spans of a range that smaller ids cover."""
        number, strings, offset, least, data = ([_unpack(b, k) for b in t.column(c).to_pylist()] for c, k in zip("abcde", ("<u4", "u1", "u1", "<i8", "u1"), strict=True))
        owner = np.repeat(np.arange(len(number)), [len(x) for x in number])
        number, strings, offset, least, data = (np.concatenate(x) for x in (number, strings, offset, least, data))
        length = strings.astype(np.int64) + MATCH - 1
        begin = np.cumsum(length) - length
        raw = np.concatenate([span_rows(data, begin[i : i + 65536], length[i : i + 65536]) for i in range(0, len(begin), 65536)])
        of = same_groups(span_hash(raw, length, offset), np.concatenate([raw, _tail(strings, offset)], axis=1))
        order = np.lexsort((least, of))
        rep = order[np.r_[True, of[order][1:] != of[order][:-1]]]  # of equal spans of several chunks, the one with the least id
        every = (np.uint64(1) << strings.astype(np.uint64)) - np.uint64(1)
        who, nth = exploded(strings[rep].astype(np.int64))
        covered = earlier(string_words(data, begin[rep][who] + nth), least[rep][who])
        bits = np.zeros(len(rep), np.uint64)
        np.bitwise_or.at(bits, who[covered], np.uint64(1) << nth[covered].astype(np.uint64))
        return owner, number, np.where(least > least[rep][of], every, bits[of])

    def covered_strings(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sender, number, 1) of the hot strings of a bucket that smaller ids cover."""
        number, least, words = ([_unpack(b, k) for b in t.column(c).to_pylist()] for c, k in zip("ade", ("<u4", "<i8", "<u8"), strict=True))
        owner = np.repeat(np.arange(len(number)), [len(x) for x in number])
        number, least, words = np.concatenate(number), np.concatenate(least), np.concatenate(words).reshape(-1, 7)
        return owner, number, earlier(words, least).astype(np.uint64)

    def compare(t: pa.Table) -> pa.Table:
        """Chunk rows pass; a range returns (pid, number, what is covered) of what smaller ids cover."""
        to = t.column("to")[0].as_py()
        schema = pa.schema([("pid", pa.int32()), *[(c, pa.binary()) for c in columns[:4]], ("kind", pa.string())])
        if to < 0:
            kinds = ["hot" if e else "members" for e in t.column("e").to_pylist()]
            return t.select(["pid", "a", "b", "c", "d"]).append_column("kind", pa.array(kinds)).cast(schema)
        pids = t.column("pid").to_numpy()
        owner, number, mine = (covered_spans if to < ranges else covered_strings)(t)
        out = [(int(pids[k]), _pack(number[part]), _pack(mine[part])) for k, part in _by_range(np.where(mine != 0, owner, -1)) if k >= 0]
        none = [None] * len(out)
        kinds = ["spans" if to < ranges else "strings"] * len(out)
        return pa.Table.from_pydict({"pid": [o[0] for o in out], "a": [o[1] for o in out], "b": [o[2] for o in out], "c": none, "d": none, "kind": kinds}, schema=schema)

    replies = sent.groupBy("to").applyInArrow(compare, "pid int, a binary, b binary, c binary, d binary, kind string")

    def remove(t: pa.Table, r: pa.Table) -> pa.Table:
        chunk = Chunk(t)
        size = np.array([len(x) for x in chunk.texts], dtype=np.int64)
        base = np.cumsum(size) - size
        edge = np.zeros(int(size.sum()) + 1, np.int32)
        got: dict[str, list[tuple]] = {}
        for a, b, c, d, kind in zip(*(r.column(x).to_pylist() for x in ("a", "b", "c", "d", "kind")), strict=True):
            got.setdefault(kind, []).append((a, b, c, d))
        for own in got.get("members", []):
            number, doc, first, strings = (_unpack(x, k).astype(np.int64) for x, k in zip(own, ("<u4", "<u4", "<u4", "u1"), strict=True))
            bits = np.zeros(int(number.max()) + 1, np.uint64)
            for a, b, *_ in got.get("spans", []):
                bits[_unpack(a, "<u4")] = _unpack(b, "<u8")
            for hot in got.get("hot", []):
                span, nth, string, later = (_unpack(x, k).astype(np.int64) for x, k in zip(hot, ("<u4", "u1", "<u4", "u1"), strict=True))
                covered = np.zeros(int(string.max()) + 1, bool)
                for a, *_ in got.get("strings", []):
                    covered[_unpack(a, "<u4")] = True
                on = covered[string] | later.astype(bool)
                np.bitwise_or.at(bits, span[on], np.uint64(1) << nth[on].astype(np.uint64))
            smallest = np.full(len(bits), NO_ID)
            np.minimum.at(smallest, number, chunk.least[doc])
            every = (np.uint64(1) << strings.astype(np.uint64)) - np.uint64(1)
            mask = np.where(chunk.least[doc] > smallest[number], every, bits[number])
            at = base[doc] + first
            whole = mask == every
            np.add.at(edge, at[whole], 1)
            np.add.at(edge, at[whole] + strings[whole] + MATCH - 1, -1)
            part = np.nonzero(~whole & (mask != 0))[0]
            for lo in range(0, len(part), 1 << 16):
                some = part[lo : lo + (1 << 16)]
                row, nth = np.nonzero(np.unpackbits(mask[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                np.add.at(edge, at[some][row] + nth, 1)
                np.add.at(edge, at[some][row] + nth + MATCH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed, kept, zip_ = [], [], zstandard.ZstdCompressor(level=3)
        for i, text in enumerate(chunk.texts):
            mask = gone[base[i] : base[i] + size[i]]
            turn = np.diff(np.r_[False, mask, False].astype(np.int8))
            mine = [{"start": s, "stop": e} for s, e in zip(np.nonzero(turn == 1)[0].tolist(), np.nonzero(turn == -1)[0].tolist(), strict=True)]
            removed.append(mine)
            kept.append(zip_.compress(np.frombuffer(text, np.uint8)[~mask].tobytes()) if mine else chunk.z[i])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({"thash": pa.array(chunk.order, pa.binary()), "least": pa.array(chunk.least, pa.int64()), "cuts": pa.array(removed, kind), "rest": pa.array(kept, pa.binary())})

    found = texts.groupBy("pid").cogroup(replies.groupBy("pid")).applyInArrow(remove, "thash binary, least long, cuts array<struct<start: long, stop: long>>, rest binary")
    # copies meet the result of their text; a text with very many of them is split by adaptive skew handling
    own = [F.col(f"`{c}`") for c in keep or ["doc_id"]]
    asked = docs.select(
        F.struct(*own).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.unhex(F.md5(text)).alias("thash"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    joined = asked.join(found, "thash", "left")
    first, short = F.col("id") == F.col("least"), F.col("n_bytes") < MATCH
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return joined.select(
        "row", "n_bytes",
        F.when(first, F.col("cuts")).when(short, none).otherwise(whole).alias("removed"),
        _unzip(F.when(first | short, F.col("rest"))).alias("kept"),
    )


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[tuple[int, int, int, bytes]]:
    """(n_bytes, n_removed, n_spans, kept) of each document, by a table of all strings; for tests."""
    first: dict[bytes, int] = {}
    raw = [((NO_ID if i is None else i), (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for k in range(len(b) - MATCH + 1):
            s = b[k : k + MATCH]
            first[s] = min(first.get(s, NO_ID), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - MATCH + 1):
            if first[b[k : k + MATCH]] < i:
                gone[k : k + MATCH] = b"\x01" * MATCH
        n_spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), n_spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out
