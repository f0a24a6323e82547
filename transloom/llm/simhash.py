"""Operator 5: SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are made in one narrow pass. Distinct fingerprints meet where three of five bit blocks agree
(two differing bits leave at least three blocks whole), so candidates share some 38 bits at every size.
Candidate groups are compared bit-sliced: the bit planes of the fingerprints are stored vertically, a
carry-save counter adds one plane to the distances of 64 pairs in a few word operations, and a block of
64 pairs is abandoned once all of them exceed the radius. Groups above TILE members are dealt out as pairs
of blocks, so no task holds a large group; each tile reports a spanning forest of its links, and components
are closed over by star contraction.

Defined cases: null and empty texts have fingerprint zero and link like any other; of repeated ids each row
is returned; an all-null component has a null id; a bit set in exactly half the hashes is 0; a very long text is
one row's work, its hashes counted in chunks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from transloom.llm.common import cut, small_batches
from transloom.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
BITS = 64
#: Members of a candidate group that are compared in one tile.
TILE = 256
#: Rows of sorted candidates that are compared at once in a task.
BATCH_ROWS = 1 << 15
#: Shingle hashes whose bits are unpacked at once.
CHUNK = 1 << 16
#: Planes added between two looks for blocks to abandon.
PLANES_PER_LOOK = 8


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_in_shingle)), strict=False)) if len(words) >= words_in_shingle else iter([b" ".join(words)])
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; at most CHUNK of them are unpacked at once."""
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[lo : lo + CHUNK].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words_in_shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(radius: int) -> list[int]:
    """Masks of all sets of three blocks when the bits are cut into radius + 3 blocks."""
    n = radius + 3
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, 3)]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row b holds bit b of every fingerprint."""
    return np.ascontiguousarray(np.unpackbits(fps.view(np.uint8), bitorder="little").reshape(-1, BITS).T)


def within(planes: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Places of the pairs (a[i], b[i]) whose fingerprints differ in at most ``radius`` bits.

    Sixty-four pairs are a lane word: a carry-save counter adds one plane to all their distances in a few word
    operations, and a word is abandoned once all its pairs exceed the radius.
    """
    lanes = np.arange(len(a))
    if not len(lanes):
        return lanes
    width = (radius + 1).bit_length()
    lanes = np.concatenate([lanes, np.repeat(lanes[-1:], -len(lanes) % 64)]).reshape(-1, 64)
    counter = [np.zeros(len(lanes), np.uint64) for _ in range(width)]
    dead = np.zeros(len(lanes), np.uint64)
    for bit in range(BITS):
        plane = planes[bit]
        carry = np.packbits(plane[a[lanes]] ^ plane[b[lanes]], axis=1, bitorder="little").view("<u8")[:, 0]
        for k in range(width):
            carry, counter[k] = carry & counter[k], carry ^ counter[k]
        dead |= carry | _above(counter, radius)
        if bit % PLANES_PER_LOOK == PLANES_PER_LOOK - 1:
            live = dead != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not live.all():
                lanes, dead, counter = lanes[live], dead[live], [c[live] for c in counter]
            if not len(lanes):
                return np.empty(0, np.int64)
    return np.unique(lanes[np.unpackbits(dead.view(np.uint8), bitorder="little").reshape(-1, 64) == 0])


def near_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius`` bits of each other, inside runs of equal ``group``; one lag at a time."""
    planes = bit_planes(fps)
    for lag in range(1, len(fps)):
        first = np.nonzero(group[:-lag] == group[lag:])[0]
        if not len(first):
            return
        found = first[within(planes, first, first + lag, radius)]
        yield found, found + lag


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count exceeds ``radius``."""
    above, same = np.zeros_like(counter[0]), np.full_like(counter[0], 0xFFFFFFFFFFFFFFFF)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same &= counter[k]
        else:
            above |= same & counter[k]
            same &= ~counter[k]
    return above


def forest(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, smallest linked fp) that span the components of every group; rows sorted by group, then fp."""
    parent = np.arange(len(fps))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    for a, b in near_pairs(fps, group, radius):
        for i, j in zip(*(x[parent[a] != parent[b]].tolist() for x in (a, b)), strict=True):
            i, j = find(i), find(j)
            parent[max(i, j)] = min(i, j)
    root = np.array([find(i) for i in range(len(fps))], dtype=np.int64)
    moved = root != np.arange(len(fps))
    return fps[moved], fps[root[moved]]


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(u, v) spanning edges between distinct fingerprints within ``radius`` bits."""
    spark = fps.sparkSession
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(block_masks(radius))])).alias("x")).select("fp", "x.c", "x.k")
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    grouped = keyed.join(sizes, ["c", "k"]).withColumn("parts", F.when(F.col("n") <= 2 * TILE, 1).otherwise(F.ceil(F.col("n") / TILE)).cast("int"))
    grouped = grouped.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiles = grouped.select("c", "k", "own", other.alias("other"), "fp").select("c", "k", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    dealt = tiles.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c", "k", "a", "b").sortWithinPartitions("c", "k", "a", "b", F.col("fp"))
    dealt = dealt.select(F.xxhash64("c", "k", "a", "b").alias("tile"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def compare(tile: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            u, v = forest(np.ascontiguousarray(fp).view(np.uint64), tile, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            tile, fp = np.concatenate([tile, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy()])
            if len(tile) >= BATCH_ROWS:  # compare all but the last run, which may go on
                whole = int(np.nonzero(tile != tile[-1])[0][-1]) + 1 if (tile != tile[-1]).any() else 0
                if whole:
                    yield compare(tile[:whole], fp[:whole])
                    tile, fp = tile[whole:], fp[whole:]
        if len(tile):
            yield compare(tile, fp)

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links."""
    rows = cut(fingerprints(docs, words_in_shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    closed = components(links(fps.select("fp"), radius))
    labelled = fps.join(closed, fps["fp"] == closed["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(least, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")
