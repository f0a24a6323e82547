"""Operator 7: packing token sequences by non-negative least squares over length combinations.

Texts are tokenised once into a table in the shared folder. Whole windows of a long text are sequences of
their own; what remains of each text is a piece of less than a window. Piece lengths are counted in bins,
shallow combinations of two to four bins that fill a window are enumerated, and non-negative least squares
solves how often each is repeated to explain the counts. The solution is rounded down to what the bins
hold, pieces are ranked inside their bin on Spark and take the places of the combinations; the last piece
of a place is cut where the window is full. Pieces without a place and the cut ends are then packed greedily:
laid end to end by an exact prefix sum and cut at every window, so that only the very last sequence is padded.

Only bin counts (window / BIN rows) and combinations reach the driver. Defined cases: a null or empty text
is the end token alone; repeated ids and repeated rows are separate rows; rows of one length (ties) are placed in the
order of their row numbers; a very long text is one row's work, and its words may be of any length; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transloom.llm.bpe import encoder
from transloom.llm.common import small_batches, written

WINDOW = 4096
END_ID = 2
#: Tokens in a length bin.
BIN = 32
#: Combinations of four use bins that are multiples of this.
COARSE = 4
#: Hash cells for exact distributed prefix sums, and for ranks inside each bin: (at least, at most). Between them their
#: number follows the rows, about CELL_ROWS to a cell.
CELLS = 512, 1 << 16
RANK_CELLS = 64, 1 << 12
CELL_ROWS = 50_000


def tokenise(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(row, doc_id, n, ids binary): ids of 16 bits each where the vocabulary fits, else of 32."""
    small_batches(docs.sparkSession)
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        end = np.array([END_ID], words.kind)
        for batch in batches:
            at = 0
            for offsets, flat in words.encode_many(batch.column(2).to_pylist()):
                size = np.diff(offsets) + 1
                ids = np.insert(flat, offsets[1:], end)
                bounds = np.r_[0, np.cumsum(size)] * ids.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(size)), batch.column(1).slice(at, len(size)), pa.array(size, pa.int64()), packed], ["row", "doc_id", "n", "ids"])
                at += len(size)
        words.forget()

    return written(base.mapInArrow(run, "row long, doc_id long, n long, ids binary"))


def cells_for(rows: int, bounds: tuple[int, int]) -> int:
    return max(bounds[0], min(bounds[1], rows // CELL_ROWS))


def prefix_sum(df: DataFrame, amount: str, out: str, n_cells: int) -> DataFrame:
    """Add the exclusive running sum of ``amount`` over all rows, in the order of (hash cell, row)."""
    df = df.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(n_cells)))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    cells = df.groupBy("cell").agg(F.sum(amount).alias("of_cell")).select("cell", F.coalesce(F.sum("of_cell").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("cell").orderBy("row")
    return df.join(F.broadcast(cells), "cell").withColumn(out, F.col("base") + F.sum(amount).over(inside) - F.col(amount)).drop("cell", "base")


def combinations(window: int = WINDOW, bin_size: int = BIN) -> list[tuple[int, ...]]:
    """Sorted tuples of two to four bins that sum to a window."""
    total = window // bin_size
    out = [(a, total - a) for a in range(1, total // 2 + 1)]
    out += [(a, b, total - a - b) for a in range(1, total // 3 + 1) for b in range(a, (total - a) // 2 + 1)]
    for a, b, c in combinations_with_replacement(range(COARSE, total, COARSE), 3):
        if total - a - b - c >= c:
            out.append((a, b, c, total - a - b - c))
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, steps: int = 600) -> np.ndarray:
    """Active-set minimiser of |a x - b| over x >= 0."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, right = a.T @ a, a.T @ b
    for _ in range(steps):
        gain = np.where(active, -np.inf, right - gram @ x)
        if gain.max() <= 1e-10 * max(1.0, np.abs(b).max()):
            break
        active[int(gain.argmax())] = True
        while active.any():
            at = np.nonzero(active)[0]
            s = np.linalg.solve(gram[np.ix_(at, at)] + 1e-12 * np.eye(len(at)), right[at])
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            worst = s <= 0
            step = (x[at][worst] / np.maximum(x[at][worst] - s[worst], 1e-300)).min()
            x[at] += step * (s - x[at])
            x[at[x[at] <= 1e-12]] = 0
            active &= x > 0
    return x


def plan(counts: dict[int, int], window: int = WINDOW, bin_size: int = BIN) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(places, sequences). A place: (bin, first rank, end rank, first sequence, slots, first slot)."""
    found = [c for c in combinations(window, bin_size) if all(counts.get(b, 0) for b in c)]
    if not found:
        return [], 0
    a = np.zeros((window // bin_size, len(found)))
    for j, c in enumerate(found):
        for b in c:
            a[b, j] += 1
    held = np.array([counts.get(b, 0) for b in range(window // bin_size)], dtype=float)
    x = non_negative_least_squares(a, held / held.sum()) * held.sum()
    left, used = held.astype(np.int64), dict.fromkeys(counts, 0)
    places, sequences = [], 0
    for j in np.argsort(-x, kind="stable"):
        need = a[:, j].astype(np.int64)
        times = int(min(np.floor(x[j] + 1e-9), (left[need > 0] // need[need > 0]).min()))
        if times < 1:
            continue
        slot = 0
        for b in np.nonzero(need)[0].tolist():  # the largest bin comes last
            m = int(need[b])
            places.append((b, used[b], used[b] + m * times, sequences, m, slot))
            used[b] += m * times
            left[b] -= m * times
            slot += m
        sequences += times
    return places, sequences


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece; ids are 32-bit little-endian."""
    spark = docs.sparkSession
    tokens = tokenise(docs, tokenizer_path)
    rows = tokens.select("row", "n", F.floor(F.col("n") / window).alias("whole"), (F.col("n") % window).alias("rest"))
    whole, n_rows = rows.agg(F.coalesce(F.sum("whole"), F.lit(0)), F.count("*")).first()
    n_cells = cells_for(n_rows, CELLS)
    rests = rows.where("rest > 0").withColumn("bin", F.floor(F.col("rest") / BIN).cast("int"))
    counts = {r["bin"]: r["count"] for r in rests.groupBy("bin").count().collect()}
    places, sequences = plan(counts, window)

    full = prefix_sum(rows.where("whole > 0"), "whole", "first", n_cells).select("row", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("whole") - 1)).alias("i", "sequence_id"))
    full = full.select("row", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "sequence_id", F.lit(0).cast("long").alias("offset"))

    salted = rests.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(cells_for(max(counts.values(), default=0), RANK_CELLS))))
    before = Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = salted.groupBy("bin", "salt").agg(F.count("*").alias("held")).select("bin", "salt", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    ranked = salted.join(F.broadcast(cells), ["bin", "salt"])  # at most bins x 4,096 rows
    ranked = ranked.withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("bin", "salt").orderBy("row")) - 1)
    place = spark.createDataFrame(places, "place_bin int, lo long, hi long, seq0 long, slots int, slot0 int")
    placed = ranked.join(F.broadcast(place), (F.col("bin") == F.col("place_bin")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    placed = placed.select(
        "row", (F.col("whole") * window).alias("start"), F.col("rest").alias("length"),
        (whole + F.col("seq0") + F.floor((F.col("rank") - F.col("lo")) / F.col("slots"))).alias("sequence_id"),
        (F.col("slot0") + (F.col("rank") - F.col("lo")) % F.col("slots")).alias("slot"),
    )
    fitted = placed.where("sequence_id is not null")
    fitted = fitted.withColumn("offset", F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length"))
    fitted = fitted.withColumn("fits", F.least("length", window - F.col("offset")))
    pieces = fitted.select("row", "start", F.col("fits").alias("length"), "sequence_id", "offset")
    ends = fitted.where("fits < length").select("row", (F.col("start") + F.col("fits")).alias("start"), (F.col("length") - F.col("fits")).alias("length"))
    loose = placed.where("sequence_id is null").select("row", "start", "length").unionByName(ends)
    laid = prefix_sum(loose, "length", "at", n_cells)
    laid = laid.select("row", "start", "length", "at", F.explode(F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window))).alias("seq"))
    lo, hi = F.greatest(F.col("at"), F.col("seq") * window), F.least(F.col("at") + F.col("length"), (F.col("seq") + 1) * window)
    greedy = laid.select("row", (F.col("start") + lo - F.col("at")).alias("start"), (hi - lo).alias("length"), (whole + sequences + F.col("seq")).alias("sequence_id"), (lo - F.col("seq") * window).alias("offset"))

    parts = full.unionByName(pieces).unionByName(greedy)
    parts = parts.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))  # a text's own pieces
    joined = tokens.join(parts, "row").select("doc_id", "n", "ids", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, n, ids, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                out += [(doc_id, p["start"], p["length"], wide[p["start"] : p["start"] + p["length"]].tobytes(), n, p["sequence_id"], p["offset"]) for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return joined.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
