"""Operator 13: n-gram Jaccard join by PartEnum signatures.

Sets are put into bands of sizes, each reaching up to 5/4 of its least size, so that similar sets lie in one band or in two
neighbouring ones. An instance of the signatures serves a band and the next one; sets of its pairs differ in at most
``differences`` features. It cuts the feature domain by hash into first-level partitions, at least one more than half the
differences, so that in some of them two similar sets differ in one feature at most; each is cut into three parts, and the
three subsets of two parts are enumerated: one of them is free of differences and gives both sets one signature, a hash of
their features in it. So every similar pair shares a signature. Documents that share a signature form a group that is named after the least
of them, and all that are in one group are compared exactly (``groups``).

A subset without features would be a signature of many sets. Each instance has some more partitions than it needs (slack);
a set with no more partitions with an empty subset than the slack leaves those signatures out. A pair then still shares one,
since one of the partitions in question has no empty subset; only if both sets have more empty ones can the shared signature
be empty, and both write them.

Documents are read once. A task hashes whole texts and packs the signatures of a block of documents into one packet for each
bucket of signatures, six bytes a signature; of a signature that HOT rows of a block share, one row goes to the bucket,
so a signature that a third of all documents share is one entry of each block. Buckets follow the size of the input.
Their tasks tell which rows share signatures; only those go on.

Defined cases: words are runs without ASCII white space, ASCII letters lowered; a text of fewer than five words is one
shingle; null texts and texts without words have an empty set and are linked with nothing; rows that share an id are judged
by their texts and each returned; a component whose ids are all null has a null id; equal sets are linked; a very long text is
one row's work; columns beyond doc_id and text are ignored, whatever their names; an empty table gives an empty result.
Shingles are told apart by 64-bit hashes and equal sets by a 128-bit hash of these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh64_intdigest

from transloom.llm.common import among, cut, drop_shuffles, small_batches, written
from transloom.llm.components import components
from transloom.llm.groups import DENOMINATOR, NUMERATOR, links
from transloom.sources.shared import delete, new_folder

SHINGLE_WORDS = 5
SEED = 42
#: Parts of a first-level partition, and the pairs of them that are enumerated.
PARTS = 3
SUBSETS = ((0, 1), (0, 2), (1, 2))
#: Sets of fewer features get no slack: their subsets are often empty whatever the partitions.
LEAST_SLACK_SIZE = 40
#: Share of the smallest sets of an instance that may write empty signatures.
MOST_EMPTY = 0.03
#: Documents and signatures of a block at most (a text of more is a block of its own).
BLOCK_ROWS, BLOCK_SIGNATURES = 1 << 16, 1 << 21
#: Bytes of text whose signatures share a bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 64
#: Rows of a block that share a signature and no longer go into its packet one by one.
HOT = 32
#: Bits of a signature that a packet holds; the others choose the bucket.
PACKET_BITS = 32

#: Cells of the feature domain in which a set's features are counted, up to 255 each.
CELLS = 256
#: Members of a group whose counts are compared in one task; larger groups are left to an exact prefix filter.
TILE = 1024

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; empty for a text without words."""
    words = (text or "").encode().lower().split()
    k = SHINGLE_WORDS
    if not words:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64))


@cache
def band(size: int) -> tuple[int, int, int]:
    """(number, least size, largest size) of the band of sets of this size."""
    nth, low = 0, 1
    while (high := max(low, low * DENOMINATOR // NUMERATOR)) < size:
        nth, low = nth + 1, high + 1
    return nth, low, high


@cache
def instance(low: int, high: int) -> tuple[int, int]:
    """(differences, first-level partitions) for pairs of a set of ``low`` to ``high`` features and one as large or larger."""
    larger = high * DENOMINATOR // NUMERATOR
    differences = (high + larger) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
    least = differences // 2 + 1
    if low < LEAST_SLACK_SIZE:
        return differences, least

    def too_many(partitions: int) -> float:
        """The share of the smallest sets that have more partitions with an empty subset than the slack."""
        mean = partitions * len(SUBSETS) * math.exp(-low / partitions * (PARTS - 1) / PARTS)
        return 1 - sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(partitions - least + 1))

    choices = range(least, least + least // 2 + 2)
    partitions = next((p for p in choices if too_many(p) <= MOST_EMPTY), None) or min(choices, key=too_many)
    return differences, partitions


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _signatures_of(features: np.ndarray, nth: int, low: int, high: int) -> np.ndarray:
    differences, partitions = instance(low, high)
    if not differences:
        return np.empty(0, np.uint64)  # only equal sets
    spread = _mixed(features + np.uint64(nth + 1) * _ODD[2:3]) >> np.uint64(32)
    slot = ((spread * np.uint64(partitions * PARTS)) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(partitions * PARTS, np.uint64)
    np.add.at(sums, slot, features)
    filled = (np.bincount(slot, minlength=partitions * PARTS) > 0).reshape(partitions, PARTS)
    sums = sums.reshape(partitions, PARTS)
    names = (np.arange(partitions, dtype=np.uint64) + np.uint64(nth << 32)) * _ODD[3]
    out = np.stack([_mixed(_mixed(sums[:, a] + names) + _mixed(sums[:, b] * _ODD[4] + np.uint64(i + 1) * _ODD[5:6])) for i, (a, b) in enumerate(SUBSETS)], axis=1)
    some = np.stack([filled[:, a] | filled[:, b] for a, b in SUBSETS], axis=1)
    if (~some).any(axis=1).sum() > partitions - differences // 2 - 1:
        return out.ravel()
    return out[some]


def signatures(features: np.ndarray) -> np.ndarray:
    """64-bit signatures of a set: those of its band's instance and of the one below."""
    if not len(features):
        return np.empty(0, np.uint64)
    nth, low, high = band(len(features))
    out = [_signatures_of(features, nth, low, high)]
    if nth:
        _, low, high = band(low - 1)
        out.append(_signatures_of(features, nth - 1, low, high))
    return np.concatenate(out)


_NAMES = ["kind", "rid", "doc_id", "text", "digest", "n", "bucket", "packet", "key", "cells"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
_SCHEMA = "kind string, rid long, doc_id long, text string, digest binary, n long, bucket int, packet binary, key long, cells binary"


def _rows(count: int, name: str, **columns) -> pa.RecordBatch:
    arrays = [pa.array([name] * count) if c == "kind" else pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(count, t)) for c, t in zip(_NAMES, _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _packets(found: np.ndarray, of: np.ndarray, base: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The packets of a block's signatures (``of``: the row of each, falling never); those that HOT of its rows share go apart,
    the first one to its bucket and all of them as members."""
    low = found & np.uint64((1 << PACKET_BITS) - 1)
    bucket = (found >> np.uint64(PACKET_BITS)) % np.uint64(buckets)
    order = np.lexsort((of, low, bucket))
    low, bucket, of = low[order], bucket[order], of[order]
    first = np.nonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])]))[0]
    many = np.diff(np.append(first, len(low)))
    hot = np.repeat(many >= HOT, many)
    if hot.any():
        lead = first[many >= HOT]
        yield _rows(len(lead), "lead", rid=base + of[lead], bucket=bucket[lead].astype(np.int32), key=low[lead].astype(np.int64))
        yield _rows(int(hot.sum()), "member", rid=base + of[hot], bucket=bucket[hot].astype(np.int32), key=low[hot].astype(np.int64))
    low, bucket, of = low[~hot], bucket[~hot], of[~hot]
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    full = np.nonzero(np.diff(edges))[0]
    blobs = []
    for b in full:
        part = slice(edges[b], edges[b + 1])
        order = np.argsort(of[part], kind="stable")
        x, rows = low[part][order], of[part][order]
        blobs.append(np.diff(rows, prepend=0).astype("<u2").tobytes() + x.astype("<u4").tobytes())
    yield _rows(len(full), "packet", rid=np.full(len(full), base), bucket=full.astype(np.int32), packet=blobs)


def _opened(base: int, packet: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(rows, signature bits) of a packet."""
    n = len(packet) // 6
    return base + np.cumsum(np.frombuffer(packet, "<u2", n).astype(np.int64)), np.frombuffer(packet, "<u4", n, 2 * n)


def _signed(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows, packets and in-block members of all documents, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        found: list[np.ndarray] = []
        of: list[int] = []
        seen: set[bytes] = set()
        rows = total = 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal base, found, of, seen, rows, total
            if total:
                yield from _packets(np.concatenate(found), np.repeat(of, [len(x) for x in found]), base, buckets)
            base, found, of, seen, rows, total = base + rows, [], [], set(), 0, 0

        for batch in batches:
            sizes, digests, rids, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                features = shingles(text)
                digest = xxh3_128_digest(features.tobytes(), SEED)
                if digest not in seen:
                    x = signatures(features)
                    if rows and (rows == BLOCK_ROWS or total + len(x) > BLOCK_SIGNATURES):
                        yield from block()
                    seen.add(digest)
                    found.append(x)
                    of.append(rows)
                    total += len(x)
                elif rows == BLOCK_ROWS:
                    yield from block()
                    seen.add(digest)
                    found.append(x := signatures(features))
                    of.append(rows)
                    total += len(x)
                sizes.append(len(features))
                digests.append(digest)
                counts.append(cells(features).tobytes())
                rids.append(base + rows)
                rows += 1
            yield _rows(batch.num_rows, "row", rid=rids, doc_id=batch.column(0), text=batch.column(1), digest=digests, n=sizes, cells=counts)
        yield from block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def _repeated(packets: DataFrame) -> DataFrame:
    """(hub, rid, bucket, key) of the signatures that several rows share: the hub is the least of these rows. Only what leads
    a hot signature of a block has its bucket and key, to which the block's other rows are joined."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        leads: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            table = batch.filter(batch.column("packet").is_valid())
            parts += [_opened(b, p) for b, p in zip(table.column("rid").to_pylist(), table.column("packet").to_pylist(), strict=True)]
            table = batch.filter(batch.column("packet").is_null())
            leads.append((table.column("rid").to_numpy(), table.column("key").to_numpy().astype(np.uint32)))
        rows, bits = (np.concatenate(x) for x in zip(*parts, *leads, strict=True))
        leading = np.repeat([False, True], [sum(len(x) for x, _ in parts), sum(len(x) for x, _ in leads)])
        del parts, leads
        order = np.lexsort((rows, bits))
        rows, bits, leading = rows[order], bits[order], leading[order]
        first = np.nonzero(np.concatenate([[True], bits[1:] != bits[:-1]]))[0]
        many = np.diff(np.append(first, len(bits)))
        hub = np.repeat(rows[first], many)
        told = leading.copy()
        rest = ~told & (hub != rows)
        pairs = np.unique(np.stack([hub[rest], rows[rest]], axis=1), axis=0) if rest.any() else np.empty((0, 2), np.int64)
        bucket = key[0].as_py()
        n, m = len(pairs), int(told.sum())
        columns = [np.concatenate([pairs[:, 0], hub[told]]), np.concatenate([pairs[:, 1], rows[told]])]
        names = pa.array([None] * n + [bucket] * m, pa.int32()), pa.array([None] * n + bits[told].astype(np.int64).tolist(), pa.int64())
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *names], ["hub", "rid", "bucket", "key"])

    return packets.select("bucket", "rid", "packet", "key").groupBy("bucket").applyInArrow(run, "hub long, rid long, bucket int, key long")


def cells(features: np.ndarray) -> np.ndarray:
    """How many features fall into each of CELLS cells of the domain; counts that are cut off differ no more than whole ones."""
    return np.minimum(np.bincount((_mixed(features * _ODD[7]) >> np.uint64(56)).astype(np.int64), minlength=CELLS), 0xFF).astype(np.uint8)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _set(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts])


def differ_little(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` but those whose cell counts prove that too many features differ: the distance of the counts of
    two sets is at most the number of features that only one of them has. ``nodes`` is (node, size, cells)."""
    end = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("cells").alias(f"cells_{x}"))
    both = pairs.join(end("u"), "u").join(end("v"), "v").select("u", "v", (F.col("size_u") + F.col("size_v")).alias("sizes"), "cells_u", "cells_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for i in (3, 4))
            near = (DENOMINATOR + NUMERATOR) * np.abs(a - b).sum(axis=1, dtype=np.int64) <= (DENOMINATOR - NUMERATOR) * batch.column(2).to_numpy()
            yield batch.select(["u", "v"]).filter(pa.array(near))

    return both.mapInArrow(run, "u long, v long")


def _near_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows (size, cells) of a group that cell counts do not tell apart."""
    size = table.column("size").to_numpy()
    x = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
    out = []
    for i in range(len(x) - 1):
        near = (DENOMINATOR + NUMERATOR) * np.abs(x[i + 1 :] - x[i]).sum(axis=1, dtype=np.int32) <= (DENOMINATOR - NUMERATOR) * (size[i + 1 :] + size[i])
        out.append(np.nonzero(near)[0] + i + 1)
    return np.repeat(np.arange(len(out)), [len(o) for o in out]), np.concatenate(out) if out else np.empty(0, np.int64)


def close_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``members`` that cell counts leave a partner in their group; groups of over TILE members stay whole."""
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key")

    def run(table: pa.Table) -> pa.Table:
        return table.select(["key", "node", "size"]).take(pa.array(np.unique(np.concatenate(_near_pairs(table)))))

    few = sized.where(F.col("n") <= TILE).join(nodes.select("node", "cells"), "node").select("key", "node", "size", "cells")
    few = few.groupBy("key").applyInArrow(run, "key long, node long, size long")
    return few.unionByName(sized.where(F.col("n") > TILE).select("key", "node", F.col("size").cast("long").alias("size")))


def close_across(tiled: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``tiled`` (key, i, j, node, size, root) that cell counts leave a partner of another component in their tile."""

    def run(table: pa.Table) -> pa.Table:
        root = table.column("root").to_numpy()
        a, b = _near_pairs(table)
        apart = root[a] != root[b]
        keep = np.unique(np.concatenate([a[apart], b[apart]]))
        return table.select(["key", "i", "j", "node", "size", "root"]).take(pa.array(keep))

    rows = tiled.join(nodes.select("node", "cells"), "node").select("key", "i", "j", "node", F.col("size").cast("long").alias("size"), "root", "cells")
    return rows.groupBy("key", "i", "j").applyInArrow(run, "key long, i int, j int, node long, size long, root long")


def join_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id reachable over similar sets."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    path = new_folder(spark, "signatures")
    _signed(docs, buckets).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    kind = lambda name: spark.read.schema(_SCHEMA).parquet(path).where(F.col("kind") == name)
    rows = kind("row").select("rid", "doc_id", "digest", "n")
    # one row of each set stands for it
    one = rows.where("n > 0").groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"), F.first("n").alias("size"))
    one = cut(one)
    repeated = written(_repeated(kind("packet").unionByName(kind("lead"))).distinct())
    delete(spark, f"{path}/kind=packet")
    drop_shuffles(spark)
    hot = kind("member").select("bucket", "key", F.col("rid").alias("row"))
    led = repeated.where("key IS NOT NULL").select("bucket", "key", "hub").distinct().join(hot, ["bucket", "key"]).select("hub", F.col("row").alias("rid"))
    met = written(repeated.select("hub", "rid").unionByName(led).where("hub <> rid").distinct())
    wanted = met.select(F.explode(F.array("hub", "rid")).alias("rid")).distinct()
    named = written(among(kind("row").select("rid", "digest", "cells"), wanted, "rid").join(one.drop("least"), "digest").select("rid", "node", "size", "cells"))
    ends = met.join(named.select(F.col("rid").alias("hub"), F.col("node").alias("key")), "hub").join(named, "rid").where("key <> node").select("key", "node", "size")
    hubs = ends.select("key").distinct().join(one.select(F.col("node").alias("key"), "size"), "key").select("key", F.col("key").alias("node"), "size")
    # equal sets have equal counts, so any row of a set will do
    nodes = written(named.groupBy("node").agg(F.first("size").alias("size"), F.first("cells").alias("cells")))
    members = written(close_members(written(ends.unionByName(hubs).distinct()), nodes))
    texts = among(kind("row").select(F.col("rid").alias("node"), "text"), members.select("node"), "node")
    sets = written(texts.select("node", _set("text").alias("set")))
    drop_shuffles(spark)
    found = links(members, sets, lambda pairs: differ_little(pairs, nodes), lambda tiled: close_across(tiled, nodes))
    closed = components(found)
    labelled = one.join(closed, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = labelled.join(least, "root").select("digest", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(of_set, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


#: DuckDB SQL for the registered query: all pairs that share a shingle, closed over by recursion.
SQL = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS x FROM d),
f AS (SELECT r, len(x) AS n, unnest(x) AS feature FROM s),
p AS (SELECT a.r AS u, b.r AS v FROM f a JOIN f b ON a.feature = b.feature AND a.r < b.r AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
    GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
reach AS (SELECT r AS u, r AS v FROM s UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v)
SELECT any_value(a.doc_id) AS doc_id, any_value(len(a.x))::BIGINT AS n_shingles, min(b.doc_id) AS component_id
FROM reach JOIN s a ON a.r = reach.u JOIN s b ON b.r = reach.v GROUP BY a.r
"""
