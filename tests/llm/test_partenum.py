import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from transloom.llm import groups, near_copies, partenum
from transloom.llm.components import components
from transloom.llm.partenum import band, instance, join_components, shingles, signatures

SCHEMA = "doc_id long, text string"


def brute(rows):
    """(doc_id, set size, least id of the component) by meeting all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    having = defaultdict(list)
    for i, s in enumerate(sets):
        for f in s:
            having[f].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for f in s:
            for j in having[f]:
                common[j] += j < i
        for j, n in common.items():
            if j < i and 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def result(df):
    return sorted((tuple(r) for r in join_components(df).collect()), key=str)


def similar_sets(rng, n):
    """Two sets at a similarity of 0.8 or little more, the first of ``n`` features."""
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    while True:
        drop, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
        if 5 * (n - drop) >= 4 * (n + add) > 0:
            b = np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
            return np.unique(a), np.unique(b)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for n in [*range(4, 60), 100, 200, 333, 1000, 5000]:
        for _ in range(60 if n < 400 else 10):
            a, b = similar_sets(rng, n)
            assert np.array_equal(a, b) or np.intersect1d(signatures(a), signatures(b)).size, (n, len(a), len(b))


def test_unlike_sets_rarely_share_one():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 250, dtype=np.uint64)
        b = np.concatenate([a[:30], rng.integers(0, 1 << 63, 220, dtype=np.uint64)])
        met += bool(np.intersect1d(signatures(np.unique(a)), signatures(np.unique(b))).size)
    assert met < 60


def test_cells_never_rule_out_a_link(spark):
    rng = np.random.default_rng(6)
    sets = [x for n in (4, 9, 40, 300, 5000) for _ in range(20) for x in similar_sets(rng, n)]
    sets += [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(20)]
    nodes = spark.createDataFrame([(i, len(s), bytearray(partenum.cells(s).tobytes())) for i, s in enumerate(sets)], "node long, size int, cells binary")
    pairs = [(i, i + 1) for i in range(0, len(sets), 2)]
    kept = {tuple(r) for r in partenum.differ_little(spark.createDataFrame(pairs, "u long, v long"), nodes).collect()}
    assert kept == set(pairs[:100])


def test_bands_and_instances():
    for size in range(1, 3000):
        nth, low, high = band(size)
        assert low <= size <= high and 4 * high <= 5 * low
        assert band(size * 5 // 4)[0] in (nth, nth + 1)
        differences, partitions = instance(low, high)
        larger = high * 5 // 4
        assert 9 * differences <= high + larger < 9 * (differences + 1) and 2 * partitions > differences


def texts(seed):
    """Clean texts, near copies at many similarities, copies, and texts of one template."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(rng.choice([3, 5, 9, 20, 60, 150]))] for _ in range(60)]
    out = list(base)
    for _ in range(200):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(b) // 30))):
            b[rng.randrange(len(b))] = word()
        out.append(b if rng.random() < 0.6 else b + [word() for _ in range(rng.randint(0, len(b) // 6 + 1))])
    template = [word() for _ in range(60)]
    out += [template[:30] + [word() for _ in range(rng.randint(8, 20))] + template[30:] for _ in range(80)]
    return [" ".join(w).upper() if rng.random() < 0.1 else rng.choice([" ", "\n", "\t "]).join(w) for w in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = list(enumerate(texts(seed)))
    random.Random(seed).shuffle(rows)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(6)) == brute(rows)


def test_small_blocks_and_prefixes(spark, monkeypatch):
    """Packets of several blocks, hot signatures, a second hub, and every group of over three members by prefixes."""
    rows = list(enumerate(texts(3)))
    monkeypatch.setattr(partenum, "BLOCK_ROWS", 7)
    monkeypatch.setattr(partenum, "HOT", 2)
    monkeypatch.setattr(groups, "HUBS", 2)
    monkeypatch.setattr(partenum, "TILE", 3)
    monkeypatch.setattr(groups, "PAIRS_PER_COPY", 3)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(odd) == brute(rows)
    assert result(empty) == []
    clash = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y"), (3, None, 3, "z")], SCHEMA + ", node int, key string")
    assert result(clash) == [(1, 2, 1), (2, 2, 1), (3, 0, 3)]
    # a long text, and its copy with a word changed
    long = [f"w{i}" for i in range(60_000)]
    other = [*long[:30_000], "new", *long[30_001:]]
    assert result(spark.createDataFrame([(7, " ".join(long)), (4, " ".join(other))], SCHEMA)) == [(4, 59996, 4), (7, 59996, 4)]


def test_a_third_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = [(i, " ".join(base[:j] + [f"n{i}"] + base[j + 1 :])) for i in range(400) for j in [rng.randrange(120)]]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(100))) for i in range(800)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_templates_do_not_meet_pair_by_pair(spark, monkeypatch):
    """Texts of one template that are not similar: pairs compared grow with their number, not with its square."""
    asked = []
    real = groups.similar
    monkeypatch.setattr(groups, "similar", lambda pairs, sets: (asked.append(pairs.count()), real(pairs, sets))[1])
    rng = random.Random(4)
    template = [f"t{i}" for i in range(60)]
    for n in (200, 400):
        rows = [(i, " ".join(template[:30] + [f"x{rng.randrange(10**9)}" for _ in range(rng.randint(15, 40))] + template[30:])) for i in range(n)]
        rows = [(i, t, i, shingles(t)) for i, t in rows]
        nodes = spark.createDataFrame([(i, len(s), s.view(np.int64).tolist(), near_copies.buckets(s), near_copies.majority(s) - (1 << 64) if near_copies.majority(s) >> 63 else near_copies.majority(s)) for i, _, _, s in rows], "node long, size int, set array<long>, keys array<long>, fp long")
        asked.clear()
        found = groups.links(nodes.select("node", "size", F.explode("keys").alias("key")).select("key", "node", "size"), nodes.select("node", "set"), most_blocks=0)
        assert components(found).count() == 0
        assert sum(asked) < 40 * n
    assert shingles(None).size == 0


def test_the_sql_agrees(spark, tmp_path):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    df = join_components(spark.read.parquet(f"{folder}/documents.parquet"))
    query = con.sql(partenum.SQL)
    assert query.columns == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(query.fetchall(), key=str)


def test_tiles_connect_what_pairs_do(spark):
    """Near copies about the limit, in one group: the same components by one tile, by many tiles and by prefixes."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    sets = []
    for i in range(150):
        words = list(base)
        for j in rng.sample(range(100), rng.randint(0, 3)):
            words[j] = f"n{i}_{j}" if rng.random() < 0.7 else f"m{j}"
        sets.append(shingles(" ".join(words)))
    similar = [(a, b) for a in range(150) for b in range(a) if 5 * (c := np.intersect1d(sets[a], sets[b]).size) >= 4 * (len(sets[a]) + len(sets[b]) - c)]
    assert 0 < len(similar) < 150 * 149 // 4

    def closed(pairs):
        of = list(range(150))
        for _ in range(150):
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        return of

    alone = np.arange(150)
    assert closed(groups.forest(alone, sets)) == closed(similar) and len(groups.forest(alone, sets)) < 150
    assert groups.forest(np.zeros(3, np.int64), sets[:3]) == [] and groups.forest(alone[:2], [sets[0], sets[0] + 1]) == []
    rows = spark.createDataFrame([(1, i, len(x), x.view(np.int64).tolist()) for i, x in enumerate(sets)], "key long, node long, size int, set array<long>")
    for block, most in ((512, 64), (20, 64), (20, 0)):
        old, groups.BLOCK = groups.BLOCK, block
        try:
            found = groups.links(rows.select("key", "node", "size"), rows.select("node", "set"), most_blocks=most)
            assert closed([(r["u"], r["v"]) for r in found.collect()]) == closed(similar)
        finally:
            groups.BLOCK = old
