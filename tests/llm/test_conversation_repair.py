import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from transloom.llm import conversation_repair
from transloom.llm.conversation_repair import SQL, edits, joined, repair, segment

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(cost, audit, repaired) of (role, text, must go, truncated) rows by trying every edit of every row and gap."""
    found = []
    for letters in itertools.product("DKR", repeat=len(rows)):
        if any(r[2] and x != "D" for r, x in zip(rows, letters, strict=True)):
            continue
        for gaps in itertools.product((0, 1, 2) if len(rows) < 4 else (0, 1), repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            write = lambda text: out.append(("assistant" if out and out[-1][0][:1] == "u" else "user", text))  # noqa: B023, E731
            for i in range(len(rows) + 1):
                for _ in range(gaps[i]):
                    cost, audit = cost + 2, audit + "I"
                    write("")
                if i < len(rows):
                    role, text, _, truncated = rows[i]
                    cost += {"D": 0 + 3, "K": truncated, "R": 2 + truncated}[letters[i]]
                    audit += letters[i]
                    if letters[i] == "K":
                        out.append((role, text))
                    elif letters[i] == "R":
                        write(text)
            initials = "".join(r[:1] for r, _ in out)
            body = initials[1:] if initials[:1] == "s" else initials
            if body == "ua" * (len(body) // 2) and len(initials) == len(out) and (body or not initials):
                found.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in out)))
    return min(found)


def expected(conversations):
    out = []
    groups = {}
    for cid, turn, role, text in conversations:
        groups.setdefault(cid, []).append((turn, role, text))
    for cid, rows in groups.items():
        after = []
        for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            name = f"{' ' if cid is None else cid}:{' ' if turn is None else turn}"
            fault = zlib.crc32(name.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
            after += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
        kinds, seen = [], set()
        for _, role, text in after:
            kind = "blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACES)[-1] not in ".!?" else ""
            seen.add((role, text))
            kinds.append(kind)
        turns = {t for t, _, _ in after if t is not None}
        cost, audit, text = brute([(r, t, k in ("blank", "duplicate"), k == "truncated") for (_, r, t), k in zip(after, kinds, strict=True)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((cid, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No!", "So", "", "  \n", None, "é?\t", "Yes.", "中文 。", "a. b"]
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, 4)):
            rows.append((c if c else None, rng.choice([None, turn, turn + 3, turn]) if c % 3 == 0 else turn, rng.choice(roles), rng.choice(texts)))
    # rows of one turn follow the input's order, which a test cannot hold through partitions: one row a turn
    return list({(r[0], r[1]): r for r in rows}.values())


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def conversations():
    return made(120, 7)


def test_against_all_edits(spark, conversations):
    df = spark.createDataFrame(conversations, SCHEMA).repartition(3)
    assert result(repair(df)) == expected(conversations)


def test_long_conversations_are_dealt_out(spark, conversations, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SEGMENT", 2)
    df = spark.createDataFrame(conversations, SCHEMA).repartition(3)
    assert result(repair(df, most_rows=1)) == expected(conversations)


def test_one_conversation_of_many_rows(spark):
    rng = random.Random(3)
    rows = [(1, t // 2 if t % 7 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "", "C?"]) + str(t % 50) * (t % 3) + rng.choice([".", ""])) for t in range(1500)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(repair(df)) == result(repair(df, most_rows=100))


def test_segments_add_up():
    rng = random.Random(5)
    for n in range(12):
        rows = [(rng.choice("uasx"), rng.random() < 0.3, rng.random() < 0.3) for _ in range(n)]
        cuts = sorted(rng.randint(0, n) for _ in range(3))
        table = {(s, s): (0, "") for s in range(4)}
        for lo, hi in itertools.pairwise([0, *cuts, n]):
            table = joined(table, segment(rows[lo:hi]))
        assert conversation_repair.cheapest(table) == edits(rows)
        if n <= 4:
            names = {"u": "user", "a": "assistant", "s": "system", "x": "x"}
            assert edits(rows) == brute([(names[i], "", g, t) for i, g, t in rows])[:2]


def test_known_audits():
    kept = lambda text: [(c, False, False) for c in text]
    assert edits(kept("ua")) == (0, "KK")
    assert edits(kept("sua")) == (0, "KKK")
    assert edits(kept("s")) == (3, "D")
    assert edits(kept("u")) == (2, "KI")
    assert edits(kept("au")) == (4, "IKKI")
    assert edits(kept("uu")) == (2, "KR")
    assert edits([]) == (0, "")
    assert edits([("u", True, False)]) == (3, "D")


def test_the_sql_agrees(spark, conversations, folder):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet'")
    df = repair(spark.read.parquet(f"{folder}/conversations.parquet"))
    query = con.sql(SQL)
    assert query.columns == df.columns
    assert result(df) == sorted(query.fetchall(), key=str)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(empty).collect() == []
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.", 1, "x"), (None, None, None, None, 2, "y")]
    found = {r["conv_id"]: r for r in repair(spark.createDataFrame(rows, SCHEMA + ", fault int, blank string")).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(found[gone])[1:] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert (found[None]["blank"], found[None]["audit"]) == (1, "D")
    huge = "long. " * 400_000
    whole = next(c for c in range(10_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    (row,) = repair(spark.createDataFrame([(whole, 0, "user", huge), (whole, 1, "assistant", "Well.")], SCHEMA)).collect()
    assert row["cost"] == 0 and row["repaired_sha256"] == hashlib.sha256(f"user:{huge}\nassistant:Well.".encode()).hexdigest()
