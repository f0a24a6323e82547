"""Operator 12: conversation structure repair by scalar big-integer weights.

Faults are found row by row, and the cheapest edits that give role initials ``(s?(ua)+)?`` are the least path through a
directed acyclic graph: a node is (rows read, state of the pattern), an edge is an edit. One whole number is an edge's
weight: its high digits are the edit's cost, its low digits are the edit's letter at the letter's place in the audit,
in three bits, with zeros behind the last letter. A path's weight is the sum of its edges' weights, so the least number is
the cheapest path and, among equals, the one of the ASCII-least audit. Nothing else decides.

Why one number a node is enough: two paths to a node have read the same rows. If one's audit were a beginning of the
other's, the rest would be insertions only, and they cost; so of two equally dear paths neither audit begins the other,
and whatever follows them does not change their order. Two insertions side by side never are the cheapest (leave out
both, or delete the lone system row that they would save), so one insertion before each row and one at the end are all.

By the same argument rows can be cut into segments: a segment's least edits from each state to each state (16 at most)
add up as paths do. Conversations of up to MOST_ROWS rows and MOST_BYTES bytes are each repaired in one piece of a task
that streams sorted rows; longer ones are dealt out by ranges of turns, each range is folded to a table of segments, and
the tables of a conversation are folded once more. SHA-256 takes its bytes in order, so the hash of a long conversation's
repaired text runs through one task, as a stream that holds one batch of rows and the audit.

Defined cases: null roles and texts are one space, and so are nulls in the text whose checksum picks the damage; null
turns come first and count for no gap; rows of one turn follow the input's order; repeated rows are rows of their own (and
duplicates); rows with a null conv_id are one conversation; a role that begins with none of s, u and a can only be
rewritten or deleted, and the empty role has no initial; a conversation without rows after the damage gives zeros, an empty
audit and the hash of the empty string; columns beyond conv_id, turn, role and text are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import SPACES, cut, small_batches, written

#: Conversations beyond either are dealt out in segments.
MOST_ROWS, MOST_BYTES = 4096, 16 << 20
#: Rows of a segment: its numbers have some six bits a row.
SEGMENT = 256

DAMAGES = 20
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED_COST = 1
#: Letters as digits in their ASCII order; zero stands behind the last letter.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {d: c for c, d in DIGIT.items()}
DIGIT_BITS = 3
ROLES = {"u": "user", "a": "assistant"}

#: States of the pattern: nothing yet, after s, after u, after a. What may be written next, and where a kept initial leads.
STATES = START, AFTER_S, AFTER_U, AFTER_A = range(4)
WRITES = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
AFTER = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
ENDS = (START, AFTER_A)
LEGAL = {"su", "ua", "au"}

#: (role initial, deletion required, truncated)
Row = tuple[str, bool, bool]
#: state -> (weight, letters)
Front = dict[int, tuple[int, int]]
#: (entry state, exit state) -> (cost, audit)
Table = dict[tuple[int, int], tuple[int, str]]


def _edge(letter: str, extra: int, place: int, width: int) -> int:
    return (COST[letter] + extra << DIGIT_BITS * width) + (DIGIT[letter] << DIGIT_BITS * (width - 1 - place))


def _keep_least(front: Front, state: int, weight: int, letters: int) -> None:
    if state not in front or weight < front[state][0]:
        front[state] = weight, letters


def _with_insertions(front: Front, width: int) -> Front:
    out = dict(front)
    for state, (weight, letters) in front.items():
        _keep_least(out, AFTER[WRITES[state]], weight + _edge("I", 0, letters, width), letters + 1)
    return out


def _past(front: Front, row: Row, width: int) -> Front:
    """The least weights behind one more row, an insertion before it included."""
    initial, must_go, truncated = row
    out: Front = {}
    for state, (weight, letters) in _with_insertions(front, width).items():
        _keep_least(out, state, weight + _edge("D", 0, letters, width), letters + 1)
        if must_go:
            continue
        extra = TRUNCATED_COST if truncated else 0
        if initial == WRITES[state] or (initial == "s" and state == START):
            _keep_least(out, AFTER[initial], weight + _edge("K", extra, letters, width), letters + 1)
        _keep_least(out, AFTER[WRITES[state]], weight + _edge("R", extra, letters, width), letters + 1)
    return out


def _read(weight: int, letters: int, width: int) -> tuple[int, str]:
    """(cost, audit) of a weight."""
    digits = weight & ((1 << DIGIT_BITS * width) - 1)
    audit = "".join(LETTER[digits >> DIGIT_BITS * (width - 1 - i) & (1 << DIGIT_BITS) - 1] for i in range(letters))
    return weight >> DIGIT_BITS * width, audit


def segment(rows: list[Row], entries: Iterable[int] = STATES) -> Table:
    """The least edits over some rows from each entry state to each exit state; no insertion behind the last row."""
    width = 2 * len(rows)
    out: Table = {}
    for entry in entries:
        front: Front = {entry: (0, 0)}
        for row in rows:
            front = _past(front, row, width)
        out |= {(entry, state): _read(*at, width) for state, at in front.items()}
    return out


def joined(first: Table, then: Table) -> Table:
    """The table of two segments one behind the other."""
    out: Table = {}
    for (entry, middle), (cost, audit) in first.items():
        for state in STATES:
            if (middle, state) in then:
                more, rest = then[middle, state]
                found = cost + more, audit + rest
                if (entry, state) not in out or found < out[entry, state]:
                    out[entry, state] = found
    return out


def cheapest(table: Table) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    last = {(s, AFTER[WRITES[s]]): (COST["I"], "I") for s in STATES} | {(s, s): (0, "") for s in STATES}
    return min(found for (entry, state), found in joined(table, last).items() if entry == START and state in ENDS)


def edits(rows: list[Row]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation of any length."""
    table: Table = {(s, s): (0, "") for s in STATES}
    for lo in range(0, len(rows), SEGMENT):
        table = joined(table, segment(rows[lo : lo + SEGMENT], STATES if lo else (START,)))
    return cheapest(table)


class Repaired:
    """The SHA-256 of the repaired rows, as rows and letters come."""

    def __init__(self, audit: str) -> None:
        self._audit, self._at, self._state, self._hash, self._any = audit, 0, START, hashlib.sha256(), False

    def _write(self, role: bytes, text: bytes, state: int) -> None:
        self._hash.update((b"\n" if self._any else b"") + role + b":")
        self._hash.update(text)
        self._state, self._any = state, True

    def _insert(self) -> None:
        while self._at < len(self._audit) and self._audit[self._at] == "I":
            new = WRITES[self._state]
            self._write(ROLES[new].encode(), b"", AFTER[new])
            self._at += 1

    def row(self, initial: str, role: bytes, text: bytes) -> None:
        self._insert()
        letter = self._audit[self._at]
        self._at += 1
        if letter == "K":
            self._write(role, text, AFTER[initial])
        elif letter == "R":
            new = WRITES[self._state]
            self._write(ROLES[new].encode(), text, AFTER[new])

    def hexdigest(self) -> str:
        self._insert()
        return self._hash.hexdigest()


def damaged(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, nth, copy, gone, initial, role, text, blank, truncated): the rows after the damage in their order
    (turn, nulls first; nth; copy); a dropped row stays as a mark (gone) that its conversation was there."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(conv_id), F.lit(":"), space("turn"))) % DAMAGES
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.monotonically_increasing_id().alias("nth"), fault.alias("fault"), space("role").alias("role"), space("text").alias("text"))
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", "nth", F.explode(copies).alias("copy"), (F.col("fault") == 0).alias("gone"), role.alias("role"), text.alias("text"))
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    return rows.select("conv_id", "turn", "nth", "copy", "gone", F.substring("role", 1, 1).alias("initial"), "role", "text", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"))


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
RESULT = f"{COUNTS}, repaired_sha256 string"
#: Ascending order puts null turns first.
ORDER = ["turn", "nth", "copy"]
_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_NOTHING = hashlib.sha256().hexdigest()


def _conversation(rows: list[tuple]) -> tuple:
    """The result (without its id) of sorted rows (turn, initial, role, text, blank, truncated) of one conversation."""
    seen: set[tuple[bytes, bytes]] = set()
    kinds: list[Row] = []
    blanks = duplicates = truncations = 0
    for _, initial, role, text, blank, truncated in rows:
        duplicate = not blank and (role, text) in seen
        seen.add((role, text))
        truncated = truncated and not blank and not duplicate
        blanks, duplicates, truncations = blanks + blank, duplicates + duplicate, truncations + truncated
        kinds.append((initial, blank or duplicate, truncated))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False))
    cost, audit = edits(kinds)
    repaired = Repaired(audit)
    for _, initial, role, text, _, _ in rows:
        repaired.row(initial, role, text)
    return gaps, blanks, duplicates, truncations, illegal, cost, audit, repaired.hexdigest()


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, tuple, pa.DataType]]:
    """(id, whether it is another one than before, the other columns, type of the id) row by row."""
    last, begun = None, False
    for batch in batches:
        kind = batch.schema.field(0).type
        for cid, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield cid, not begun or cid != last, tuple(row), kind
            last, begun = cid, True


def _repair_whole(rows: DataFrame) -> DataFrame:
    """Conversations that one task may hold."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    dealt = dealt.select("conv_id", "turn", "initial", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "blank", "truncated", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, of, kind = [], [], None, None
        begun = False
        for cid, new, (*row, gone), kind in _runs(batches):
            if new and begun:
                out.append((of, *_conversation(rows)))
                rows = []
                if len(out) >= 4096:
                    yield _batch(out, kind)
                    out = []
            of, begun = cid, True
            if not gone:
                rows.append(tuple(row))
        if begun:
            yield _batch([*out, (of, *_conversation(rows))], kind)

    return dealt.mapInArrow(run, f"conv_id {id_type}, {RESULT}")


_TABLE = "array<struct<entry: int, exit: int, cost: long, audit: string>>"
_PART = f"rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, last_turn long, edits {_TABLE}"
_PART_NAMES = [p.split()[0] for p in _PART.split(", edits")[0].split(", ")]


def _fold(parts: Iterable[dict]) -> dict:
    """One part of parts that lie one behind the other."""
    total: dict = {}
    for part in parts:
        if not total:
            total = dict(part)
            continue
        total["illegal"] += part["illegal"] + (total["last"] + part["first"] not in LEGAL)
        for name in ("rows", "blank", "duplicate", "truncated"):
            total[name] += part[name]
        if part["turns"]:
            again = total["turns"] and total["last_turn"] == part["low"]
            total |= {"turns": total["turns"] + part["turns"] - bool(again), "low": total["low"] if total["turns"] else part["low"], "high": part["high"], "last_turn": part["last_turn"]}
        total |= {"last": part["last"], "edits": joined(total["edits"], part["edits"])}
    return total


def _part(rows: list[tuple]) -> dict:
    """The part of some sorted rows (turn, initial, blank, duplicate, truncated)."""
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "rows": len(rows), "blank": sum(r[2] for r in rows), "duplicate": sum(r[3] for r in rows), "truncated": sum(r[4] for r in rows),
        "illegal": sum(a[1] + b[1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False)), "first": rows[0][1], "last": rows[-1][1],
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)), "last_turn": turns[-1] if turns else None,
        "edits": segment([(r[1], r[2] or r[3], r[4]) for r in rows]),
    }


def _part_arrays(parts: list[dict]) -> list[pa.Array]:
    strings = {"first", "last"}
    arrays = [pa.array([p[n] for p in parts], pa.string() if n in strings else pa.int64()) for n in _PART_NAMES]
    kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    return [*arrays, pa.array([[{"entry": a, "exit": b, "cost": c, "audit": w} for (a, b), (c, w) in p["edits"].items()] for p in parts], kind)]


def _repair_long(rows: DataFrame) -> DataFrame:
    """Conversations that are dealt out; their rows are kept in the shared folder, so that each pass sees one order."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    rows = written(rows)
    there = rows.where(~F.col("gone")).drop("gone")
    same = lambda a, b: a.eqNullSafe(b)
    # the first row of each role and text that more than one row has
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    at = F.struct(F.col("turn").isNotNull().alias("has"), *ORDER)
    narrow = there.where(~F.col("blank")).select("conv_id", digest.alias("digest"), at.alias("at"))
    first = narrow.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("what")).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = there.withColumns({"digest": digest, "at": at}).join(first, same(F.col("conv_id"), F.col("of")) & (F.col("digest") == F.col("what")), "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("at") != F.col("first"), F.lit(False))
    marked = found.select("conv_id", *ORDER, "initial", "blank", duplicate.alias("duplicate"), (F.col("truncated") & ~F.col("blank") & ~duplicate).alias("truncated"))
    dealt = cut(marked).repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []  # (id, order of the first row, part); there are few conversations in a range of rows
        some: list[tuple] = []
        of, start, begun, kind = None, None, False, None

        def close() -> None:
            if some:
                part = _part(some)
                if out and out[-1][0] == of and out[-1][1] == start:
                    out[-1] = (of, start, _fold([out[-1][2], part]))
                else:
                    out.append((of, start, part))
                some.clear()

        for cid, new, (turn, nth, copy, initial, blank, duplicate, truncated), kind in _runs(batches):
            if new or len(some) == SEGMENT:
                close()
            if new:
                of, start, begun = cid, (turn is not None, turn or 0, nth, copy), True
            some.append((turn, initial, blank, duplicate, truncated))
        close()
        if begun:
            starts = list(zip(*(o[1] for o in out), strict=True))
            arrays = [pa.array([o[0] for o in out], kind), *[pa.array(s, t) for s, t in zip(starts, (pa.bool_(), pa.int64(), pa.int64(), pa.int32()), strict=True)], *_part_arrays([o[2] for o in out])]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "has", "turn", "nth", "copy", *_PART_NAMES, "edits"])

    pieces = dealt.mapInArrow(parts, f"conv_id {id_type}, has boolean, turn long, nth long, copy int, {_PART}")

    def whole(t: pa.Table) -> pa.Table:
        lines = sorted(t.to_pylist(), key=lambda r: (r["has"], r["turn"], r["nth"], r["copy"]))
        for line in lines:
            line["edits"] = {(e["entry"], e["exit"]): (e["cost"], e["audit"]) for e in line["edits"]}
        total = _fold(lines)
        gaps = total["high"] - total["low"] + 1 - total["turns"] if total["turns"] else 0
        row = (lines[0]["conv_id"], gaps, *(total[n] for n in ("blank", "duplicate", "truncated", "illegal")), *cheapest(total["edits"]))
        return pa.Table.from_batches([_batch([(*row, None)], t.schema.field("conv_id").type)]).drop_columns(["repaired_sha256"])

    counts = cut(pieces.groupBy("conv_id").applyInArrow(whole, f"conv_id {id_type}, {COUNTS}"))
    # a conversation's audit goes before its rows
    nothing = {"turn": "long", "nth": "long", "copy": "int", "initial": "string", "role": "binary", "text": "binary"}
    heads = counts.select("conv_id", F.lit(0).alias("line"), *[F.lit(None).cast(k).alias(c) for c, k in nothing.items()], "audit")
    lines = there.select("conv_id", F.lit(1).alias("line"), *[F.col(c).cast(k).alias(c) for c, k in nothing.items()], F.lit(None).cast("string").alias("audit"))
    stream = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "line", *ORDER).select("conv_id", "line", "initial", "role", "text", "audit")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[object, Repaired]] = []
        kind: pa.DataType = pa.null()
        for cid, new, (_, initial, role, text, audit), kind in _runs(batches):
            if new:
                out.append((cid, Repaired(audit)))
            else:
                out[-1][1].row(initial, role, text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([h.hexdigest() for _, h in out])], ["of", "repaired_sha256"])

    hashed = stream.mapInArrow(hashes, f"of {id_type}, repaired_sha256 string")
    done = counts.join(hashed, same(F.col("conv_id"), F.col("of"))).drop("of")
    # those that the damage left without rows
    names = rows.where("gone").select("conv_id").distinct().join(counts.select(F.col("conv_id").alias("of")), same(F.col("conv_id"), F.col("of")), "left_anti")
    zero = [F.lit(0).cast("long").alias(n) for n in _NAMES[1:7]]
    return done.unionByName(names.select("conv_id", *zero, F.lit("").alias("audit"), F.lit(_NOTHING).alias("repaired_sha256")))


def repair(conversations: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(conv_id, counts, cost, audit, repaired_sha256) of every conversation."""
    spark = conversations.sparkSession
    small_batches(spark)
    rows = damaged(conversations)
    size = F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(1)))
    sizes = conversations.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("n"), size.alias("bytes"))
    long = cut(sizes.where((F.col("n") * 2 > most_rows) | (F.col("bytes") * 2 > most_bytes)).select("of"))
    if long.isEmpty():
        return _repair_whole(rows)
    among: Column = F.col("conv_id").eqNullSafe(F.col("of"))
    return _repair_whole(rows.join(long, among, "left_anti")).unionByName(_repair_long(rows.join(long, among, "left_semi")))


#: DuckDB SQL for the registered query: a recursion over rows with the least (cost, audit) of each state.
SQL = r"""
WITH RECURSIVE
raw AS (SELECT conv_id, turn, row_number() OVER () AS nth, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(name, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS fault FROM raw),
hurt AS (SELECT conv_id, turn, nth, copy, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM crc, (SELECT unnest([0, 1]) AS copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, nth, copy) AS i, left(role, 1) AS initial,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, nth, copy) > 1 AS seen FROM hurt),
rows AS (SELECT *, tail = '' AS blank, tail <> '' AND seen AS duplicate, tail NOT IN ('', '.', '!', '?') AND NOT seen AS truncated,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM told),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, coalesce(count_if(illegal), 0) AS illegal, count(*) AS n FROM rows GROUP BY conv_id),
moves AS (SELECT * FROM (VALUES ('0', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')) v(state, writes, role)),
-- the least (cost, audit) of each conversation, rows read and state; what it writes travels with it
best AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS state, 0::BIGINT AS cost, '' AS audit, '' AS written FROM counts
  UNION ALL
  SELECT conv_id, i, state, least.cost AS cost, least.audit AS audit, least.written AS written FROM (
    SELECT conv_id, i, state, min({'cost': cost, 'audit': audit, 'written': written}) AS least FROM (
      SELECT f.conv_id, r.i, CASE e.letter WHEN 'D' THEN f.state WHEN 'K' THEN r.initial ELSE m.writes END AS state,
        f.cost + CASE e.letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN r.truncated AND e.letter <> 'D' THEN 1 ELSE 0 END AS cost, f.audit || e.letter AS audit,
        f.written || CASE e.letter WHEN 'D' THEN '' ELSE chr(10) || CASE e.letter WHEN 'K' THEN r.role ELSE m.role END || ':' || r.text END AS written
      FROM (
        SELECT conv_id, i, state, cost, audit, written FROM best
        UNION ALL
        SELECT b.conv_id, b.i, m.writes, b.cost + 2, b.audit || 'I', b.written || chr(10) || m.role || ':' FROM best b JOIN moves m ON m.state = b.state) f
      JOIN rows r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1
      JOIN moves m ON m.state = f.state
      JOIN (VALUES ('D'), ('K'), ('R')) e(letter) ON e.letter = 'D' OR NOT r.blank AND NOT r.duplicate AND (e.letter = 'R' OR r.initial = m.writes OR r.initial = 's' AND f.state = '0'))
    GROUP BY conv_id, i, state)),
ends AS (
  SELECT b.conv_id, min({'cost': b.cost + e.cost, 'audit': b.audit || e.letter, 'written': b.written || e.written}) AS least
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i
  JOIN (VALUES ('0', 0, '', ''), ('a', 0, '', ''), ('u', 2, 'I', chr(10) || 'assistant:')) e(state, cost, letter, written) ON e.state = b.state GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(least.cost, 0)::BIGINT AS cost,
  coalesce(least.audit, '') AS audit, sha256(coalesce(substr(least.written, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
