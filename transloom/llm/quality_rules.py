"""Operator 2: quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only.

Each text gets four integer measures. Their distribution per language and source is a log-linear
histogram sketch: cells of width 1 below 64 and of relative width 1/32 above, so quantiles are exact for
small values and within about 3 % for large ones, counts merge by addition (per task, per source, per
language, over all), and the same rows give the same thresholds however they are split. Thresholds are fences of a
row's own (language, source) group: so many interquartile ranges beyond the quartiles, or, for measures that are 0 in
most texts, so many times the distance of the upper tail. A group that is too small for a measure uses its language's
fence, a small language the whole corpus's. A group's fence lies at most SLACK times as far out as its parent's, so a
source full of junk cannot vouch for itself. The rows are then joined with their thresholds and filtered.

Defined cases: a null or empty text has no words and fails the base rule; null language or source is a
group of its own; repeated rows get the same verdict and each counts in the sketch; a value on a fence is within it;
very long texts are measured whole, inside their row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.llm.common import SPACES, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows that a group needs for its quartiles, and for its upper tail.
MIN_GROUP, MIN_TAIL = 50, 500
QUARTILES = (0.25, 0.75)
#: The upper tail begins at this quantile (a binary fraction, so that ranks are exact).
TAIL = 63 / 64
#: Fences lie this many interquartile ranges beyond the quartiles, or this many times the tail's distance ...
FENCE_RANGES, TAIL_RANGES = 3, 6
#: ... and at least this far: measure -> least distance (per mille; word length in hundredths of a character).
LEAST_DISTANCE = {"symbols": 30, "dup_lines": 50, "repeats": 50, "word_length": 150}
#: Measures with a lower fence too, and those whose fence follows the tail.
TWO_SIDED = ("word_length",)
TAILED = ("dup_lines", "repeats")
#: A group's fence is at most this many times as far from its parent's quartile as the parent's fence is.
SLACK = 2


def words(text: Column) -> Column:
    """Array of words: runs without ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text.

    Repeated 3-word windows are found inside the row: window hashes are sorted with their positions, equal
    neighbours flagged, and the words under flagged windows counted once. No row leaves its task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = rows.select(
        "doc_id", "lang", "source", words(F.col("text")).alias("words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    window = F.transform(
        F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p")),
    )
    rows = rows.withColumn("sorted", F.sort_array(window))
    twin = F.filter(
        "sorted",
        lambda x, i: F.coalesce(F.get("sorted", i + 1)["h"] == x["h"], F.lit(False)) | (F.when(i > 0, F.get("sorted", i - 1)["h"] == x["h"]).otherwise(False)),
    )
    rows = rows.withColumn("flagged", F.sort_array(F.transform(twin, lambda x: x["p"])))
    covered = F.aggregate(
        "flagged", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return rows.select("doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_lines")


MEASURES = {
    "symbols": "n_symbols * 1000 div greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "word_length": "word_chars * 100 div greatest(n_words, 1)",
}


def cell_top(v: Column) -> Column:
    """Largest value of the sketch cell that holds ``v`` (a non-negative long)."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    width = F.pow(F.lit(2.0), shift).cast("long")
    return F.expr("0L") + (F.floor(v / width) + 1) * width - 1


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, top, n): cell counts of each (language, source) group."""
    long = measured.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x"))
    return long.select("lang", "source", "x.measure", cell_top(F.col("x.v")).alias("top")).groupBy("lang", "source", "measure", "top").agg(F.count("*").alias("n"))


def fences(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of ``keys``: n and measure -> (q0, q1, low, high), from the merged sketches."""
    group = [*keys, "measure"]
    merged = cells.groupBy(*group, "top").agg(F.sum("n").alias("n"))
    merged = merged.withColumns({"upto": F.sum("n").over(Window.partitionBy(*group).orderBy("top")), "all": F.sum("n").over(Window.partitionBy(*group))})
    at = {f"q{i}": F.min(F.when(F.col("upto") >= F.col("all") * F.lit(q), F.col("top"))) for i, q in enumerate((*QUARTILES, TAIL))}
    found = merged.groupBy(*group).agg(F.max("all").alias("all"), *[c.alias(k) for k, c in at.items()])
    least = F.lit(0)
    for m, d in LEAST_DISTANCE.items():
        least = F.when(F.col("measure") == m, d).otherwise(least)
    tail = F.when(F.col("measure").isin(*TAILED), TAIL_RANGES * (F.col("q2") - F.col("q1"))).otherwise(0)
    reach = F.greatest(FENCE_RANGES * (F.col("q1") - F.col("q0")), tail, least)
    low = F.when(F.col("measure").isin(*TWO_SIDED), F.col("q0") - reach).otherwise(F.lit(-1))
    fence = F.struct("q0", "q1", low.alias("low"), (F.col("q1") + reach).alias("high"))
    out = found.groupBy(*keys) if keys else found.groupBy()
    return out.agg(F.max("all").alias("n"), *[F.max(F.when(F.col("measure") == m, fence)).alias(m) for m in MEASURES])


def bounded(own: Column, parent: Column, measure: str) -> Column:
    """The own fence, at most SLACK times as far out as the parent's."""
    high = F.least(own["high"], parent["q1"] + SLACK * (parent["high"] - parent["q1"]))
    low = F.greatest(own["low"], parent["q0"] - SLACK * (parent["q0"] - parent["low"])) if measure in TWO_SIDED else own["low"]
    return F.struct(own["q0"].alias("q0"), own["q1"].alias("q1"), low.alias("low"), high.alias("high"))


def thresholds(cells: DataFrame, min_group: int = MIN_GROUP, min_tail: int = MIN_TAIL) -> DataFrame:
    """The fences that hold for each (language, source): its own, its language's, or the corpus's."""
    own, by_lang, overall = fences(cells, ["lang", "source"]), fences(cells, ["lang"]), fences(cells, [])
    out = own.alias("o").join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")), "left").join(F.broadcast(overall).alias("a"), F.lit(True), "left")

    def pick(m: str) -> Column:
        need = min_tail if m in TAILED else min_group
        lang = F.when(F.col("l.n") >= need, bounded(F.col(f"l.{m}"), F.col(f"a.{m}"), m)).otherwise(F.col(f"a.{m}"))
        return F.when(F.col("o.n") >= need, bounded(F.col(f"o.{m}"), lang, m)).otherwise(lang)

    level = F.when(F.col("o.n") >= min_group, "source").when(F.col("l.n") >= min_group, "language").otherwise("corpus")
    return out.select("o.lang", "o.source", level.alias("level"), *[pick(m).alias(m) for m in MEASURES])


def apply_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Measures, base verdict and final verdict of every document."""
    measured = base_measures(docs).withColumns({m: F.expr(e) for m, e in MEASURES.items()})
    measured = written(measured)
    limits = thresholds(sketches(measured), min_group)
    joined = measured.alias("d").join(limits.alias("t"), F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    within = F.lit(True)
    for m in MEASURES:
        within = within & (F.col(f"d.{m}") <= F.col(f"t.{m}.high")) & (F.col(f"d.{m}") >= F.col(f"t.{m}.low"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(False))).alias("kept"), "level")


#: DuckDB SQL for the registered query.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
h AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s FROM g),
c AS (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n FROM h),
u AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM c WHERE n >= 2) GROUP BY r),
m AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(u.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM l LEFT JOIN u USING (r)),
v AS (
  SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 100 // greatest(n_words, 1) AS word_length
  FROM m),
x AS (
  SELECT coalesce('v' || lang, 'n') AS kl, coalesce('v' || source, 'n') AS ks, measure, val,
         (2 ** greatest(floor(log2(greatest(val, 1))) - 5, 0))::BIGINT AS width
  FROM (UNPIVOT (SELECT lang, source, symbols, dup_lines, repeats, word_length FROM v) ON symbols, dup_lines, repeats, word_length INTO NAME measure VALUE val)),
y AS (SELECT *, (val // width + 1) * width - 1 AS top FROM x),
z AS (
  SELECT kl, ks, measure, quantile_disc(top, 0.25) AS a, quantile_disc(top, 0.75) AS b, quantile_disc(top, 0.984375) AS e, count(*) AS n
  FROM y GROUP BY GROUPING SETS ((kl, ks, measure), (kl, measure), (measure))),
f AS (
  SELECT kl, ks, measure, n, a, b, CASE WHEN measure IN ('dup_lines', 'repeats') THEN 500 ELSE 50 END AS need,
         CASE WHEN measure = 'word_length' THEN a - greatest(3 * (b - a), 150) ELSE -1 END AS low,
         b + greatest(3 * (b - a), CASE measure WHEN 'symbols' THEN 30 WHEN 'word_length' THEN 150 ELSE greatest(6 * (e - b), 50) END) AS high
  FROM z),
fl AS (
  SELECT l.kl, l.measure, l.n, CASE WHEN l.n >= l.need THEN l.a ELSE a.a END AS a, CASE WHEN l.n >= l.need THEN l.b ELSE a.b END AS b,
         CASE WHEN l.n < l.need THEN a.low WHEN l.measure = 'word_length' THEN greatest(l.low, a.a - 2 * (a.a - a.low)) ELSE -1 END AS low,
         CASE WHEN l.n < l.need THEN a.high ELSE least(l.high, a.b + 2 * (a.high - a.b)) END AS high
  FROM f l JOIN f a ON a.kl IS NULL AND a.measure = l.measure WHERE l.kl IS NOT NULL AND l.ks IS NULL),
t AS (
  SELECT o.kl, o.ks, o.measure,
         CASE WHEN o.n >= 50 THEN 'source' WHEN l.n >= 50 THEN 'language' ELSE 'corpus' END AS level,
         CASE WHEN o.n < o.need THEN l.low WHEN o.measure = 'word_length' THEN greatest(o.low, l.a - 2 * (l.a - l.low)) ELSE -1 END AS low,
         CASE WHEN o.n < o.need THEN l.high ELSE least(o.high, l.b + 2 * (l.high - l.b)) END AS high
  FROM f o JOIN fl l ON l.kl = o.kl AND l.measure = o.measure
  WHERE o.ks IS NOT NULL),
k AS (
  SELECT kl, ks, min(level) AS level,
         min(low) FILTER (measure = 'word_length') AS wl_low, min(high) FILTER (measure = 'word_length') AS wl_high,
         min(high) FILTER (measure = 'symbols') AS sy, min(high) FILTER (measure = 'dup_lines') AS dl, min(high) FILTER (measure = 'repeats') AS rp
  FROM t GROUP BY kl, ks)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND symbols <= sy AND dup_lines <= dl AND repeats <= rp AND word_length BETWEEN wl_low AND wl_high AS kept,
       level
FROM v JOIN k ON k.kl = coalesce('v' || v.lang, 'n') AND k.ks = coalesce('v' || v.source, 'n')
"""
