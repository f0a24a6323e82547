"""Operator 1: quality scores by Bradley-Terry pairwise ranking.

Features are bounded numbers of the whole text. A bounded sample of labelled rows gives preference pairs (a
text labelled 1 is preferred to one labelled 0); logistic loss on their feature differences is minimised, as in
a Bradley-Terry model with a linear strength. All learning rows are then scored, and the strengths are cut at the
quantile of theirs that separates the labels best (counted on Spark in a histogram); the cut becomes score 0.3.

Defined cases: null and empty texts have the features of an empty text; repeated rows score alike, and in the fit
each counts; of repeated ids the largest label counts; equally good cuts go to the lower quantile; with no labelled
rows of both values, or an empty table, every score is 0.5. Texts are read whole. Scores do not depend on the order
or partitioning of the rows: the sample is sorted before pairs are drawn.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transloom.llm.common import small_batches, written
from transloom.llm.samples import ROWS_PER_LABEL, labelled_sample, learning_rows

#: Pairs drawn for each row of the sample.
PAIRS_PER_ROW = 4
CUT_SCORE = 0.3
RIDGE = 1.0
#: Cells of the strength histogram to one unit of strength, and the largest strength that it tells apart.
CELLS_PER_UNIT = 64
LIMIT = 64

_UPPER = regex.compile(r"\p{Lu}")
_LINK = regex.compile(r"https?:|www\.")
_CAPITALS = bytes(range(65, 91))
#: Characters that are counted together.
COUNTED = (b"#*$%&<>", b"|", b"!?", b"0123456789", b".,;:", b"@/\\{}[]()_=+~^\"'")


def text_features(text: str | None) -> list[float]:
    """15 bounded features of a text. Words are runs without ASCII white space; lines without a word do not count."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len if len(raw) == len(t) else (lambda w: len(w.decode("utf-8", "surrogatepass")))
    n, n_words, n_lines = max(len(t), 1), max(len(words), 1), max(len(lines), 1)
    share = lambda x, of: math.log1p(100.0 * x / of)  # noqa: E731  (linear near 0, flat for large shares)
    symbols, bars, cries, digits, stops, brackets = (len(raw) - len(raw.translate(None, c)) for c in COUNTED)
    upper = len(raw) - len(raw.translate(None, _CAPITALS)) if len(raw) == len(t) else len(_UPPER.findall(t))
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    return [
        math.log1p(len(words)),
        share(symbols, n),
        share(bars, n),
        share(cries, n),
        share(upper, n),
        share(digits, n),
        share(stops, n),
        share(brackets, n),
        share(len(set(words)), n_words),
        share(len(lines) - len(set(lines)), n_lines),
        share(n_lines, n_words),
        math.log1p((len(t) - spaces) / n_words),
        math.log1p(max(map(chars, words), default=0)),
        share(len(_LINK.findall(t)), n_words),
        float(not words),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    return texts.map(text_features, na_action=None)


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights that minimise the logistic loss on differences (preferred - other) of drawn pairs."""
    rng = np.random.default_rng(seed)
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    m = PAIRS_PER_ROW * len(y)
    d = x[good[rng.integers(len(good), size=m)]] - x[bad[rng.integers(len(bad), size=m)]]
    w, keep = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + keep, d.T @ (1 - p) - keep @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> dict | None:
    """{means, weights}; None without rows of both labels. The sample's features (bounded) reach the driver."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", rows_per_label)
    found = sample.where(F.col("label").isin(0, 1)).select("label", features("text").alias("x")).collect()
    rows = sorted((r["label"], *r["x"]) for r in found)  # the same pairs in whatever order rows come
    y = np.array([r[0] for r in rows])
    if not ((y == 0).any() and (y == 1).any()):
        return None
    x = np.array([r[1:] for r in rows], dtype=float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    return {"means": mean.tolist(), "weights": (fit_pairs((x - mean) / scale, y) / scale).tolist()}


def strength(text: Column, model: dict) -> Column:
    """Strength of a text column; 0 at the mean of the sample."""
    mean, weights = np.array(model["means"]), np.array(model["weights"])

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        x = np.array([text_features(t) for t in texts], dtype=float).reshape(-1, len(mean))
        return pd.Series((x - mean) @ weights)

    return run(text)


def cut_quantile(counts: list[tuple[int, int, int]]) -> tuple[float, float]:
    """(quantile, strength) of the cell edge with the best mean of both labels' accuracies.

    counts: (cell, rows labelled 0, rows labelled 1); a row is taken as 1 from the edge on.
    """
    counts = sorted(counts)
    zero, one = (sum(c[i] for c in counts) for i in (1, 2))
    below0 = below1 = 0
    best = (-1.0, 0.0, 0.0)
    for (cell, n0, n1), follows in zip(counts, [*counts[1:], None], strict=True):
        below0, below1 = below0 + n0, below1 + n1
        right = below0 / zero + 1 - below1 / one
        if follows and right > best[0]:  # between two cells that hold rows
            best = (right, (below0 + below1) / (zero + one), (cell + 1 + follows[0]) / 2 / CELLS_PER_UNIT)
    return best[1], best[2]


def fit_cut(strengths: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """The cut over all learning rows of (doc_id, strength). Only cell counts reach the driver."""
    s = F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.col("strength")))
    cells = strengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.floor(s * CELLS_PER_UNIT).alias("cell"))
    joined = cells.join(learning_rows(labels, "quality").where(F.col("label").isin(0, 1)), "doc_id")
    counts = joined.groupBy("cell").agg(F.count_if(F.col("label") == 0).alias("zero"), F.count_if(F.col("label") == 1).alias("one"))
    found = [tuple(r) for r in counts.collect()]
    if not (sum(c[1] for c in found) and sum(c[2] for c in found)):
        return 0.5, 0.0
    return cut_quantile(found)


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str | Column] | None = None) -> DataFrame:
    """(``keep`` or doc_id, score) of every document: CUT_SCORE at the cut, higher where label 1 is likelier."""
    keep = keep or ["doc_id"]
    model = fit(docs, labels)
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    # texts are read once: their strengths are kept in a narrow table
    strengths = written(docs.select("doc_id", strength(F.col("text").cast("string"), model).alias("strength")))
    _, cut = fit_cut(strengths, labels)
    offset = math.log(CUT_SCORE / (1 - CUT_SCORE)) - cut
    return strengths.select(*keep, (1 / (1 + F.exp(-(F.col("strength") + F.lit(offset))))).alias("score"))
