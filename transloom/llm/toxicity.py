"""Operator 10: toxicity by a weighted finite-state pattern grammar.

Small transducers read the word classes of a clause: negation, reported speech and targets open a scope of a few
words, insults (words and word beginnings with weights learned from labels) and threats are what is matched. The
scopes to the left are composed into one machine (the product of their reachable states), targets to the right are
read by the same target machine from the other end, and a table over both states and the kind of a match tells the
channel that its weight is emitted on. So whole clauses are scored, not isolated words: an insult near a target
weighs on another channel than one that is negated or reported. The weight of a clause is the sum along its only
path. A logistic layer over the channels, fitted on a bounded labelled sample, gives the score.

The lexicon is learned. The closed word classes (``WordClasses``) are grammar, not evidence of toxicity, and are a
parameter.

Defined cases: null and empty texts score as a text without any match; texts are read whole; repeated rows get equal
scores, and each counts in the fit; features of equal worth are taken in the order of their names; with no learned
insult only threats can match; with no labelled rows of both values, or an empty table, every score is 0.0.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import cut, once, small_batches
from transloom.llm.samples import ROWS_PER_LABEL, labelled_sample, learning_rows

OTHER, NEGATOR, REPORTER, TARGET, INSULT, THREAT = range(6)
#: Words to the right of a negator, of a reporter, and on either side of a target that are in its scope.
NEGATION_SCOPE = 3
REPORT_SCOPE = 12
TARGET_SCOPE = 4


@dataclasses.dataclass(frozen=True)
class WordClasses:
    """The closed word classes of the grammar; the defaults are for English, German, French and Spanish."""

    threats: frozenset[str] = frozenset("kill hurt destroy beat burn stab shoot töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())
    targets: frozenset[str] = frozenset("you your he she him her they them u du dich ihr euch er sie ihn tu toi te vous il elle ils tú usted él ella ellos".split())
    negators: frozenset[str] = frozenset("not no never nobody without nicht nie kein keine ohne ne pas jamais sans nunca sin".split())
    reporters: frozenset[str] = frozenset("said says wrote claimed quoted called sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())


@dataclasses.dataclass(frozen=True)
class Machine:
    """A deterministic automaton over word classes: ``arcs[state][class]`` is the next state, 0 the first one;
    ``marks[state]`` is what a word read in that state gets."""

    arcs: tuple[tuple[int, ...], ...]
    marks: tuple[tuple[bool, ...], ...]

    def states(self, symbols: Iterable[int]) -> list[int]:
        """The state in which each word is read."""
        out, at = [], 0
        for x in symbols:
            out.append(at)
            at = self.arcs[at][x]
        return out


def scope(opener: int, words: int) -> Machine:
    """A machine whose state is how many words of an open scope are left."""
    arcs = tuple(tuple(words if x == opener else max(k - 1, 0) for x in range(6)) for k in range(words + 1))
    return Machine(arcs, tuple((k > 0,) for k in range(words + 1)))


def compose(a: Machine, b: Machine) -> Machine:
    """Both machines side by side, over the pairs of states that are reached together."""
    at = {(0, 0): 0}
    todo, arcs = [(0, 0)], []
    for i, j in todo:  # grows as pairs are found
        row = []
        for x in range(6):
            pair = a.arcs[i][x], b.arcs[j][x]
            if pair not in at:
                at[pair] = len(todo)
                todo.append(pair)
            row.append(at[pair])
        arcs.append(tuple(row))
    return Machine(tuple(arcs), tuple(a.marks[i] + b.marks[j] for i, j in todo))


CHANNELS = ("insult", "insult_target", "threat", "threat_target", "negated", "reported")
STEM_LENGTHS = range(4, 9)
#: Longer runs of letters count by their beginnings only.
LONGEST_WORD = 64
#: Candidates of a round are the features of the largest likelihood ratio (of their toxic share against the
#: sample's), at least LEAST_DEVIANCE.
MAX_CANDIDATES = 3000
LEAST_DEVIANCE = 12.0
MAX_LEXICON = 500
REPEAT_DISCOUNT = 0.5
#: A feature is taken if the lower confidence bound of its toxic share, at equal numbers of both values, is this.
LEAST_BOUND = 0.7
DEVIATIONS = 1.645
#: ... and if its toxic share over all labelled learning rows, at equal numbers again, is this.
LEAST_SHARE = 0.98
#: Log-odds of a feature that no clean text has: how often it occurs does not count.
MAX_WEIGHT = math.log(99)
#: A longer beginning (or the whole word) is taken instead where it keeps this share of the gain.
NESTED_SHARE = 0.9
CLEAN_PENALTY = 2.0
THREAT_WEIGHT = 1.0

_CLAUSE_END = re.compile(r"[.!?;:\n]+")
_TOKEN = re.compile(r"\w+")
_WORD = re.compile(r"[^\W\d_]+")


def stems(text: str) -> list[str]:
    """Distinct ``=word`` and ``word-beginning*`` features of a text."""
    words = set(_WORD.findall(text.lower()))
    out = {f"={w}" for w in words if 2 <= len(w) <= LONGEST_WORD}
    out |= {f"{w[:k]}*" for w in words for k in STEM_LENGTHS if k < len(w)}
    return sorted(out)


def log_odds(t: int, c: int, toxic: int, clean: int) -> float:
    """Log-odds of toxic at equal numbers of both values, at most MAX_WEIGHT."""
    return min(MAX_WEIGHT, math.log(t / toxic) - math.log(c / clean)) if c else MAX_WEIGHT


def lower_bound(t: np.ndarray, c: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Wilson's lower bound of the toxic share of a feature's texts, carried to equal numbers of both values."""
    n, zz = np.maximum(t + c, 1e-9), DEVIATIONS**2
    share = t / n
    low = np.maximum((share + zz / (2 * n) - DEVIATIONS * np.sqrt(share * (1 - share) / n + zz / (4 * n * n))) / (1 + zz / n), 0.0)
    odds = low / np.maximum(1 - low, 1e-9) * clean / toxic
    return odds / (1 + odds)


def choose_lexicon(names: list[str], counts: list[tuple[int, int]], has: np.ndarray, y: np.ndarray, sizes: tuple[int, int] | None = None) -> dict[str, float]:
    """Greedy cover of the toxic texts by words and beginnings, with discounted repeats.

    has: text x feature incidence; counts: (toxic, clean) texts with each feature; sizes: (toxic, clean) texts of
    the sample, of which ``has`` may lack explained ones. Every pick lowers the
    worth of the texts that it explains, so features that only come along with the true ones (copies of a
    toxic text share all their words) gain little. A feature is taken if the texts that are left to it bear out
    LEAST_BOUND, however few they are beside those of other features. Of nested features the longest that keeps
    NESTED_SHARE of the gain is taken and the others are out.
    """
    toxic, clean = sizes or (int(y.sum()), int(len(y) - y.sum()))
    worth = y.astype(np.float32).copy()
    cleans = has[y == 0].sum(axis=0, dtype=np.float32)
    penalty = CLEAN_PENALTY * cleans
    length = np.array([(f[0] == "=", len(f)) @ np.array([100, 1]) for f in names], dtype=np.float32)
    out: dict[str, float] = {}
    as_float = has.astype(np.float32)
    while len(out) < MAX_LEXICON and len(names):
        left = worth @ as_float
        gain = np.where(lower_bound(left, cleans, toxic, clean) >= LEAST_BOUND, left - penalty, -np.inf)
        best = int(np.argmax(gain + 1e-5 * length))
        if gain[best] < 1:
            break
        nested = [i for i, f in enumerate(names) if _nested(names[best], f)]
        longer = [i for i in nested if length[i] > length[best] and gain[i] >= NESTED_SHARE * gain[best]]
        best = max(longer, key=lambda i: (length[i], gain[i], -i), default=best)
        out[names[best]] = log_odds(*counts[best], toxic, clean)
        worth[has[:, best]] *= REPEAT_DISCOUNT
        penalty[[i for i in nested if _nested(names[best], names[i])]] = np.inf
        penalty[best] = np.inf
    return out


def _nested(f: str, g: str) -> bool:
    a, b = (x[1:] if x[0] == "=" else x[:-1] for x in (f, g))
    return a.startswith(b) or b.startswith(a)


class Grammar:
    """The composed transducer with a learned insult lexicon."""

    def __init__(self, lexicon: dict[str, float], classes: WordClasses = WordClasses()):
        self.words = {f[1:]: w for f, w in lexicon.items() if f[0] == "="}
        self.heads = {f[:-1]: w for f, w in lexicon.items() if f[0] != "="}
        self.classes = {w: k for k, ws in ((REPORTER, classes.reporters), (NEGATOR, classes.negators), (TARGET, classes.targets), (THREAT, classes.threats)) for w in ws}
        self.right = scope(TARGET, TARGET_SCOPE)
        self.left = compose(compose(scope(REPORTER, REPORT_SCOPE), scope(NEGATOR, NEGATION_SCOPE)), self.right)
        #: channel of a match of kind 0 (insult) or 1 (threat), by left state and right state
        self.emit = [[[self.channel(*left, *right, kind) for kind in (0, 1)] for right in self.right.marks] for left in self.left.marks]
        self.finder = ahocorasick.Automaton()
        for w in {*self.words, *self.heads, *classes.threats}:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    @staticmethod
    def channel(reported: bool, negated: bool, target_before: bool, target_after: bool, kind: int) -> int:
        return 5 if reported else 4 if negated else 2 * kind + (target_before or target_after)

    def insult(self, token: str) -> float:
        if token in self.words:
            return self.words[token]
        return max((self.heads[token[:k]] for k in STEM_LENGTHS if token[:k] in self.heads), default=0.0)

    def read(self, tokens: list[str]) -> tuple[list[int], list[float]]:
        """Word class and weight of each word. A threat or insult is that first of all."""
        symbols, weights = [], []
        for t in tokens:
            symbol, w = self.classes.get(t, OTHER), 0.0
            if symbol == THREAT:
                w = THREAT_WEIGHT
            elif w := self.insult(t):
                symbol = INSULT
            symbols.append(symbol)
            weights.append(w)
        return symbols, weights

    def run(self, clause: str, out: list[float]) -> None:
        """Add the weights that the transducer emits on a clause."""
        symbols, weights = self.read(_TOKEN.findall(clause))
        left, right = self.left.states(symbols), self.right.states(reversed(symbols))[::-1]
        for x, w, i, j in zip(symbols, weights, left, right, strict=True):
            if w:
                out[self.emit[i][j][x == THREAT]] += w

    def channels(self, text: str | None) -> list[float]:
        """Summed weights of a text's matched clauses; clauses without a match are never tokenised."""
        out = [0.0] * len(CHANNELS)
        if not text:
            return out
        low = text.lower()
        done = -1
        for end, length in self.finder.iter(low):
            start = end - length + 1
            if start < done or (start and low[start - 1].isalnum()):
                continue
            left = max((low.rfind(c, max(done, 0), start) for c in ".!?;:\n"), default=-1) + 1
            stop = _CLAUSE_END.search(low, start)
            done = stop.end() if stop else len(low)
            self.run(low[left:done], out)
        return out


def inputs(channels: list[list[float]]) -> np.ndarray:
    x = np.asarray(channels, dtype=float).reshape(-1, len(CHANNELS))
    return np.column_stack([np.log1p(x), (x.sum(axis=1) > 0).astype(float)])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the last coefficient is the constant."""
    a = np.column_stack([x, np.ones(len(x))])
    keep = np.diag([ridge] * x.shape[1] + [1e-3])
    b = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + keep, a.T @ (weight * (y - p)) - keep @ b)
        b = b + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _lexicon_round(sample: DataFrame, size: dict[int, int], lexicon: dict[str, float]) -> dict[str, float]:
    """Features for the toxic texts of ``sample`` (label, stems) that have none of ``lexicon``, so that those of frequent
    insults crowd out no rare ones."""
    rest = sample.select("label", "stems")
    if lexicon:
        rest = rest.where((F.col("label") == 0) | ~F.arrays_overlap("stems", F.array(*map(F.lit, lexicon))))
    seen = rest.select("label", F.explode("stems").alias("stem")).groupBy("stem")
    seen = seen.agg(F.sum("label").alias("t"), F.count("*").alias("n")).where((F.col("t") >= 3) & (F.col("t") * 2 >= F.col("n")))
    share = size[1] / (size[0] + size[1])
    c = F.col("n") - F.col("t")
    worth = 2 * (F.col("t") * F.log(F.col("t") / (F.col("n") * share)) + F.when(c > 0, c * F.log(c / (F.col("n") * (1 - share)))).otherwise(0.0))
    best = seen.withColumn("worth", worth).where(F.col("worth") >= LEAST_DEVIANCE).orderBy(F.desc("worth"), "stem").limit(MAX_CANDIDATES)
    ranked = [(r["worth"], r["stem"], r["t"], r["n"] - r["t"]) for r in best.collect()]
    names = [r[1] for r in ranked]
    if not names:
        return {}
    at = {f: i for i, f in enumerate(names)}
    pick = F.pandas_udf(lambda s: s.map(lambda fs: [at[f] for f in fs if f in at]), "array<int>")
    rows = rest.select("label", pick("stems").alias("found")).toPandas()
    y = rows["label"].to_numpy()
    has = np.zeros((len(y), len(names)), bool)
    for i, found in enumerate(rows["found"]):
        has[i, found] = True
    return choose_lexicon(names, [r[2:] for r in ranked], has, y, (size[1], size[0]))


def _having(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(doc_id, found) of the rows that have features of ``lexicon``."""
    finder = Grammar(lexicon).finder
    known = set(lexicon)

    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [f for f in stems(t) if f in known] if t and next(finder.iter(t.lower()), None) else [])

    found = once(features, "array<string>")(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")).where(F.size("found") > 0)


def _confirmed(docs: DataFrame, labels: DataFrame, lexicon: dict[str, float]) -> dict[str, float]:
    """The features that hold over all labelled learning rows; the sample may lack the clean texts that have them."""
    rows = learning_rows(labels, "toxic")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    found = _having(docs, lexicon)
    counts = found.join(rows, "doc_id").select("label", F.explode("found").alias("stem")).groupBy("stem").agg(F.sum("label").alias("t"), F.count("*").alias("n")).collect()
    weights = {r["stem"]: log_odds(r["t"], r["n"] - r["t"], size[1], size[0]) for r in counts if r["t"]}
    least = math.log(LEAST_SHARE / (1 - LEAST_SHARE))
    return {f: weights[f] for f in lexicon if weights.get(f, 0.0) >= least}


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> tuple[dict[str, float], list[float] | None]:
    """(insult lexicon, logistic coefficients) from a bounded labelled sample (see ``samples``); other labels than 0 and 1 are left out."""
    small_batches(docs.sparkSession)
    labels = labels.where(F.col("toxic").isin(0, 1))
    every = F.pandas_udf(lambda s: s.map(lambda t: stems(t or "")), "array<string>")
    sample = labelled_sample(docs, labels, "toxic", rows_per_label)
    sample = cut(sample.select("label", "text", every("text").alias("stems")))  # a bounded table
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (size.get(0) and size.get(1)):
        return {}, None
    lexicon: dict[str, float] = {}
    while more := _lexicon_round(sample, size, lexicon):
        lexicon |= more
    lexicon = _confirmed(docs, labels, lexicon) if lexicon else lexicon
    grammar = Grammar(lexicon)
    emit = F.pandas_udf(lambda s: s.map(grammar.channels), "array<double>")
    rows = sample.select("label", emit("text").alias("x")).toPandas()
    y = rows["label"].to_numpy(dtype=float)
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    return lexicon, fit_logistic(inputs(list(rows["x"])), y, weight).tolist()


@functools.lru_cache(maxsize=4)
def _grammar(lexicon: tuple[tuple[str, float], ...]) -> Grammar:
    return Grammar(dict(lexicon))


def toxicity(text: Column, model: tuple[dict[str, float], list[float] | None]) -> Column:
    """Score from 0 to 1 of a text column."""
    lexicon, b = tuple(model[0].items()), model[1]

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        if b is None:
            return pd.Series(np.zeros(len(batch)))
        x = inputs([_grammar(lexicon).channels(t) for t in batch])
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(b[:-1]) + b[-1], -30, 30))))

    return run(text)
