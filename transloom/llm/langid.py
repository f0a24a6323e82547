"""Operator 3: language identification by multilingual mixture inference.

The model is a table of hashed letter-trigram counts per language, counted over every learning row on
Spark (one map-side table per task, then a sum). A text is seen as a mixture of languages:
expectation-maximisation estimates the proportions from trigram likelihoods until they settle, nested language
sets (the strongest one, the strongest two, and so on up to all) are compared by penalised log-likelihood, and the
strongest language of the chosen set is the prediction; its share is the score. No set can fit better than the
full mixture, so a text leaves as soon as the penalty of the next size outweighs what is left to gain: there is
no limit on languages, and most texts are done after one or two.

Defined cases: a null text, or one without a letter, gives ``und`` and 0.0; so does every text when no
row could be learned from, and every text of an empty table gives no row. Equal shares go to the language that sorts
first; repeated rows get equal results. Texts are read whole; a long one is counted in pieces of CHUNK_CHARS that see the letters
beside their edges, so that a cut anywhere, in a run of letters too, gives the counts of the whole. Other columns of the
table, whatever their names, are not read.

The model is sparse: a language has entries for the cells that it was seen in and one value for all others. A task works on
so many texts at once that their cells x languages stay bounded; one text alone has CELLS x languages at most.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import small_batches

#: Trigrams are hashed into 2**GRAM_BITS cells, which bounds the model to cells x languages.
GRAM_BITS = 16
CELLS = 1 << GRAM_BITS
#: Characters that are worked on at once in a task.
CHUNK_CHARS = 1 << 20
SMOOTHING = 0.05
#: Shares have settled when a round of EM_ROUND steps moves none of a text's by SETTLED; EM_ROUNDS at most.
EM_ROUND, EM_ROUNDS, SETTLED = 4, 16, 1e-3
#: Languages for which CHUNK_CHARS are worked on at once; with more of them, fewer characters are.
CHUNK_LANGUAGES = 16
#: A further language must lift the log-likelihood by this many times half the log of the trigram count.
PENALTY = 8.0


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(low: list[str]) -> np.ndarray:
    return np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _gram_cells(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is a letter, cell of the trigram around it) of every character; what is no letter counts as a space."""
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    space = np.array([32], np.uint32)
    with np.errstate(over="ignore"):
        mixed = np.r_[space, codes[:-1]] * np.uint32(0x9E3779B1) ^ codes * np.uint32(0x85EBCA77) ^ np.r_[codes[1:], space] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
    return letter, mixed >> np.uint32(32 - GRAM_BITS)


def gram_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, cell) of every trigram whose middle is a letter; runs of other characters count as one space."""
    low = [t.lower() for t in texts]
    letter, cell = _gram_cells(_codes(low))
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    return owner[letter], cell[letter]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, cell, count) of the distinct trigrams, in order. A text longer than CHUNK_CHARS is counted in
    pieces that overlap by a character on either side."""
    keys, counts = [], []
    for i, t in enumerate(texts):
        if len(t) > CHUNK_CHARS:
            # lower-cased as a whole, since the case of some letters depends on their neighbours
            low, table = t.lower(), np.zeros(CELLS, np.int64)
            for at in range(0, len(low), CHUNK_CHARS):
                before, end = min(at, 1), min(len(low), at + CHUNK_CHARS)
                letter, cell = _gram_cells(_codes([low[at - before : end + 1]]))
                mine = slice(before, before + end - at)
                table += np.bincount(cell[mine][letter[mine]], minlength=CELLS)
            cells = np.nonzero(table)[0]
            keys.append((np.int64(i) << GRAM_BITS) | cells)
            counts.append(table[cells])
    short = [t if len(t) <= CHUNK_CHARS else "" for t in texts]
    owner, cell = gram_cells(short)
    key, n = np.unique((owner.astype(np.int64) << GRAM_BITS) | cell, return_counts=True)
    if keys:
        key, n = np.concatenate([key, *keys]), np.concatenate([n, *counts])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    return key >> GRAM_BITS, key & (CELLS - 1), n


def chunks(texts: list[str], languages: int = 1) -> Iterator[tuple[int, list[str]]]:
    """(first number, texts) runs of about CHUNK_CHARS characters, fewer with many languages; a longer text is a run of its own."""
    start, size, most = 0, 0, CHUNK_CHARS * CHUNK_LANGUAGES // max(CHUNK_LANGUAGES, languages)
    for i, t in enumerate(texts):
        if size and size + len(t) >= most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


class Cells:
    """Probability of each cell by language, from a language's counts: ``cells[numbers]`` has a row for each number."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """counts: (cells, how often each) of each language."""
        total = np.array([n.sum() + SMOOTHING * CELLS for _, n in counts], float)
        self.unseen = (SMOOTHING / total).astype(np.float32)
        cell = np.concatenate([np.empty(0, np.int64), *[c for c, _ in counts]])
        order = np.argsort(cell, kind="stable")
        self.first = np.searchsorted(cell[order], np.arange(CELLS + 1))
        self.lang = np.repeat(np.arange(len(counts), dtype=np.int32), [len(c) for c, _ in counts])[order]
        self.p = np.concatenate([np.empty(0, np.float32), *[((n + SMOOTHING) / t).astype(np.float32) for (_, n), t in zip(counts, total, strict=True)]])[order]

    def __getitem__(self, cells: np.ndarray) -> np.ndarray:
        size = self.first[cells + 1] - self.first[cells]
        row = np.repeat(np.arange(len(cells)), size)
        entry = np.arange(len(row)) + np.repeat(self.first[cells] - np.cumsum(size) + size, size)
        out = np.tile(self.unseen, (len(cells), 1))
        out[row, self.lang[entry]] = self.p[entry]
        return out


def fit(docs: DataFrame, where: Column, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], Cells]:
    """(languages, probability of each cell by language). A row for each language reaches the driver, with CELLS entries at most."""
    small_batches(docs.sparkSession)
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in table.items():
                cells = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(n[cells])], ["lang", "cell", "n"])
            table.clear()

        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for _, some in chunks(texts):
                    _, cell, n = counted(some)
                    got = np.bincount(cell, weights=n, minlength=CELLS).astype(np.int64)
                    table[lang] = table[lang] + got if lang in table else got
            if len(table) > 64:
                yield from flush()
        yield from flush()

    counts = rows.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("counts")).toArrow().sort_by("lang")
    found = [row.values for row in by_lang.column("counts")]
    return by_lang.column("lang").to_pylist(), Cells([(c.field("cell").to_numpy().astype(np.int64), c.field("n").to_numpy()) for c in found])


def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Settled mixture shares of each text and its log-likelihood; a share of 0 stays 0. Texts leave as they settle."""
    size = np.diff(np.r_[starts, len(n)])
    share, live = share.copy(), np.arange(len(starts))
    pp, nn, ss, now = p, n, starts, share
    for _ in range(EM_ROUNDS if share.shape[1] > 1 else 0):
        owner = np.repeat(np.arange(len(live)), size[live])
        total = np.add.reduceat(nn, ss)[:, None]
        old = now
        for _ in range(EM_ROUND):
            part = now[owner]
            part *= pp
            part *= (nn / np.maximum(part.sum(axis=1), 1e-30))[:, None]
            now = np.add.reduceat(part, ss, axis=0) / total
        moves = np.abs(now - old).max(axis=1) > SETTLED
        share[live] = now
        if not moves.any():
            break
        if not moves.all():
            rows = moves[owner]
            live, pp, nn, now = live[moves], pp[rows], nn[rows], now[moves]
            ss = np.cumsum(size[live]) - size[live]
    mixed = np.einsum("ij,ij->i", p, share[np.repeat(np.arange(len(starts)), size)])
    return share, np.add.reduceat(n * np.log(np.maximum(mixed, 1e-30)), starts)


def infer(texts: list[str], langs: list[str], table: Cells) -> tuple[list[str], list[float], list[list[str]], list[list[float]], list[float]]:
    """Prediction, score, chosen languages, their shares, and the gain over chance (nats a trigram) of each text."""
    pred, score, gain = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    chosen, shares = [[] for _ in texts], [[] for _ in texts]
    for first, some in chunks(texts, len(langs)) if langs else ():
        owner, cell, count = counted(some)
        if not len(owner):
            continue
        p, n = table[cell], count.astype(np.float32)
        starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
        who, size = owner[starts], np.diff(np.r_[starts, len(owner)])
        full, most = _em(p, n, starts, np.full((len(who), len(langs)), 1 / len(langs), np.float32))
        order = np.argsort(-full, axis=1, kind="stable")
        total = np.add.reduceat(n, starts)
        half_log = np.log(np.maximum(total, 2)) / 2
        best, raw, share = np.full(len(who), -np.inf), np.full(len(who), -np.inf), np.zeros_like(full)
        for k in range(1, len(langs) + 1):
            # no set beats the full mixture (its settled likelihood, with a little for what was left unsettled)
            todo = np.nonzero(most + SETTLED * total - PENALTY * (k - 1) * half_log > best)[0]
            if not len(todo):
                break
            rows = np.repeat(np.isin(np.arange(len(who)), todo), size)
            top = order[todo, :k]
            # the set's own columns only
            mine = np.take_along_axis(p[rows], np.repeat(top, size[todo], axis=0), axis=1)
            start = np.maximum(np.take_along_axis(full[todo], top, axis=1), 1e-3)
            start /= start.sum(axis=1, keepdims=True)
            got, fits = _em(mine, n[rows], np.cumsum(size[todo]) - size[todo], start)
            value = fits - PENALTY * (k - 1) * half_log[todo]
            better = value > best[todo]
            wide = np.zeros((int(better.sum()), full.shape[1]), full.dtype)
            np.put_along_axis(wide, top[better], got[better], axis=1)
            share[todo[better]], best[todo[better]], raw[todo[better]] = wide, value[better], fits[better]
        over = raw / total + np.log(CELLS)
        for row, i in enumerate((who + first).tolist()):
            top = int(np.argmax(share[row]))
            ranked = [j for j in order[row] if share[row, j] > 0]
            pred[i], score[i], gain[i] = langs[top], float(min(1.0, max(0.0, share[row, top]))), float(over[row])
            chosen[i], shares[i] = [langs[j] for j in ranked], [float(share[row, j]) for j in ranked]
    return pred, score, chosen, shares, gain


def identify(text: Column, model: tuple[list[str], Cells]) -> Column:
    """struct(lang_pred, score, languages, shares, gain) of a text column."""
    langs, table = model

    @F.pandas_udf("lang_pred string, score double, languages array<string>, shares array<double>, gain double")
    def run(batch: pd.Series) -> pd.DataFrame:
        pred, score, chosen, shares, gain = infer([t or "" for t in batch], langs, table)
        return pd.DataFrame({"lang_pred": pred, "score": score, "languages": chosen, "shares": shares, "gain": gain})

    return run(text)
