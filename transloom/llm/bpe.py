"""Operator 9: byte-pair encoding and decoding with a contiguous rank array.

A text is cut at white space into short words. For each word the encoder holds its parts and, beside
them, one contiguous array with the merge rank of every adjacent pair. It scans the array for the
minimum, deletes the boundary there and refreshes the ranks of the two neighbours, until no pair can
merge. The different words of a run of texts are merged many abreast (``ManyWords``), as rows of one
array; words repeat, so each Python worker keeps a bounded memo from word to ids. A scan is quadratic
in the length of a piece, so pieces of more than LONG bytes take the same merges from a heap.

Defined cases: a null text encodes as the empty text (no ids, empty decoded text); repeated rows give
repeated results; texts and words of any length are encoded whole, in n log n; of equal ranks the
leftmost merges first; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from transloom.llm.common import small_batches

#: Words in each of the two generations of a worker's memo; bounds a worker's memory.
MEMO_WORDS = 1 << 18
#: Characters of texts whose words are looked up together (a longer text is a run of its own).
RUN_CHARS = 1 << 20
#: Pieces of more bytes are merged one by one, with a heap.
LONG = 64
NO_RANK = (1 << 31) - 1

_NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder for one vocabulary file with word ends (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        letters = byte_characters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + self.suffix] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.stand_in: dict[str, str] = {}

    def split_word(self, word: str) -> list[str]:
        """The pieces of a word. Letters and numbers from U+0250 on are told by the tokenizers library's
        own character classes (its Unicode version may be older than the regex module's) and matched
        through stand-ins of the same class."""
        if word.isascii() or max(word) < "\u0250":
            return self.pieces.findall(word)
        for c in set(word) - self.stand_in.keys():
            self.stand_in[c] = c if c < "\u0250" else "\u0101" if _is_class(c, r"\p{L}") else "\u00b2" if _is_class(c, r"\p{N}") else "\u00a1"
        return [word[m.start() : m.end()] for m in self.pieces.finditer("".join(map(self.stand_in.__getitem__, word)))]

    def piece_ids(self, piece: bytes) -> list[int]:
        """Merge one piece; ``ranks[i]`` belongs to the boundary between ``parts[i]`` and ``parts[i + 1]``."""
        table = self.ranks
        parts = [self.inner[b] for b in piece[:-1]]
        parts.append(self.last[piece[-1]])
        if len(parts) > LONG:
            return self._long_ids(parts)
        none = (NO_RANK, -1)
        ranks = [table.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = table.get((best[1], parts[i + 1]), none)
            if i:
                ranks[i - 1] = table.get((parts[i - 1], best[1]), none)
        return parts

    def _long_ids(self, parts: list[int]) -> list[int]:
        """The same merges in n log n: a heap of (rank, left part) over linked parts; a stale entry is passed over."""
        table, end = self.ranks, len(parts)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(table[pair][0], i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in table]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= end:
                continue
            found = table.get((parts[i], parts[j]))
            if found is None or found[0] != rank:
                continue
            parts[i], parts[j] = found[1], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < end and (pair := table.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (pair[0], a))
        return [p for p in parts if p >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))


class ManyWords:
    """The same merging, many words abreast: one row of parts and one of adjacent ranks for each word.

    Every step finds each row's least rank, deletes that boundary and refreshes the ranks on both sides of it;
    rows that cannot merge leave. Ranks come from an open-addressing table over pairs. Rows of a block have
    about the same width and a block has CELLS cells at most; pieces of over LONG bytes are merged one by one
    with a heap over linked boundaries.
    """

    BITS = 19
    CELLS = 1 << 18
    WIDTHS = (6, 8, 10, 12, 16, 24, 40, LONG)

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        # two ids in one key: 16 bits each where the vocabulary fits
        self.half = 16 if max(bpe.token) < (1 << 16) - 1 else 32
        self.key = np.dtype(np.uint32 if self.half == 16 else np.uint64)
        self.none = self.key.type((1 << self.half) - 1)  # no id
        self.empty = ~self.key.type(0)
        self.inner, self.last = np.array(bpe.inner, self.key), np.array(bpe.last, self.key)
        size = 1 << self.BITS
        self.keys, self.ranks = np.full(size, self.empty), np.full(size, NO_RANK, np.int32)
        self.merged = np.zeros(len(bpe.ranks), self.key)
        keys = np.array([a << self.half | b for a, b in bpe.ranks], self.key)
        todo = np.arange(len(keys))
        rank, new = (np.array([x[i] for x in bpe.ranks.values()]) for i in (0, 1))
        self.merged[rank] = new
        at = self._slot(keys)
        while len(todo):  # of those that want one free slot the first takes it, the others move on
            free = self.keys[at[todo]] == self.empty
            _, first = np.unique(at[todo], return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = free[first]
            self.keys[at[todo[wins]]], self.ranks[at[todo[wins]]] = keys[todo[wins]], rank[todo[wins]]
            todo = todo[~wins]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        odd = self.key.type(0x9E3779B1 if self.half == 16 else 0x9E3779B97F4A7C15)
        return ((key * odd) >> self.key.type(2 * self.half - self.BITS)).astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NO_RANK for those that do not merge (no id never does)."""
        key = (a << self.key.type(self.half)) | b
        at = self._slot(key)
        found = self.keys[at]
        out = self.ranks[at]
        miss = found != key
        out[miss] = NO_RANK
        todo = np.nonzero(miss & (found != self.empty))[0]
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != self.empty)]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each piece); no piece is empty."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        count = np.zeros(len(pieces), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (piece of each id, ids)
        for i in np.nonzero(size > LONG)[0].tolist():
            ids = self.bpe.piece_ids(pieces[i])
            count[i] = len(ids)
            found.append((np.full(len(ids), i), np.array(ids, self.key)))
        for lo, hi in zip((0, *self.WIDTHS), self.WIDTHS, strict=False):
            mine = np.nonzero((size > lo) & (size <= hi))[0]
            step = max(1, self.CELLS // (hi + 1))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                ids, n = self._rows([pieces[i] for i in some.tolist()], size[some], hi + 1)
                count[some] = n
                found.append((np.repeat(some, n), ids))
        if not found:
            return np.empty(0, self.key), count
        # to the order of pieces: ids of one piece are together and in order already
        flat = np.empty(int(count.sum()), self.key)
        start = np.cumsum(count) - count
        for owner, ids in found:
            first = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
            flat[start[owner] + np.arange(len(owner)) - begin] = ids
        return flat, count

    def _rows(self, words: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        row, col = np.arange(len(words)), np.arange(width)
        parts = np.where(col < size[:, None], self.inner[raw], self.none)
        parts[row, size - 1] = self.last[raw[row, size - 1]]
        ranks = np.full(parts.shape, NO_RANK, np.int32)
        ranks[:, :-1] = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), -1)
        done, live = parts.copy(), row
        while len(live):
            i = ranks.argmin(axis=1)
            row = np.arange(len(live))
            best = ranks[row, i]
            go = best != NO_RANK
            if not go.all():
                done[live[~go]] = parts[~go]
                live, parts, ranks, i, best = live[go], parts[go], ranks[go], i[go], best[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            # delete the boundary's own rank and the part after it
            keep = col != i[:, None]
            ranks[:, :-1] = ranks[keep].reshape(len(live), -1)
            ranks[:, -1] = NO_RANK
            keep[row, i], keep[row, i + 1] = True, False
            parts[:, :-1] = parts[keep].reshape(len(live), -1)
            parts[:, -1] = self.none
            parts[row, i] = self.merged[best]
            ranks[row, i] = self.rank(parts[row, i], parts[row, i + 1])
            left = np.nonzero(i > 0)[0]
            ranks[left, i[left] - 1] = self.rank(parts[left, i[left] - 1], parts[left, i[left]])
        held = done != self.none
        return done[held], held.sum(axis=1)


class Encoder:
    """Ids of many texts at once: each different word of a run is looked up or merged once.

    A run's words are dictionary-encoded, looked up in a memo of two generations (when the young one is full it
    becomes the old one, so words that are still met stay), the missing ones are cut into pieces and merged many
    abreast, and the texts' ids are gathered from those of their words. Texts below U+0250 are normalised whole.
    Plain punctuation after a letter or digit is always a piece of its own, so it is set apart first and the
    memo holds words without it.
    """

    MARKS = ".,;:!?"
    _GLUED = re.compile(r"[.,;:!?](?<=[^\w\s].|_.)")
    _WIDE = re.compile("[\u0250-\U0010ffff]")

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.bpe = codec(path)
        self.many = ManyWords(self.bpe)
        self.kind = np.dtype("<u2" if self.many.half == 16 else "<u4")
        self.memo_words = memo_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.special = re.compile("|".join(map(re.escape, [*self.bpe.added, *"\x1c\x1d\x1e\x1f"])))
        self.tokens = pa.array([self.bpe.token.get(i, "") for i in range(max(self.bpe.token) + 1)], pa.string())

    def forget(self) -> None:
        """Empty the memo (at the end of a partition)."""
        self.young, self.old = {}, {}

    def word_pieces(self, word: str) -> list[str]:
        if word.isascii() or not self._WIDE.search(word):
            return self.bpe.pieces.findall(unicodedata.normalize("NFC", word).lower())
        return self.bpe.split_word(_NORMAL.normalize_str(word))

    def merge(self, words: list[str]) -> list[bytes]:
        """Packed ids of words, merged anew."""
        lists = [[w] if w.isascii() and w.isalpha() and w.islower() else self.word_pieces(w) for w in words]
        flat, count = self.many.encode([p.encode() for ps in lists for p in ps])
        data = flat.astype(self.kind, copy=False).tobytes()
        ends = np.r_[0, np.cumsum(count)] * self.kind.itemsize
        at = ends[np.r_[0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]].tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def look_up(self, words: list[str]) -> list[bytes]:
        """Packed ids of different words."""
        ids: list[bytes | None] = list(map(self.young.get, words))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if self.old and gaps:
            for i in gaps:
                ids[i] = self.old.get(words[i])
            self.young.update((words[i], ids[i]) for i in gaps if ids[i] is not None)
            gaps = [i for i in gaps if ids[i] is None]
        new = [words[i] for i in gaps]
        for i, x in zip(gaps, self.merge(new), strict=True):
            ids[i] = x
        self.young.update(zip(new, map(ids.__getitem__, gaps), strict=True))
        if len(self.young) > self.memo_words:
            self.old, self.young = self.young, {}
        return ids

    def prepared(self, t: str) -> str | None:
        """The text with its words between white space; None if it must be read in another way."""
        if self.special.search(t):
            return None
        if not t.isascii():
            if self._WIDE.search(t):
                return t
            t = unicodedata.normalize("NFC", t)
        t = t.lower()
        if not self._GLUED.search(t):
            for mark in self.MARKS:
                t = t.replace(mark, f" {mark}")
        return t

    def slowly(self, t: str) -> np.ndarray:
        """Ids of a text with added tokens or with the white space that only str.split knows."""
        out: list[bytes] = []

        def plain(part: str) -> None:
            words = [w for w in (regex.split(r"\s+", part) if _ODD_SPACE.search(part) else part.split()) if w]
            different = list(dict.fromkeys(words))
            found = dict(zip(different, self.look_up(different), strict=True))
            out.extend(map(found.__getitem__, words))

        at = 0
        for m in self.bpe.added_pattern.finditer(t) if self.bpe.added_pattern else ():
            plain(t[at : m.start()])
            out.append(np.array([self.bpe.added[m[0]]], self.kind).tobytes())
            at = m.end()
        plain(t[at:])
        return np.frombuffer(b"".join(out), self.kind)

    def encode_many(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(offsets, flat ids) of runs of whole texts, in order; a run has RUN_CHARS characters or one text."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= RUN_CHARS):
                chars += len(texts[end])
                end += 1
            yield self._run(texts[at:end])
            at = end

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return [i for _, flat in self.encode_many([text]) for i in flat.tolist()]

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ready = [self.prepared(t) for t in texts]
        split = pc.utf8_split_whitespace(pa.array([t or "" for t in ready], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        # one string split by Python costs far less than a Python string made of each Arrow value
        line = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar("\n", pa.large_string()))
        words = line[0].as_py().split("\n") if len(coded.dictionary) else []
        hollow = words.index("") if "" in words else -1  # white space at a text's end leaves an empty word
        ids = self.look_up([w for w in words if w])
        if hollow >= 0:
            ids.insert(hollow, b"")
        flat = np.frombuffer(b"".join(ids), self.kind)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        which = coded.indices.to_numpy()
        n = size[which]
        total = np.r_[0, np.cumsum(n)]
        first = np.cumsum(size) - size
        gathered = flat[np.repeat(first[which] - total[:-1], n) + np.arange(total[-1])]
        ends = total[split.offsets.to_numpy()]
        if None not in ready:
            return ends, gathered
        parts = [gathered[a:b] if r is not None else self.slowly(t) for t, r, a, b in zip(texts, ready, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return np.r_[0, np.cumsum([len(x) for x in parts])], np.concatenate(parts)

    def decode_many(self, offsets: np.ndarray, flat: np.ndarray) -> pa.Array:
        """Texts of runs of ids: their tokens between spaces."""
        tokens = self.tokens.take(pa.array(flat))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")


@functools.lru_cache(maxsize=8)
def _class_splitter(pattern: str) -> pre_tokenizers.Split:
    return pre_tokenizers.Split(Regex(pattern), "removed")


def _is_class(char: str, pattern: str) -> bool:
    return not _class_splitter(pattern).pre_tokenize_str(char)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One codec per worker process and vocabulary file."""
    return WordBpe(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text; one narrow pass, no shuffle."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        for batch in batches:
            at = 0
            for offsets, flat in words.encode_many(batch.column(1).to_pylist()):
                n = len(offsets) - 1
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), ids, words.decode_many(offsets, flat)], ["doc_id", "ids", "decoded"])
                at += n
        words.forget()

    return base.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The digest columns that the registered query returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
