"""Token counts under a unigram segmentation, with work shared along a trie of pre-tokens.

A pre-token is a word with a leading ``▁``. Its tokens are the segmentation into vocabulary pieces
with the largest sum of log probabilities; a character may also cost its UTF-8 bytes. The vocabulary
file gives the pieces; their probabilities are trained here, from equal ones, by ROUNDS rounds of
expectation and maximisation over the distinct pre-tokens of all documents and their counts (one
shuffle of pre-token and count; the expectation of a round is a sum over the vocabulary).

Distinct pre-tokens are sorted and put into a trie, level by level: a node is a prefix, each prefix
is one node whatever the number of pre-tokens below it. Forward scores are computed once a node from
the nodes some characters above it, for a whole level at once; the terminal node's number of tokens
goes to a table from which the documents' counts are summed. In training, the counts of the terminals
flow back along the same arcs. Counting needs no shuffle: each task makes the trie of the distinct
pre-tokens of DOCS documents at a time. Pre-tokens of over LONG characters are done one by one.

Defined cases: null, empty or blank text has 0 words and 0 tokens; of equal scores the
segmentation with fewer tokens counts; an empty vocabulary leaves bytes only; repeated rows stay; an
empty table gives no rows; extra columns stay out.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, materialize, open_fs, shared_dir

DOCS = 8000
ROUNDS = 2
SMOOTHING = 0.1
LONG = 64
WORDS = 50_000  # in a trie at once
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Vocabulary pieces and their log probabilities; the last score is that of one byte."""

    def __init__(self, pieces: Iterable[str], scores: np.ndarray | None = None):
        self.pieces = list(dict.fromkeys(pieces))
        self.place = {p: i for i, p in enumerate(self.pieces)}
        size = len(self.pieces)
        self.scores = np.full(size + 1, -np.log(size + 256)) if scores is None else scores
        by: dict[int, list[int]] = {}
        ends: dict[str, set[int]] = {}
        for i, p in enumerate(self.pieces):
            by.setdefault(len(p), []).append(i)
            ends.setdefault(p[-1], set()).add(len(p))
        self.ends = {c: tuple(sorted(n)) for c, n in ends.items()}
        self.by_length = {}
        for k, places in sorted(by.items()):
            codes = np.array([[ord(c) for c in self.pieces[i]] for i in places], np.uint64).reshape(-1, k)
            h = np.zeros(len(places), np.uint64)
            for j in range(k):
                h = h * _BASE + codes[:, j]
            order = np.argsort(h)
            self.by_length[k] = h[order], np.array(places)[order]

    @property
    def byte(self) -> float:
        return self.scores[-1]

    # -- one by one, for long words

    def _arcs(self, word: str, i: int) -> Iterator[tuple[int, int]]:
        """(length, piece) of the pieces that end before character i."""
        for k in self.ends.get(word[i - 1], ()):
            if k > i:
                break
            at = self.place.get(word[i - k : i])
            if at is not None:
                yield k, at

    def count_one(self, word: str) -> int:
        best, count = [0.0], [0]
        for i in range(1, len(word) + 1):
            width = len(word[i - 1].encode())
            top, least = best[i - 1] + width * self.byte, count[i - 1] + width
            for k, at in self._arcs(word, i):
                s = best[i - k] + self.scores[at]
                if s > top or s == top and count[i - k] + 1 < least:
                    top, least = s, count[i - k] + 1
            best.append(top)
            count.append(least)
        return count[-1]

    def expect_one(self, word: str, n: float, out: np.ndarray) -> None:
        """Add the expected numbers of pieces (and, last, bytes) in ``n`` times the word."""
        alpha, arcs = [0.0], [[]]
        for i in range(1, len(word) + 1):
            width = len(word[i - 1].encode())
            own = [(i - 1, -1, width, alpha[i - 1] + width * self.byte)] + [(i - k, at, 1, alpha[i - k] + self.scores[at]) for k, at in self._arcs(word, i)]
            top = max(x[3] for x in own)
            total = top + np.log(sum(np.exp(x[3] - top) for x in own))
            alpha.append(total)
            arcs.append([(j, at, m, np.exp(s - total)) for j, at, m, s in own])
        flow = [0.0] * len(word) + [n]
        for i in range(len(word), 0, -1):
            for j, at, m, share in arcs[i]:
                flow[j] += flow[i] * share
                out[at] += flow[i] * share * m

    # -- by trie

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each of the sorted distinct ``words``."""
        out = np.zeros(len(words), np.int64)
        for at, trie in _tries(words, self):
            out[at] = trie.counts(self)
        for i in np.flatnonzero([len(w) > LONG for w in words]):
            out[i] = self.count_one(MARK + words[i])
        return out

    def expected(self, words: list[str], n: np.ndarray) -> np.ndarray:
        """Expected numbers of pieces and bytes in the sorted distinct ``words``, ``n`` times each."""
        out = np.zeros(len(self.scores))
        for at, trie in _tries(words, self):
            trie.expect(self, n[at], out)
        for i in np.flatnonzero([len(w) > LONG for w in words]):
            self.expect_one(MARK + words[i], float(n[i]), out)
        return out

    def trained(self, expected: np.ndarray) -> "Pieces":
        """The pieces with the probabilities that the expected numbers give."""
        n = expected + SMOOTHING
        n[-1] = (expected[-1] + SMOOTHING) / 256
        return Pieces(self.pieces, np.round(np.log(n / (n[:-1].sum() + n[-1] * 256)), 9))


def _tries(words: list[str], pieces: Pieces) -> Iterator[tuple[np.ndarray, "Trie"]]:
    short = np.flatnonzero([len(w) <= LONG for w in words])
    for i in range(0, len(short), WORDS):
        at = short[i : i + WORDS]
        yield at, Trie([MARK + words[j] for j in at], pieces)


class Trie:
    """Prefixes of sorted words, by length. Node 0 is the empty prefix."""

    def __init__(self, words: list[str], pieces: Pieces):
        lens = np.array([len(w) for w in words])
        top = int(lens.max())
        codes = np.array(words, f"<U{top}").view(np.uint32).reshape(len(words), top).astype(np.uint64)
        differs = np.ones((len(words), top), bool)
        differs[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
        node = np.zeros((len(words), top + 1), np.int32)  # of each word's prefixes
        sums = np.zeros((len(words), top + 1), np.uint64)  # running hashes of each word
        self.levels, first = [], 1
        power = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(top + 1)]
        with np.errstate(over="ignore"):
            for d in range(1, top + 1):
                live = lens >= d
                fresh = live & differs[:, d - 1]
                node[:, d] = first - 1 + np.cumsum(fresh)
                sums[:, d] = sums[:, d - 1] * _BASE + codes[:, d - 1]
                rep = np.flatnonzero(fresh)
                own = first + np.arange(len(rep))
                c = codes[rep, d - 1]
                width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
                arcs = []  # (places within the level, nodes above, pieces)
                for k, (hashes, places) in pieces.by_length.items():
                    if k > d:
                        break
                    h = sums[rep, d] - sums[rep, d - k] * power[k]
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    hit = np.flatnonzero(hashes[at] == h)
                    if len(hit):
                        arcs.append((hit, node[rep[hit], d - k], places[at[hit]]))
                self.levels.append((own, node[rep, d - 1], width, arcs))
                first += len(rep)
        self.size = first
        self.terminal = node[np.arange(len(words)), lens]

    def counts(self, pieces: Pieces) -> np.ndarray:
        best, count = np.zeros(self.size), np.zeros(self.size, np.int64)
        for own, up, width, arcs in self.levels:
            top, least = best[up] + width * pieces.byte, count[up] + width
            for at, above, piece in arcs:
                s, n = best[above] + pieces.scores[piece], count[above] + 1
                better = (s > top[at]) | ((s == top[at]) & (n < least[at]))
                top[at[better]], least[at[better]] = s[better], n[better]
            best[own], count[own] = top, least
        return count[self.terminal]

    def expect(self, pieces: Pieces, n: np.ndarray, out: np.ndarray) -> None:
        alpha = np.zeros(self.size)
        for own, up, width, arcs in self.levels:
            total = alpha[up] + width * pieces.byte
            for at, above, piece in arcs:
                total[at] = np.logaddexp(total[at], alpha[above] + pieces.scores[piece])
            alpha[own] = total
        flow = np.zeros(self.size)
        np.add.at(flow, self.terminal, n)
        for own, up, width, arcs in reversed(self.levels):
            passing = flow[own]
            share = passing * np.exp(alpha[up] + width * pieces.byte - alpha[own])
            np.add.at(flow, up, share)
            out[-1] += (share * width).sum()
            for at, above, piece in arcs:
                share = passing[at] * np.exp(alpha[above] + pieces.scores[piece] - alpha[own[at]])
                np.add.at(flow, above, share)
                np.add.at(out, piece, share)


def vocabulary(path: str) -> list[str]:
    """The file's pieces without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


# --------------------------------------------------------------------------- passes

_LOADED: dict[str, Pieces] = {}


def _save(folder: str, pieces: Pieces) -> str:
    fs, root = open_fs(folder)
    name, data = f"pieces-{uuid.uuid4().hex}", io.BytesIO()
    np.savez(data, scores=pieces.scores, pieces=np.array(pieces.pieces or [""]))
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(data.getvalue())
    return name


def _load(folder: str, name: str) -> Pieces:
    if name not in _LOADED:
        _LOADED.clear()
        fs, root = open_fs(folder)
        with fs.open_input_file(f"{root}/{name}") as f, np.load(io.BytesIO(f.read())) as x:
            _LOADED[name] = Pieces([p for p in x["pieces"].tolist() if p], x["scores"])
    return _LOADED[name]


def _distinct(column) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct words; for each word of the column its place among them; numbers of words by row and by distinct word."""
    h, n, data, first, end = hashed_words(column, lower=False, spans=True)
    keys, at, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    raw = data.tobytes()
    words = [raw[a:b].decode() for a, b in zip(first[at].tolist(), end[at].tolist())]
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return [words[i] for i in order], place[which], n, times[order]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, DOCS):
            words, _, _, times = _distinct(whole.column("text").slice(at, DOCS))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(times)], names=["word", "n"])


def _expected(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(folder, name)
        total = np.zeros(len(pieces.scores))
        for b in batches:
            total += pieces.expected(b.column("word").to_pylist(), b.column("n").to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    return run


def train(texts: DataFrame, pieces: list[str], folder: str) -> str:
    """Name of the saved pieces with probabilities from all ``texts``; the driver gets one number a piece and round."""
    words = texts.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).sortWithinPartitions("word")
    words = materialize(words, "pre-tokens")
    model = Pieces(pieces)
    for _ in range(ROUNDS):
        total = np.zeros(len(model.scores))
        for r in words.mapInArrow(_expected(folder, _save(folder, model)), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            total[r["piece"]] = r["n"]
        model = model.trained(total)
    return _save(folder, model)


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_tokens."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = shared_dir(docs.sparkSession, "unigrams")
    name = train(texts, vocabulary(vocabulary_path), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(folder, name)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                b = whole.slice(at, DOCS)
                words, place, n, _ = _distinct(b.column("text"))
                row = np.repeat(np.arange(b.num_rows), n)
                tokens = np.bincount(row, pieces.counts(words)[place] if words else [], b.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return texts.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
