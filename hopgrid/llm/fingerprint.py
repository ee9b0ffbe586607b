"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

A text's five-word shingles are hashed once; the top bits of a hash name one of BINS bins and a
bin keeps its least remainder. An empty bin borrows from the bins that a hash of (bin, attempt)
names, at the first that is full, so equal bins borrow alike in every text. The lowest BITS bits
of each bin are packed. Likeness is the share of equal bins, corrected for chance agreement 2^-BITS.

Defined cases: null reads as empty; a text without words has the empty fingerprint, like to itself
(1.0) and to nothing else (0.0); fewer than five words make one shingle; equal texts have equal
fingerprints; rows are taken in order of doc_id, nulls first, then of a hash of the text; a single row follows itself;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_words, materialize, mix64, shingles

SHINGLE = 5
BINS = 512
BITS = 4
ATTEMPTS = 256
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_TRY = (mix64(np.arange(ATTEMPTS * BINS, dtype=np.uint64) + np.uint64(0x51ED270B)) % np.uint64(BINS)).astype(np.int64).reshape(ATTEMPTS, BINS)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_NONE = 255


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Low bits of each text's bins, a row a text; all _NONE for a text without words."""
    h, n = shingles(*hashed_words(pa.array(texts, pa.large_string())), SHINGLE)
    out = np.full((len(texts), BINS), _NONE, np.uint8)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    ends = np.cumsum(n)
    for i in full:  # the top bits name the bin, so a sorted row has its bins' least hashes first in each run
        h[ends[i] - n[i] : ends[i]].sort()
    cell = np.repeat(np.arange(len(full)), n[full]) * BINS + (h >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    least = np.full(len(full) * BINS, _EMPTY)
    least[cell[first]] = h[first] & ((np.uint64(1) << _SHIFT) - np.uint64(1))
    values = least.copy()
    open_ = np.flatnonzero(least == _EMPTY)
    for attempt in range(ATTEMPTS):
        if not len(open_):
            break
        base, cell = open_ - open_ % BINS, open_ % BINS
        got = least[base + _TRY[attempt, cell]]
        values[open_] = got
        open_ = open_[got == _EMPTY]
    for step in range(1, BINS):  # very few shingles: the next full bin around
        if not len(open_):
            break
        got = least[open_ - open_ % BINS + (open_ + step) % BINS]
        values[open_] = got
        open_ = open_[got == _EMPTY]
    out[full] = (mix64(values) & np.uint64((1 << BITS) - 1)).astype(np.uint8).reshape(-1, BINS)
    return out


def packed(prints: np.ndarray) -> list[bytes]:
    """Two bins a byte; empty for a text without words."""
    return [b"" if none else p.tobytes() for none, p in zip((prints[:, 0] == _NONE).tolist(), (prints[:, 0::2] << 4) | prints[:, 1::2])]


def unpacked(prints: list[bytes]) -> np.ndarray:
    out = np.full((len(prints), BINS), _NONE, np.uint8)
    for row, p in zip(out, prints):
        if p:
            x = np.frombuffer(p, np.uint8)
            row[0::2], row[1::2] = x >> 4, x & 15
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of the shingle sets behind fingerprints, row by row, 0 to 1: the share of
    equal bins without chance agreement."""
    same = (a == b).mean(1)
    chance = 2.0**-BITS
    found = np.clip((same - chance) / (1.0 - chance), 0.0, 1.0)
    return np.where((a[:, 0] == _NONE) | (b[:, 0] == _NONE), same == 1.0, found)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by as many of ``following``'s first."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, kind string, part int, text string"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string())
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _finish(rows: list[tuple], prints: np.ndarray, following: list[str], next_prints: np.ndarray) -> list[tuple]:
    """Result rows of (doc_id, text) and their fingerprints, with the following texts and theirs."""
    changed = [edited(t, n) for (_, t), n in zip(rows, following)]
    new = fingerprints(changed)
    near, near_next = likeness(prints, new).tolist(), likeness(prints, next_prints).tolist()
    return [
        (i, len(t), hashlib.sha256(c.encode()).hexdigest(), fp, cp, x, y)
        for (i, t), c, fp, cp, x, y in zip(rows, changed, packed(prints), packed(new), near, near_next)
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one ordered partition: results for all but the last document, and its first ("head") and last ("tail")."""
    part, last, head = TaskContext.get().partitionId(), None, None

    def end(row: tuple, fp: np.ndarray, kind: str) -> pa.RecordBatch:
        return _batch([(row[0], None, None, packed(fp)[0], None, None, None, kind, part, row[1])])

    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            piece = whole.slice(at, 500)
            rows = list(zip(piece.column("doc_id").to_pylist(), [t or "" for t in piece.column("text").to_pylist()]))
            prints = fingerprints([t for _, t in rows])
            if head is None:
                head = rows[0]
                yield end(head, prints[:1], "head")
            if last:
                rows, prints = [last[0], *rows], np.concatenate([last[1], prints])
            done = _finish(rows[:-1], prints[:-1], [t for _, t in rows[1:]], prints[1:])
            if done:
                yield _batch([(*d, "row", part, None) for d in done])
            last = rows[-1], prints[-1:]
    if last:
        yield end(last[0], last[1], "tail")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = b.to_pydict()
        done = _finish(list(zip(col["doc_id"], col["text"])), unpacked(col["fingerprint"]), col["next_text"], unpacked(col["next_fp"]))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _TYPES)], names=_NAMES[:7])


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # Ranged by the text's hash too, so that rows of one doc_id are split like any others.
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    done = materialize(ordered.mapInArrow(_pass, _OUT), "fingerprints")
    # Two rows for each partition stand at its ends; only their numbers are ordered in one task.
    heads = done.filter("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    tails = done.filter("kind = 'tail'").select("part", "doc_id", "text", "fingerprint")
    order = Window.orderBy("part")
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = tails.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(order), F.min("part").over(everything)))
    joined = tails.join(after, "part").join(heads, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fp")
    ends = joined.mapInArrow(_ends, ", ".join(_OUT.split(", ")[:7]))
    rows = done.filter("kind = 'row'").select(*_NAMES[:7]).unionByName(ends)
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
