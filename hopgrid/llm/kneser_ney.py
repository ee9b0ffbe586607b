"""An interpolated modified Kneser-Ney trigram model of a whole corpus, and the scores of documents by joins with it.

Every word of every training text counts; no word, n-gram or text is left out, and no process holds the model. Two
starts stand before a text and one end after it; the end is predicted, too. A word is its 64-bit hash.

A text's log probability is ``floor`` for each prediction and, for each of its trigrams (a, b, c), a sum of values that
the model may have. With w the back-off weights,

* the middle word has log p(b) - floor, and log w(b) as the context of c (the end is no middle word: a constant);
* the bigram has log p(c|b) - log w(b) - log p(c), what it adds to backing off (its gain);
* the trigram has log p(c|a, b) - log w(a, b) - log p(c|b), and its context log w(a, b).

So one shuffle of trigrams does all: a shard is a range of (b, a) and holds the contexts, trigrams and bigrams of its
middle words. A frequent b spans several shards, each of which gets its bigrams. The ranges come from quantiles.
Trigrams travel as compressed arrays, one for each batch of documents and shard, sorted, equal ones of a batch once.

The counts of trigrams are not kept. Texts are counted first, for discounts and bigrams. Scoring goes through the
shards in SLICES rounds, and a shard counts the training texts' trigrams anew from the requests, which bear both.
The number of rounds is fixed: they divide the disk space, and each reads the texts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folders_so_far, materialize, mix64, release_since

SLICES = 6
COUNT_SLICES = 2  # rounds of counting, at most
SLICE_CHARS = 50_000_000  # texts of fewer characters are done in one round
SHARD_CHARS = 6_000_000  # characters for each shard
BATCH_WORDS, BATCH_DOCS = 400_000, 60_000  # of a request; documents have 16-bit numbers there
PLACES = 100  # of COUNT_ROWS texts, for quantiles
HASH_ROWS, COUNT_ROWS, RECORDS = 200, 500, 2000  # texts at a time, or a worker's memory grows
CLEANUP, BATCHES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
START, END = (x.view(np.int64) for x in mix64(np.array([1 << 41, (1 << 41) + 1], np.uint64)))
_CODEC = pa.Codec("zstd", compression_level=1)
_BLOB = "shard int, batch long, data binary, about binary"
_ANSWER = "batch long, docs binary, sums binary, about binary"


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _turn(a, 21) ^ b


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _turn(a, 42) ^ _turn(b, 21) ^ c


def _place(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where a trigram stands: by its middle word, then its first, then its last; 63 bits."""
    return (((b >> np.uint64(40)) << np.uint64(39)) | ((a >> np.uint64(44)) << np.uint64(19)) | (c >> np.uint64(45))).view(np.int64)


def _shards(place: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, place, "right")


def _spanned(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shards with the middle words ``b``: the index of the word and the shard, for each of both."""
    low = ((b >> np.uint64(40)) << np.uint64(39)).view(np.int64)
    first, last = _shards(low, cuts), _shards(low + ((1 << 39) - 1), cuts)
    n = last - first + 1
    which = np.repeat(np.arange(len(b)), n)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _pack(*arrays: np.ndarray) -> bytes:
    """Compressed arrays; ``_unpack`` needs their types."""
    data = b"".join(x.tobytes() for x in arrays)
    return np.array([len(data), *(x.nbytes for x in arrays)], "<i8").tobytes() + _CODEC.compress(data, asbytes=True)


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    head = np.frombuffer(data, "<i8", len(types) + 1)
    raw = _CODEC.decompress(memoryview(data)[8 * len(head) :], int(head[0]), asbytes=True)
    at = np.r_[0, np.cumsum(head[1:])]
    return [np.frombuffer(raw[i:j], t) for i, j, t in zip(at, at[1:], types)]


def _all(column, *types: str) -> list[np.ndarray]:
    """The arrays of all blobs of a column, joined."""
    parts = [_unpack(x, *types) for x in column.to_pylist()]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, t) for t in types]


def _firsts(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(sorted_[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, reduce(np.logical_or, (x[1:] != x[:-1] for x in sorted_))])


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple:
    """Distinct keys in order, where each is first met in that order's source, and the sums of each one's values."""
    order = np.argsort(keys)
    first = _firsts(keys[order])
    at = order[first]
    return keys[at], at, *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each key, 0 where there is none; ``keys`` are sorted."""
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0.0)


def padded(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the texts that have any, with two starts and an end, and the row of each."""
    has = counts > 0
    size = np.where(has, counts + 3, 0)
    first = (np.cumsum(size) - size)[has]
    out = np.full(int(size.sum()), END.view(np.uint64), np.uint64)
    out[first] = out[first + 1] = START.view(np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    out[np.arange(len(hashes)) + 3 * (np.cumsum(has) - 1)[row] + 2] = hashes
    return out, np.repeat(np.arange(len(counts)), size)


def _parts(batches: Iterator[pa.RecordBatch], words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Padded words of at most COUNT_ROWS texts at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, COUNT_ROWS):
            column = whole.column("text").slice(start, COUNT_ROWS)
            yield padded(*map(np.concatenate, zip(*(words(column.slice(i, HASH_ROWS)) for i in range(0, len(column), HASH_ROWS)))))


def _trigrams(w: np.ndarray, row: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """Trigrams of padded texts with places from ``low`` to below ``high``, by place: a, b, c, row, place."""
    b = (w[1:-1] >> np.uint64(40)).astype(np.int64)
    at = np.flatnonzero((row[2:] == row[:-2]) & (b >= low >> 39) & (b <= high >> 39))
    a, b, c = (w[at + i] for i in range(3))
    place = _place(a, b, c)
    order = np.argsort(place)
    place = place[order]
    order = order[slice(*np.searchsorted(place, [low, high]))]
    return a[order], b[order], c[order], row[at[order]], place[slice(*np.searchsorted(place, [low, high]))]


def _bounds(cuts: np.ndarray, part: int, parts: int) -> tuple[int, int]:
    """The places of round ``part``."""
    ends = [0, *(int(cuts[i * (len(cuts) + 1) // parts - 1]) if i * (len(cuts) + 1) // parts else 0 for i in range(1, parts)), 1 << 63]
    return ends[part], ends[part + 1] - (part + 1 == parts)


def _discounts(ns: list) -> list[float]:
    """Modified Kneser-Ney discounts d1, d2, d3 from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    y = ns[0] / (ns[0] + 2 * ns[1] + 1e-9)
    return [min(max(i - (i + 1) * y * ns[i] / (ns[i - 1] + 1e-9), 0.1), i - 0.1) if ns[i - 1] else 0.75 for i in (1, 2, 3)]


def _seen(counts: DataFrame) -> list:
    return [x or 0 for x in counts.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first()]


def _total_seen(rows: DataFrame) -> list:
    return [x or 0 for x in rows.agg(*(F.sum(F.col("seen")[i]) for i in range(4))).first()]


def _off(d: list[float]) -> Column:
    return F.when(F.col("n") >= 3, d[2]).when(F.col("n") == 2, d[1]).otherwise(d[0])


def _cut(n: np.ndarray, d: list[float]) -> np.ndarray:
    """The discount of each count."""
    return np.array(d)[np.minimum(n, 3).astype(np.int64) - 1]


# --------------------------------------------------------------------------- ranges


def _places(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, words):
            *_, place = _trigrams(*part, 0, (1 << 63) - 1)
            place = place[_firsts(place)]
            yield pa.RecordBatch.from_arrays([pa.array(place[:: len(place) // PLACES + 1])], names=["place"])

    return run


def ranges(texts: DataFrame, words, shards: int) -> np.ndarray:
    """Places that cut the texts' trigrams into about ``shards`` shards of about equal size. Only the sizes hang on them,
    so, as for any range partitioning, they come from a part of the texts."""
    if shards < 2:
        return np.empty(0, np.int64)
    some = texts.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(8)) == 0)
    at = some.mapInArrow(_places(words), "place long").agg(F.percentile_approx("place", [i / shards for i in range(1, shards)], max(10_000, 20 * shards))).first()[0]
    cuts = np.unique(np.array(at or [], np.int64) >> 19 << 19)  # a context is in one shard
    return cuts[cuts > 0]


# --------------------------------------------------------------------------- counts


def _texts_trigrams(words, cuts: np.ndarray, low: int, high: int):
    """Distinct trigrams of each batch, and their numbers, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, words):
            a, b, c, _, place = _trigrams(*part, low, high)
            first = _firsts(a, b, c)
            n = np.diff(np.r_[first, len(a)]).astype("<u4")
            yield _by_shard(_shards(place[first], cuts), a[first], b[first], c[first], n)

    return run


def _by_shard(shard: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """(shard, data) for each run of ``shard``."""
    first = _firsts(shard)
    data = [_pack(*(x[i:j] for x in arrays)) for i, j in zip(first, np.r_[first[1:], len(shard)])]
    return pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32), pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])


def _counted(cuts: np.ndarray):
    """A shard's trigrams as one row (n occurrences, how many are seen 1 to 4 times) and its bigrams' parts, dealt by (c, b)."""

    def run(table: pa.Table) -> pa.Table:
        a, b, c, n = _all(table.column("data"), "<u8", "<u8", "<u8", "<u4")
        _, at, n = _sums(_triple(a, b, c), n.astype(np.int64))
        b, c = b[at], c[at]
        _, at, more = _sums(_pair(b, c), np.ones(len(b), np.int64))
        b, c = b[at], c[at]
        place = _place(b, c, np.zeros_like(b))
        order = np.argsort(place)
        out = _by_shard(_shards(place[order], cuts), b[order], c[order], more[order].astype("<u4"))
        whole = pa.table({"shard": pa.array([None], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "seen": pa.array([np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()], pa.list_(pa.int64())), "data": pa.array([None], pa.binary())})
        parts = pa.table({"shard": out.column("shard"), "n": pa.nulls(out.num_rows, pa.int64()), "seen": pa.nulls(out.num_rows, pa.list_(pa.int64())), "data": out.column("data")})
        return pa.concat_tables([whole, parts])

    return run


def _merged_bigrams(table: pa.Table) -> pa.Table:
    b, c, n = _all(table.column("data"), "<u8", "<u8", "<u4")
    _, at, n = _sums(_pair(b, c), n.astype(np.int64))
    order = np.lexsort((b[at], c[at]))
    data = _pack(b[at][order], c[at][order], n[order].astype("<u4"))
    return pa.table({"shard": table.column("shard")[:1], "seen": pa.array([np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()], pa.list_(pa.int64())), "data": pa.array([data], pa.binary())})


def _continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, n): distinct bigrams of a shard that end in c."""
    for x in batches:
        for data in x.column("data").to_pylist():
            _, c, _ = _unpack(data, "<u8", "<u8", "<u4")
            k, _, n = _sums(c, np.ones(len(c), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["c", "n"])


def _word_contexts(d: list[float]):
    """(b, t, off): a context's total and the sum of its discounts in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for data in x.column("data").to_pylist():
                b, _, n = _unpack(data, "<u8", "<u8", "<u4")
                k, _, t, off = _sums(b, n.astype(np.int64), _cut(n, d))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(t), pa.array(off)], names=["b", "t", "off"])

    return run


def _spread(cuts: np.ndarray, low: int = 0, high: int = 1 << 60):
    """Rows of a word's column k, once for each shard from ``low`` to below ``high`` that the word spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            which, shard = _spanned(x.column("k").to_numpy().view(np.uint64), cuts)
            here = (shard >= low) & (shard < high)
            rows = x.take(pa.array(which[here]))
            yield pa.RecordBatch.from_arrays([pa.array(shard[here].astype(np.int32)), *rows.columns], names=["shard", *x.schema.names])

    return run


def _with_words(cuts: np.ndarray):
    """Bigrams of a (c, b) shard, with the count of c, dealt to the shards of b."""

    def run(words: pa.Table, bigrams: pa.Table) -> pa.Table:
        b, c, n = _all(bigrams.column("data"), "<u8", "<u8", "<u4")
        k, m = words.column("k").to_numpy().view(np.uint64), words.column("n").to_numpy()
        order = np.argsort(k)
        m = _find(k[order], m[order], c).astype("<u4")
        which, shard = _spanned(b, cuts)
        order = np.lexsort((c[which], b[which], shard))
        at = which[order]
        return pa.Table.from_batches([_by_shard(shard[order], b[at], c[at], n[at], m[at])])

    return run


class Model:
    """What is counted before scoring: discounts, bigrams by shard, and the values of words."""

    def __init__(self, texts: DataFrame, words, slices: int, cuts: np.ndarray | None = None):
        """``texts`` has a column text; ``words`` gives the word hashes of a string column and their number by row."""
        spark = texts.sparkSession
        self.cuts = cuts = ranges(texts, words, slices) if cuts is None else cuts
        fewer = cuts[3::4]  # of (c, b); pairs are spread as those of (b, a)
        parts = []
        for part in range(slices):
            rows = texts.select("text").mapInArrow(_texts_trigrams(words, cuts, *_bounds(cuts, part, slices)), "shard int, data binary")
            parts.append(materialize(rows.groupBy("shard").applyInArrow(_counted(fewer), "shard int, n long, seen array<long>, data binary"), "kn-3"))
        self.tri = [x.filter("shard is null").select("n", "seen") for x in parts]
        self.d3 = _discounts(_total_seen(reduce(DataFrame.union, self.tri)))
        dealt = reduce(DataFrame.union, parts).filter("shard is not null").select("shard", "data")
        pairs = materialize(dealt.groupBy("shard").applyInArrow(_merged_bigrams, "shard int, seen array<long>, data binary"), "kn-2")
        self.d2 = _discounts(_total_seen(pairs))
        uni = materialize(pairs.select("data").mapInArrow(_continued, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")), "kn-1")
        self.d1 = _discounts(_seen(uni))
        size, total, off = uni.agg(F.count("*"), F.sum("n"), F.sum(_off(self.d1))).first()
        self.total = total or 1
        self.floor = float(np.log10(off / total / (size + 1))) if size else 0.0
        q = (F.col("n") - _off(self.d1)) / F.lit(self.total) + F.lit(10.0**self.floor)
        last = uni.filter(F.col("c") == int(END)).select(F.log10(q)).first()
        self.end = last[0] - self.floor if last else 0.0
        contexts = pairs.select("data").mapInArrow(_word_contexts(self.d2), "b long, t long, off double").groupBy("b").agg(F.sum("t").alias("t"), (F.sum("off") / F.sum("t")).alias("w"))
        one = uni.select(F.col("c").alias("k"), F.log10(q).alias("q")).join(contexts.withColumnRenamed("b", "k"), "k", "full")
        self.words = materialize(one.select("k", "t", "w", (F.coalesce(F.col("q") - self.floor, F.lit(0.0)) + F.coalesce(F.log10("w"), F.lit(0.0))).alias("v")), "kn-words")
        counts = uni.select(F.col("c").alias("k"), "n").mapInArrow(_spread(fewer), "shard int, k long, n long")
        self.bigrams = materialize(counts.groupBy("shard").cogroup(pairs.select("shard", "data").groupBy("shard")).applyInArrow(_with_words(cuts), "shard int, data binary"), "kn-p2")


# --------------------------------------------------------------------------- scores


def _requests(words, cuts: np.ndarray, part: int, parts: int):
    """For each batch of documents and shard: the distinct trigrams, how often each occurs and in which documents.
    Those that the model learns from have the first numbers.

    The first round also sends the batch's own columns, as one row that no shard has to look at.
    """
    low, high = _bounds(cuts, part, parts)

    def batch(number: int, rows: list[pa.RecordBatch], hashed: list) -> pa.RecordBatch:
        docs = pa.Table.from_batches(rows)
        n = np.concatenate([x for _, x in hashed])
        learn = docs.column("learn").to_numpy()
        order = np.argsort(~learn, kind="stable")
        number_of = np.empty(len(order), "<u2")
        number_of[order] = np.arange(len(order))
        a, b, c, row, place = _trigrams(*padded(np.concatenate([x for x, _ in hashed]), n), low, high)
        doc, first = number_of[row], _firsts(a, b, c)
        shard = _shards(place[first], cuts)
        at, cut = np.r_[first, len(a)], _firsts(shard)
        times = np.diff(at).astype("<u4")
        a, b, c = a[first], b[first], c[first]
        head = np.array([learn.sum()], "<u4")
        out = [(int(shard[i]), number, _pack(a[i:j], b[i:j], c[i:j], times[i:j], doc[at[i] : at[j]], head), None) for i, j in zip(cut, np.r_[cut[1:], len(first)])]
        if part == 0:
            about = docs.select(["doc_id", "lang", "score"]).append_column("n", pa.array(n.astype(np.int64))).take(pa.array(order))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, about.schema) as f:
                f.write_table(about)
            out.append((number % (len(cuts) // parts + 1), number, None, sink.getvalue().to_pybytes()))
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=["shard", "batch", "data", "about"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, hashed, size, held = TaskContext.get().partitionId() << 32, [], [], 0, 0
        for whole in batches:
            for start in range(0, whole.num_rows, HASH_ROWS):
                x = whole.slice(start, HASH_ROWS)
                hashed.append(words(x.column("text")))
                rows.append(x.select(["doc_id", "lang", "learn", "score"]))
                size, held = size + len(hashed[-1][0]), held + x.num_rows
                if size >= BATCH_WORDS or held > BATCH_DOCS - HASH_ROWS:
                    yield batch(number, rows, hashed)
                    number, rows, hashed, size, held = number + 1, [], [], 0, 0
        if rows:
            yield batch(number, rows, hashed)

    return run


def _answers(d1: list[float], d2: list[float], d3: list[float], total: int, floor: float):
    """For each request of a shard: the documents with a value there, and their sums."""

    def run(words: pa.Table, blobs: pa.Table) -> pa.Table:
        k = words.column("k").to_numpy().view(np.uint64)
        order = np.argsort(k)
        k, t, w, v = k[order], *(words.column(x).to_numpy()[order] for x in ("t", "w", "v"))
        # Bigrams: they have no batch.
        known, asked = (blobs.filter(f(blobs.column("batch"))) for f in (pc.is_null, pc.is_valid))
        b, c, n, m = _all(known.column("data"), "<u8", "<u8", "<u4", "<u4")
        pair = _pair(b, c)
        order = np.argsort(pair)
        pair, b, n, m = pair[order], b[order], n[order], m[order]
        low = _find(k, w, b) * ((m - _cut(m, d1)) / total + 10.0**floor)
        p2 = (n - _cut(n, d2)) / np.maximum(_find(k, t, b), 1) + low
        gain2 = np.log10(p2 / low)
        # Trigrams of the texts to learn from.
        out, requests, tri = [], [], []
        for number, data, about in zip(*(asked.column(x).to_pylist() for x in ("batch", "data", "about"))):
            if about is not None:
                out.append((number, None, None, about))
                continue
            a, b, c, times, docs, learn = _unpack(data, "<u8", "<u8", "<u8", "<u4", "<u2", "<u4")
            three, two, low2 = _triple(a, b, c), _pair(a, b), _pair(b, c)
            requests.append((number, three, two, low2, b, times, docs))
            of = np.add.reduceat(docs < learn[0], np.cumsum(times, dtype=np.int64) - times, dtype=np.int64) if len(times) else np.empty(0, np.int64)
            here = np.flatnonzero(of)
            tri.append((three[here], two[here], low2[here], of[here]))
        three, two, low2, n = (np.concatenate(x) for x in zip(*tri)) if tri else (np.empty(0, np.uint64),) * 4
        three, at, n = _sums(three, n)
        two, low2 = two[at], low2[at]
        context, _, t3, off = _sums(two, n, _cut(n, d3))
        w3 = off / t3
        low = _find(context, w3, two) * _find(pair, p2, low2)
        gain3 = np.log10(((n - _cut(n, d3)) / _find(context, t3, two) + low) / low)
        w3 = np.log10(w3)
        for number, x3, x2, x1, b, times, docs in requests:
            found = _find(k, v, b) + _find(pair, gain2, x1) + _find(three, gain3, x3) + _find(context, w3, x2)
            sums = np.bincount(docs, np.repeat(found, times))
            which = np.flatnonzero(sums)
            out.append((number, which.astype("<u2").tobytes(), sums[which].astype("<f8").tobytes(), None))
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({x: pa.array([r[i] for r in out], t) for i, (x, t) in enumerate(zip(("batch", "docs", "sums", "about"), types))})

    return run


def _merged(answers: pa.Table) -> pa.Table:
    """A batch's answers from all shards of a round as one."""
    docs, sums = (np.frombuffer(b"".join(x.as_py() for x in answers.column(c) if x.is_valid), t) for c, t in (("docs", "<u2"), ("sums", "<f8")))
    total = np.bincount(docs, sums)
    which = np.flatnonzero(total)
    about = next((x.as_py() for x in answers.column("about") if x.is_valid), None)
    row = (answers.column("batch")[0].as_py(), which.astype("<u2").tobytes(), total[which].astype("<f8").tobytes(), about)
    return pa.table({c: pa.array([x], t) for c, x, t in zip(("batch", "docs", "sums", "about"), row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))})


def _added(floor: float, end: float):
    def run(answers: pa.Table) -> pa.Table:
        about = next(x for x in answers.column("about") if x.is_valid)
        docs = pa.ipc.open_stream(about.as_buffer()).read_all()
        n = docs.column("n").to_numpy()
        total = np.where(n > 0, (n + 1) * floor + end, 0.0)
        for which, sums in zip(answers.column("docs"), answers.column("sums")):
            if which.is_valid:
                total[np.frombuffer(which.as_buffer(), "<u2")] += np.frombuffer(sums.as_buffer(), "<f8")
        bits = pa.array(-total / (n + 1), mask=n == 0)
        return pa.table({"doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "n_tokens": docs.column("n"), "bits": bits}).filter(docs.column("score"))

    return run


def scores(docs: DataFrame, texts: DataFrame, words) -> DataFrame:
    """Per row of ``docs`` (doc_id, lang, text): doc_id, lang, n_tokens and bits, its mean negative log10 probability a
    prediction (null without words) by the model of all ``texts``."""
    rows = lambda x, learn: x.select("doc_id", "lang", "text", F.lit(learn).alias("learn"), F.lit(not learn).alias("score"))
    return marked_scores(rows(docs, False).union(rows(texts, True)), words)


def marked_scores(rows: DataFrame, words) -> DataFrame:
    """As ``scores``, of rows (doc_id, lang, text) that booleans mark: ``learn`` those to learn from, ``score`` those to score."""
    spark = rows.sparkSession
    before = {x: spark.conf.get(x) for x in (CLEANUP, BATCHES)}
    spark.conf.set(CLEANUP, "true")  # or the shuffles of all rounds would lie on the disks until the end
    spark.conf.set(BATCHES, str(RECORDS if int(before[BATCHES]) <= 0 else min(RECORDS, int(before[BATCHES]))))
    try:
        return _scores(rows, words)
    finally:
        for x, value in before.items():
            spark.conf.set(x, value)


def _scores(rows: DataFrame, words) -> DataFrame:
    spark, mark = rows.sparkSession, folders_so_far()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = SLICES if chars > SLICE_CHARS else 1
    cuts = ranges(rows, words, max(slices, int(chars // SHARD_CHARS) + 1))
    model = Model(rows.filter("learn"), words, min(slices, COUNT_SLICES), cuts)
    release_since(spark, mark, model.words, model.bigrams)
    answers = []
    for part in range(slices):
        low, high = (int(_shards(np.array([x]), cuts)[0]) for x in _bounds(cuts, part, slices))
        high += part + 1 == slices
        values = model.words.mapInArrow(_spread(cuts, low, high), "shard int, k long, t long, w double, v double")
        asked = rows.mapInArrow(_requests(words, cuts, part, slices), _BLOB)
        known = model.bigrams.filter((F.col("shard") >= low) & (F.col("shard") < high)).select("shard", F.lit(None).cast("long").alias("batch"), "data", F.lit(None).cast("binary").alias("about"))
        answer = _answers(model.d1, model.d2, model.d3, model.total, model.floor)
        found = values.groupBy("shard").cogroup(asked.union(known).groupBy("shard")).applyInArrow(answer, _ANSWER)
        answers.append(materialize(found.groupBy("batch").applyInArrow(_merged, _ANSWER), "kn-answers"))
    out = materialize(reduce(DataFrame.union, answers).groupBy("batch").applyInArrow(_added(model.floor, model.end), "doc_id long, lang string, n_tokens long, bits double"), "kn-scores")
    release_since(spark, mark, out)
    return out
