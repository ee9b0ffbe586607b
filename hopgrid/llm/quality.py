"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Tokens are real words: runs of letters and digits as they are written, and runs of signs; a word that
repeats the one before it stands for its place in the run, up to RUNS. Trusted text is that of documents labelled good
and not toxic. The model is counted on all of it, of all languages together, but for one of FOLDS, which is kept back
to set thresholds; documents' trigrams are joined with its sharded values (``kneser_ney.py``).

A document's log perplexity is its mean over the tokens and the end, with PRIOR further tokens at the language's
median, to judge short texts fairly. A language's thresholds are fences from quantiles of all those
trusted documents that were kept back: above, median + SPREAD * (q(HIGH) - median) for text the model can't predict;
below, median - SPREAD * (median - q(LOW)) for text that repeats itself. Since language marks can be wrong, a document
also passes by the median and the fences (at SPREAD_ALL) of all languages together.

Defined cases: null text or a text without words has no perplexity and is rejected; null language
is a language of its own; a language without FEWEST kept-back trusted documents uses the median and the
fences (at SPREAD) of all; without any trusted text nothing is rejected but texts without words; several labels
of a document count as their least quality and greatest toxicity; repeated rows are scored each; an
empty table gives no rows; extra columns stay out.

``train`` makes a model of bounded size from a sample, which one worker can hold; the queries and ``quality_scores`` do not use it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import folders_so_far, hashed_words, materialize, mix64, open_fs, release_since, shared_dir
from .kneser_ney import marked_scores, scores

TRAIN_CHARS = 2_000_000
FOLDS = 5
LEAST = 2
SPREAD, SPREAD_ALL, LOW, HIGH, PRIOR, FEWEST = 1.5, 1.0, 0.01, 0.99, 20, 20
SHARD_ENTRIES = 100_000
BROADCAST_IDS = 1_000_000
ALL = "*"
BITS = 21  # of a word's number; a sample has fewer words
START, UNKNOWN = 0, 1
RUNS = 8
_RUN = mix64(np.arange(RUNS, dtype=np.uint64) + np.uint64(1 << 40))
_LOW = (1 << BITS) - 1

# --------------------------------------------------------------------------- counts


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, and their number."""
    h, n = hashed_words(column, lower=False, signs=True)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[(np.cumsum(n) - n)[n > 0]] = False
    if same.any():
        at = np.arange(len(h))
        place = at - np.maximum.accumulate(np.where(same, 0, at))  # words before it in its run
        h = np.where(same, _RUN[np.minimum(place, RUNS - 1)], h)
    return h, n


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            k, n = np.unique(word_hashes(b.column("text").filter(pa.array(langs == lang)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "k", "n"])


def trigram_keys(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Packed trigrams that end at each word; two starts stand before each text."""
    row = np.repeat(np.arange(len(counts)), counts)
    pad = np.full(int(counts.sum()) + 2 * len(counts), START, np.int64)
    at = np.arange(len(row)) + 2 * row + 2
    pad[at] = numbers
    return (pad[at - 2] << (2 * BITS)) | (pad[at - 1] << BITS) | pad[at]


def _trigram_counts(model: "Files"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                h, n = word_hashes(b.column("text").filter(pa.array(langs == lang)))
                k, n = np.unique(trigram_keys(model.numbers(lang, h), n), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n.astype(np.int64))], names=["lang", "k", "n"])

    return run


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts d1, d2, d3 of each language from its counts of counts."""
    n = counts.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2") + 1e-9)
    d = [F.lit(i) - (i + 1) * y * F.col(f"n{i + 1}") / (F.col(f"n{i}") + 1e-9) for i in (1, 2, 3)]
    return n.select("lang", *(F.when(F.col(f"n{i}") > 0, F.least(F.greatest(x, F.lit(0.1)), F.lit(i - 0.1))).otherwise(F.lit(0.75)).alias(f"d{i}") for i, x in zip((1, 2, 3), d)))


def _order(counts: DataFrame, context: str) -> tuple[DataFrame, DataFrame]:
    """Discounted share of each n-gram in its context, and each context's back-off weight."""
    d = materialize(_discounts(counts), "kn-discounts")
    by = F.when(F.col("n") >= 3, F.col("d3")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d1"))
    rows = counts.join(F.broadcast(d), "lang").withColumn("c", F.expr(context))  # one row a language
    ctx = rows.groupBy("lang", "c").agg(F.sum("n").alias("t"), F.sum(by).alias("off")).withColumn("w", F.col("off") / F.col("t"))
    shares = rows.join(ctx, ["lang", "c"]).select("lang", "k", ((F.col("n") - by) / F.col("t")).alias("share"), "w")
    return shares, ctx.select("lang", F.col("c").alias("k"), F.col("w").alias("v"))


def vocabulary(sample: DataFrame) -> DataFrame:
    """(lang, kind 0, k: the word's hash, v: its number) for words seen LEAST times or more in the sample, and
    for each language (kind -1) the log10 share of one spelling of the unknown word."""
    words = materialize(sample.mapInArrow(_word_counts, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")), "kn-words")
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "k")) + UNKNOWN  # a sample's words
    known = words.filter(F.col("n") >= LEAST).select("lang", F.lit(0).alias("kind"), "k", number.cast("double").alias("v"))
    rare = words.groupBy("lang").agg((-F.log10(F.count_if(F.col("n") < LEAST) + 1.0)).alias("v"))
    return known.union(rare.select("lang", F.lit(-1), F.lit(0).cast("long"), "v"))


def model_rows(tri: DataFrame, sizes: DataFrame) -> DataFrame:
    """The model of trigram counts ``tri`` (lang, k, n): rows (lang, kind, k, v), log10 values.

    kind 3, 2, 1: probability of a trigram, bigram or unigram; kind -3, -2: weight of a context; key -1
    of kind 1: an unseen word's. ``sizes`` (lang, size) has the number of words, with the unknown.
    """
    bi = materialize(tri.groupBy("lang", F.expr(f"k & {(1 << 2 * BITS) - 1}L").alias("k")).agg(F.count("*").alias("n")), "kn-2")
    uni = bi.groupBy("lang", F.expr(f"k & {_LOW}L").alias("k")).agg(F.count("*").alias("n"))
    s1, c1 = _order(uni, "0L")
    sizes = F.broadcast(sizes)  # a row a language
    p1 = materialize(s1.join(sizes, "lang").select("lang", "k", (F.col("share") + F.col("w") / F.col("size")).alias("p")), "kn-p1")
    floor = c1.join(sizes, "lang").select("lang", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("k"), (F.col("v") / F.col("size")).alias("v"))
    s2, c2 = _order(bi, f"shiftright(k, {BITS})")
    low = p1.select("lang", F.col("k").alias("l"), F.col("p").alias("q"))
    p2 = materialize(s2.withColumn("l", F.expr(f"k & {_LOW}L")).join(low, ["lang", "l"]).select("lang", "k", (F.col("share") + F.col("w") * F.col("q")).alias("p")), "kn-p2")
    s3, c3 = _order(tri, f"shiftright(k, {BITS})")
    low = p2.select("lang", F.col("k").alias("l"), F.col("p").alias("q"))
    p3 = s3.withColumn("l", F.expr(f"k & {(1 << 2 * BITS) - 1}L")).join(low, ["lang", "l"]).select("lang", "k", (F.col("share") + F.col("w") * F.col("q")).alias("p"))
    named = lambda x, kind, v: x.select("lang", F.lit(kind).alias("kind"), "k", F.col(v).alias("v"))
    rows = named(p3, 3, "p").union(named(p2, 2, "p")).union(named(p1, 1, "p")).union(floor).union(named(c3, -3, "v")).union(named(c2, -2, "v"))
    return rows.withColumn("v", F.log10(F.greatest("v", F.lit(1e-30))))


def write_shards(rows: DataFrame, folder: str) -> list[tuple[str, int, str, int]]:
    """Sorted key and value files of about SHARD_ENTRIES entries; the driver gets one (lang, kind, file, n) for each."""
    rows = materialize(rows, "kn-model")
    sizes = rows.groupBy("lang", "kind").agg((F.count("*") / SHARD_ENTRIES).cast("int").alias("more"))
    parts = rows.join(F.broadcast(sizes), ["lang", "kind"]).withColumn("shard", F.pmod(F.xxhash64("k"), F.col("more") + 1).cast("int"))

    def write(table: pa.Table) -> pa.Table:
        fs, root = open_fs(folder)
        k = table.column("k").to_numpy()
        order = np.argsort(k)
        name = f"shard-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(k[order].astype("<i8").tobytes() + table.column("v").to_numpy()[order].astype("<f8").tobytes())
        return pa.table({"lang": table.column("lang").slice(0, 1), "kind": table.column("kind").slice(0, 1), "file": [name], "n": pa.array([len(k)], pa.int64())})

    done = materialize(parts.groupBy("lang", "kind", "shard").applyInArrow(write, "lang string, kind int, file string, n long"), "kn-files")
    return [tuple(r) for r in done.collect()]  # one row for each SHARD_ENTRIES entries of a model that the sample bounds


# --------------------------------------------------------------------------- scoring

_TABLES: dict[tuple[str, str, int], tuple[np.ndarray, np.ndarray]] = {}


class Files:
    """A model's files. A worker joins the shards of a (language, kind) it needs once, sorted by key."""

    def __init__(self, folder: str, shards: list[tuple[str, int, str, int]]):
        self.folder, self.shards = folder, {}
        for lang, kind, name, n in shards:
            self.shards.setdefault((lang, kind), []).append((name, n))

    def _table(self, lang: str, kind: int) -> tuple[np.ndarray, np.ndarray]:
        key = (self.folder, lang, kind)
        if key not in _TABLES:
            if any(f != self.folder for f, _, _ in _TABLES):
                _TABLES.clear()
            fs, root = open_fs(self.folder)
            parts = []
            for name, n in self.shards.get((lang, kind), ()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    data = f.read()
                parts.append((np.frombuffer(data, "<i8", n), np.frombuffer(data, "<f8", n, 8 * n).astype(np.int32 if kind == 0 else np.float32)))
            k, v = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.float32))
            order = np.argsort(k)
            _TABLES[key] = k[order], v[order]
        return _TABLES[key]

    def find(self, lang: str, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key, and whether there is one."""
        k, v = self._table(lang, kind)
        if not len(k):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
        return v[at], k[at] == keys

    def numbers(self, lang: str, hashes: np.ndarray) -> np.ndarray:
        distinct, which = np.unique(hashes, return_inverse=True)
        v, known = self.find(lang, 0, distinct.view(np.int64))
        return np.where(known, v, UNKNOWN).astype(np.int64)[which]

    def log10(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """log10 probability of distinct packed trigrams: the longest n-gram that is known, and the weights of the contexts before it."""
        out = np.zeros(len(keys))
        rest = np.arange(len(keys))
        for kind, mask in ((3, (1 << 3 * BITS) - 1), (2, (1 << 2 * BITS) - 1), (1, _LOW)):
            k = keys[rest] & mask
            v, known = self.find(lang, kind, k)
            out[rest[known]] += v[known]
            rest, k = rest[~known], k[~known]
            if kind == 1:
                floor, _ = self.find(lang, 1, np.array([-1]))
                out[rest] += floor[0]
            else:
                w, seen = self.find(lang, -kind, k >> BITS)
                out[rest] += np.where(seen, w, 0.0)
        spelling, _ = self.find(lang, -1, np.zeros(1, np.int64))
        out[(keys & _LOW) == UNKNOWN] += spelling[0]
        return out

    def score(self, lang: str, column) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log10 probabilities and number of words of each text."""
        h, n = word_hashes(column)
        distinct, which = np.unique(trigram_keys(self.numbers(lang, h), n), return_inverse=True)
        return np.bincount(np.repeat(np.arange(len(n)), n), self.log10(lang, distinct)[which], len(n)), n


def _fold() -> "F.Column":
    return F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that all their labels call good and none calls toxic."""
    toxic = F.max(F.coalesce("toxic", F.lit(0))) if "toxic" in labels.columns else F.lit(0)
    per = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), toxic.alias("t"))
    return per.filter("q = 1 and t = 0").select("doc_id")


def train(texts: DataFrame, trusted: DataFrame) -> tuple[Files, DataFrame]:
    """A model by language of a sample of the trusted ``texts`` (doc_id, lang, text) of about TRAIN_CHARS characters a
    language, small enough for one worker, and the doc_ids it was counted on. ``quality_scores`` counts all trusted text instead."""
    spark = texts.sparkSession
    sizes = texts.select("doc_id", "lang", F.length("text").alias("chars")).filter("chars is not null")
    good = sizes.join(trusted, "doc_id", "left_semi").filter(_fold() > 0)
    both = materialize(good.groupBy("lang").agg(F.sum("chars").alias("chars")).withColumn("share", F.lit(TRAIN_CHARS) / F.greatest("chars", F.lit(1))), "kn-chars")
    one = both.agg((F.lit(TRAIN_CHARS) / F.greatest(F.sum("chars"), F.lit(1))).alias("all"))
    # A language's sample, and the sample for all: documents by a hash of their id.
    ticket = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    dealt = good.join(F.broadcast(both.select("lang", "share")), "lang").crossJoin(F.broadcast(one)).withColumn("ticket", ticket)  # a row a language; one row
    langs = F.filter(F.array(F.when(F.col("ticket") < F.col("share"), F.col("lang")), F.when(F.col("ticket") < F.col("all"), F.lit(ALL))), lambda x: x.isNotNull())
    chosen = materialize(dealt.select("doc_id", "lang", langs.alias("langs")).filter(F.size("langs") > 0).distinct(), "kn-chosen")
    # The sample bounds the chosen; texts are shuffled only if it is of very many short ones.
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    sample = materialize(texts.filter("text is not null").join(few, ["doc_id", "lang"]).select("doc_id", F.explode("langs").alias("lang"), "text"), "kn-sample")
    folder = shared_dir(spark, "kn-shards")
    mark = folders_so_far()
    words = materialize(vocabulary(sample), "kn-vocabulary")
    shards = write_shards(words, folder)
    sizes = materialize(words.groupBy("lang").agg((F.count_if(F.col("kind") == 0) + 1).alias("size")), "kn-sizes")
    tri = materialize(sample.mapInArrow(_trigram_counts(Files(folder, shards)), "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")), "kn-3")
    shards += write_shards(model_rows(tri, sizes), folder)
    release_since(spark, mark)  # the files are all that is used from here on
    return Files(folder, shards), sample.select("doc_id").distinct()


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, lang, n_tokens, perplexity, low, threshold, kept."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("null"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text")
    trusted = materialize(trusted_ids(labels).withColumn("fold", _fold()), "kn-trusted")
    good = trusted.filter("fold > 0").select("doc_id")
    if good.count() <= BROADCAST_IDS:  # marked where they stand, without a shuffle of texts
        marked = texts.join(F.broadcast(good.withColumn("learn", F.lit(True))), "doc_id", "left")
        scored = marked_scores(marked.select("doc_id", "lang", "text", F.coalesce("learn", F.lit(False)).alias("learn"), F.lit(True).alias("score")), word_hashes)
    else:
        scored = scores(texts, materialize(texts.filter("text is not null").join(good, "doc_id", "left_semi"), "kn-texts"), word_hashes)
    unseen = scored.join(trusted.filter("fold = 0"), "doc_id", "left_semi").filter("n_tokens > 0")
    both = unseen.select("lang", "n_tokens", "bits").union(unseen.select(F.lit(ALL), "n_tokens", "bits"))
    middle = materialize(both.groupBy("lang").agg(F.percentile_approx("bits", 0.5, 10_000).alias("middle"), F.count("*").alias("n")).filter((F.col("n") >= FEWEST) | (F.col("lang") == ALL)).drop("n"), "kn-medians")
    even = lambda bits, middle: (F.col(bits) * F.col("n_tokens") + F.col(middle) * PRIOR) / (F.col("n_tokens") + PRIOR)
    ends = both.join(F.broadcast(middle), "lang").groupBy("lang", "middle").agg(F.percentile_approx(even("bits", "middle"), [LOW, HIGH], 10_000).alias("q"))
    m = F.col("middle")
    below = lambda spread: m - spread * (m - F.col("q")[0])
    above = lambda spread: m + spread * (F.col("q")[1] - m)
    fence = materialize(ends.select("lang", "middle", below(SPREAD).alias("low"), above(SPREAD).alias("high"), below(SPREAD_ALL).alias("near_low"), above(SPREAD_ALL).alias("near_high")), "kn-fences")
    overall = fence.filter(F.col("lang") == ALL).select(*(F.col(x).alias(f"{x}_all") for x in ("middle", "low", "high", "near_low", "near_high")))
    # A row a language, and one for all.
    limit = scored.join(F.broadcast(fence.select("lang", "middle", "low", "high")), "lang", "left").join(F.broadcast(overall), F.lit(True), "left")
    limit = limit.withColumns({"middle": F.coalesce("middle", "middle_all", F.lit(0.0)), "middle_all": F.coalesce("middle_all", F.lit(0.0))})
    free = {"low": F.coalesce("low", "low_all", F.lit(float("-inf"))), "high": F.coalesce("high", "high_all", F.lit(float("inf")))}
    limit = limit.withColumns({"bits": even("bits", "middle"), "bits_all": even("bits", "middle_all"), **free})
    return limit.select(
        "doc_id",
        F.when(F.col("lang") != "null", F.substring("lang", 2, 1 << 20)).alias("lang"),
        "n_tokens",
        F.pow(F.lit(10.0), "bits").alias("perplexity"),
        F.pow(F.lit(10.0), "low").alias("low"),
        F.pow(F.lit(10.0), "high").alias("threshold"),
        F.coalesce(F.col("bits").between(F.col("low"), F.col("high")) | F.col("bits_all").between(F.col("near_low_all"), F.col("near_high_all")), F.lit(False)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier keeps, with their own columns; rows without doc_id go."""
    mark = folders_so_far()
    kept = materialize(quality_scores(docs, labels).groupBy("doc_id").agg(F.min("kept").alias("k")).filter("k").select("doc_id"), "kn-kept")
    release_since(docs.sparkSession, mark, kept)
    return docs.join(kept, "doc_id", "left_semi")
