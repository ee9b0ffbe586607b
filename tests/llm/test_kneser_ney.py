"""The whole-corpus Kneser-Ney model against its formulas over dictionaries, and that the classifier counts all trusted text."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("hopgrid.llm")

from pyspark.sql import functions as F

from hopgrid.llm import kneser_ney, quality

SIGNS = re.compile(r"[^\x20\x09-\x0D\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]+|[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]+")
WORDS = ["the", "The", "cat,", "sat!!", "on", "mat.", "x%y", "é"]


def plain_words(text):
    out, last, run = [], None, 0
    for w in SIGNS.findall(text or ""):
        run = run + 1 if w == last else 0
        out.append(("run", min(run, quality.RUNS - 1)) if run else w)
        last = w
    return out


class Plain:
    """Interpolated modified Kneser-Ney with every word and the end."""

    def __init__(self, texts):
        tri = Counter(g for t in texts for g in self.grams(t))
        bi = Counter(g[1:] for g in tri)
        uni = Counter(g[1:] for g in bi)
        self.size, self.orders = len(uni) + 1, []
        for c in (uni, bi, tri):
            n = [0, *(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))]
            y = n[1] / (n[1] + 2 * n[2] + 1e-9)
            contexts = {}
            for g, m in c.items():
                contexts.setdefault(g[:-1], []).append(m)
            self.orders.append((c, [min(max(i - (i + 1) * y * n[i + 1] / (n[i] + 1e-9), 0.1), i - 0.1) if n[i] else 0.75 for i in (1, 2, 3)], contexts))

    @staticmethod
    def grams(text):
        w = plain_words(text)
        w = ["<s>", "<s>", *w, "</s>"] if w else []
        return list(zip(w, w[1:], w[2:]))

    def p(self, gram):
        if not gram:
            return 1 / self.size
        c, d, contexts = self.orders[len(gram) - 1]
        seen, n = contexts.get(gram[:-1]), c.get(gram, 0)
        if not seen:
            return self.p(gram[1:])
        cut = lambda n: d[min(n, 3) - 1]
        return (n - cut(n) if n else 0) / sum(seen) + sum(map(cut, seen)) / sum(seen) * self.p(gram[1:])

    def bits(self, text):
        g = self.grams(text)
        return -sum(np.log10(self.p(x)) for x in g) / len(g) if g else None


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_the_formulas(spark, monkeypatch, small):
    if small:  # many rounds, shards and batches
        for name, size in (("SLICE_CHARS", 0), ("SLICES", 3), ("SHARD_CHARS", 300), ("BATCH_WORDS", 40)):
            monkeypatch.setattr(kneser_ney, name, size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    r = np.random.RandomState(2)
    word = lambda: [*WORDS, f"w{r.randint(40)}"][r.randint(9)]
    rows = [(i, "=x", " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(60)]
    rows += [(60, "=x", "go go go go go go go go go go no no"), (61, None, None), (62, "=x", " \t"), (None, "=x", "the cat, sat"), (3, *rows[3][1:]), (3, "=y", "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    try:
        got = kneser_ney.scores(docs, docs.filter("doc_id % 2 = 0"), quality.word_hashes).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = Plain([t for i, _, t in rows if i is not None and i % 2 == 0])
    key = lambda x: tuple((y is not None, y) for y in x)
    want = sorted(((i, x, len(plain_words(t)), plain.bits(t)) for i, x, t in rows), key=key)
    got = sorted((tuple(x) for x in got), key=key)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    for g, w in zip(got, want):
        assert g[3] is None and w[3] is None or abs(g[3] - w[3]) < 1e-9
    # Given a context, the probabilities of all words and of one that was not seen sum to one.
    assert abs(sum(plain.p(("the", "cat", w)) for w in [g[0] for g in plain.orders[0][0]] + ["unseen"]) - 1) < 1e-9


def test_no_texts_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "=x", "a b"), (2, "=x", None)], "doc_id long, lang string, text string")
    got = {x["doc_id"]: x for x in kneser_ney.scores(docs, docs.limit(0), quality.word_hashes).collect()}
    assert (got[1]["n_tokens"], got[1]["bits"], got[2]["n_tokens"], got[2]["bits"]) == (2, 0.0, 0, None)
    assert kneser_ney.scores(docs.limit(0), docs, quality.word_hashes).count() == 0


def test_quality_counts_all_trusted_text(spark, monkeypatch):
    """However little a sample would hold, the perplexities are those of the model of all trusted documents but one fold."""
    monkeypatch.setattr(quality, "TRAIN_CHARS", 300)
    r = np.random.RandomState(3)
    rows = [(i, "xy"[i % 2], " ".join(WORDS[r.randint(8)] for _ in range(20))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i % 4 < 3), int(i % 8 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    fold = {x[0]: x[1] for x in docs.select("doc_id", quality._fold()).collect()}
    plain = Plain([t for i, _, t in rows if i % 4 < 3 and i % 8 and fold[i] > 0])
    got = {x["doc_id"]: x for x in quality.quality_scores(docs, labels).collect()}
    unseen = np.median([plain.bits(t) for i, _, t in rows if i % 4 < 3 and i % 8 and not fold[i]])
    for i, _, t in rows:  # few are unseen, so every language has the median of all
        n = len(plain_words(t))
        assert abs(np.log10(got[i]["perplexity"]) - (plain.bits(t) * n + unseen * quality.PRIOR) / (n + quality.PRIOR)) < 0.02


def test_rounds_read_every_word_once(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i}") for i in range(50)], "doc_id long, text string")
    one, three = (kneser_ney.Model(docs, quality.word_hashes, n) for n in (1, 3))
    count = lambda m: sum(x.agg(F.sum("n")).first()[0] or 0 for x in m.tri)
    assert count(one) == count(three) == 50 * 4 and one.d3 == three.d3 and abs(one.floor - three.floor) < 1e-12


def test_a_frequent_word_is_dealt_over_shards(spark):
    """The trigrams about a word that is every second one go to many shards, and each shard has the word's bigrams."""
    r = np.random.RandomState(4)
    texts = [" ".join(x for _ in range(40) for x in ("the", f"w{r.randint(300)}")) for _ in range(40)]
    docs = spark.createDataFrame([(i, "=x", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    cuts = kneser_ney.ranges(docs.union(docs).union(docs), quality.word_hashes, 12)
    the = quality.word_hashes(pa.array(["the"]))[0]
    assert len(cuts) > 6 and len(kneser_ney._spanned(the, cuts)[0]) >= len(cuts) // 3
    model = kneser_ney.Model(docs, quality.word_hashes, 2, cuts)
    sizes = [x["n"] for t in model.tri for x in t.collect()]
    assert sum(sizes) == 40 * 81 and max(sizes) < 40 * 81 / 4


def test_a_trigram_travels_once_with_its_texts():
    """What a batch sends grows with its distinct trigrams and two bytes an occurrence, not with four kinds of keys."""
    words = np.random.RandomState(5).randint(0, 3000, (200, 200))
    x = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(["=x"] * 200), pa.array([" ".join(map(str, w)) for w in words]), pa.array([True] * 200), pa.array([True] * 200)], names=["doc_id", "lang", "text", "learn", "score"])
    task = type("Task", (), {"get": lambda: task, "partitionId": lambda: 0})
    with pytest.MonkeyPatch.context() as m:
        m.setattr(kneser_ney, "TaskContext", task)
        sent = sum(b.column("data").nbytes for part in range(4) for b in kneser_ney._requests(quality.word_hashes, np.arange(1, 4) << 61, part, 4)(iter([x])))
    assert sent < 16 * 200 * 201  # 42 bytes of keys, numbers and documents before, for such trigrams


def test_a_round_sends_at_most_a_fifth():
    """The rounds divide what lies on the disks; with four of them a round's requests were over a quarter."""
    r = np.random.RandomState(4)
    texts = pa.array([" ".join(f"w{x}" for x in r.zipf(1.3, 400) % 5000) for _ in range(50)])
    w, row = kneser_ney.padded(*quality.word_hashes(texts))
    low, high = 0, (1 << 63) - 1
    *_, place = kneser_ney._trigrams(w, row, low, high)
    cuts = np.unique(np.sort(place)[np.linspace(0, len(place) - 1, 141).astype(int)[1:-1]] >> 19 << 19)
    sent = [len(kneser_ney._trigrams(w, row, *kneser_ney._bounds(cuts, i, kneser_ney.SLICES))[0]) for i in range(kneser_ney.SLICES)]
    assert sum(sent) == len(place) and max(sent) <= len(place) / 5
