"""The training-data operators against plain versions on small tables with nulls, empties, ties, repeats and clashing names."""

import hashlib
import io
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("hopgrid.llm")

import public_tokenizers
from pyspark.sql import functions as F

from hopgrid.llm import decontaminate as dec
from hopgrid.llm import fingerprint as fp
from hopgrid.llm import html_text, lm_score, mixing, near_dup, quality, token_counts, token_index, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    "The quick Brown fox jumps over the lazy dog", None, "", "   \t\n", "one", "One", BASE, BASE, BASE.replace("w59", "x59"), BASE.replace("w1 ", "y1 "), "Straße élan ñandú İstanbul Σας <|endoftext|> don't 12,5",
    "a\x1cb c\x0bd", "the the the the the the the the the the", "long " * 3000, BASE.upper(),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en" if i % 3 else None, [None, "a", "b", "ü"][i % 4]) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here", "en", "a"), (6, "", "en", "a")]  # no id; a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"hits": F.lit("mine"), "node": F.lit(1), "n": F.lit("x")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def collected(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is not None, r[key] or 0))


# -- token ids


def test_memo_encoder_equals_the_library():
    from tokenizers import Tokenizer

    enc, tok = token_index.MemoEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for t in [t for t in TEXTS if t] + ["Don't stop.  It's 3.14, ́x éte ΑΣ. ﬁ ½", "x" * 500]:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_token_output(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    want, start = [], 0
    for r in sorted((r.asDict() for r in docs.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_index.token_output(spark, docs, VOCABULARY).collect()), key=lambda r: r[1]) == want
    assert token_index.token_output(spark, none, VOCABULARY).count() == 0


def test_one_key_in_many_writer_tasks(spark, request):
    """Rows of one doc_id, and of none, are split over tasks; every one is read back, in the places they were written to."""
    rows = [(7, f"text number {i} " * (i % 9)) for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(i, f"own {i}") for i in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    got = sorted(map(tuple, token_index.token_output(spark, df, VOCABULARY).collect()), key=lambda r: r[1])
    enc = token_index.MemoEncoder(VOCABULARY)
    ids = [np.append(np.frombuffer(enc.encode(t), enc.dtype), 1).astype("<u4") for _, t in rows]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    from hopgrid.llm.common import shared_dir

    manifest = token_index.write_shards(df, shared_dir(spark, "t"), VOCABULARY)
    assert manifest.filter("doc_id = 7").select("part").distinct().count() > 1


def test_perfect_hash_rejects_others():
    keys = np.random.RandomState(1).randint(0, 2**62, 5000).astype(np.uint64)
    keys = np.unique(keys)
    h = token_index.PerfectHash.load(*token_index.PerfectHash.build(keys).dump())
    assert sorted(h.slots(keys)) == list(range(len(keys)))


def test_unknown_keys_give_nothing(spark, docs):
    from hopgrid.llm.common import shared_dir

    m = token_index.write_shards(docs, shared_dir(spark, "t"), VOCABULARY)
    index, buckets = token_index.build_index(m, bucket_keys=4)
    found = token_index.lookup(spark.createDataFrame([(3,), (4,), (-1,), (10**12,)], "doc_id long"), index, buckets)
    assert [r["doc_id"] for r in found.collect()] == [3]


# -- archives


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "é" * 800 + "</p>"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://c", "short"), (5, "http://c", "short"), (6, "x\r\ny", None), (None, "http://n", big), (7, "u", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(0), "top": F.lit(9)})


def test_archive_round_trip(spark, pages):
    rows = [r.asDict() for r in pages.collect()]
    want = []
    for r in rows:
        b = (r["html"] or "").encode()
        top = max((x["page_id"] for x in rows if (x["html"] or "").encode() == b and x["page_id"] is not None), default=None)
        again = len(b) >= 1000 and r["page_id"] != top
        want.append((r["page_id"], len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    key = lambda r: str(r)
    assert sorted(map(tuple, warc.round_trip(spark, pages).collect()), key=key) == sorted(want, key=key)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def _records(n=6):
    return [warc.record("response", i, f"http://x/{i}", f"payload {i} ".encode() * 50, hashlib.sha1(f"payload {i} ".encode() * 50).hexdigest(), None, "2000-01-01T00:00:00Z") for i in range(n)]


def _salvage(data: bytes):
    items = list(warc.salvage(warc._Window(io.BytesIO(data), len(data))))
    return [int(x[3]["x-page-id"]) for x in items if x[0] == "record"], [(x[1], x[2]) for x in items if x[0] == "gap"]


@pytest.mark.parametrize("gz", [True, False])
def test_salvage(gz):
    parts = [warc.gzip_member(r) if gz else r for r in _records()]
    whole, at = b"".join(parts), np.cumsum([0, *map(len, parts)])
    assert _salvage(whole) == ([0, 1, 2, 3, 4, 5], [])
    for k in range(6):  # one byte of record k damaged
        broken = bytearray(whole)
        broken[at[k] + len(parts[k]) // 2] ^= 0xFF
        got, gaps = _salvage(bytes(broken))
        assert got == [i for i in range(6) if i != k] and gaps[0][0] == at[k]
    got, gaps = _salvage(whole[: at[5] + 20])  # cut
    assert got == [0, 1, 2, 3, 4] and gaps == [(at[5], at[5] + 20)]
    got, gaps = _salvage(parts[0] + b"garbage in between" + b"".join(parts[1:]))
    assert got == [0, 1, 2, 3, 4, 5] and gaps == [(at[1], at[1] + 18)]
    assert _salvage(b"") == ([], []) and _salvage(b"nothing here") == ([], [(0, 12)])


def test_salvage_of_neighbouring_damage_and_mixed_files():
    records = _records()
    parts = [warc.gzip_member(r) if i % 2 else r for i, r in enumerate(records)]
    whole, at = b"".join(parts), np.cumsum([0, *map(len, parts)])
    assert _salvage(whole) == ([0, 1, 2, 3, 4, 5], [])
    broken = bytearray(whole)
    for k in (1, 2, 4):
        broken[at[k] + len(parts[k]) // 2] ^= 0xFF
    got, gaps = _salvage(bytes(broken))
    assert got == [0, 3, 5] and [g[0] for g in gaps] == [at[1], at[4]]


def test_salvage_inside_one_member():
    records = _records()
    one = warc.gzip_member(b"".join(records))
    assert _salvage(one) == ([0, 1, 2, 3, 4, 5], [])
    inner = bytearray(b"".join(records))
    inner[len(records[0]) + len(records[1]) - 30] ^= 0xFF  # the second record, before compression
    got, gaps = _salvage(warc.gzip_member(bytes(inner)))
    assert got == [0, 2, 3, 4, 5] and len(gaps) == 1
    noise = [warc.record("response", i, None, np.random.RandomState(i).bytes(30_000), hashlib.sha1(np.random.RandomState(i).bytes(30_000)).hexdigest(), None, "2000-01-01T00:00:00Z") for i in range(4)]
    big = warc.gzip_member(b"".join(noise))
    got, gaps = _salvage(big[: len(big) * 5 // 8])  # cut within the third record: those before it are whole
    assert got == [0, 1] and gaps == [(0, len(big) * 5 // 8)]


def test_salvage_takes_linear_time():
    import time

    def took(n):
        payload = b"x" * 2000
        records = [bytearray(warc.record("response", i, None, payload, hashlib.sha1(payload).hexdigest(), None, "2000-01-01T00:00:00Z")) for i in range(n)]
        for r in records[::2]:
            r[-50] ^= 0xFF
        data = b"".join(records)
        began = time.process_time()
        assert len(_salvage(data)[0]) == n // 2
        return time.process_time() - began

    took(100)
    assert took(4000) < 12 * max(took(1000), 0.02)


def test_revisits_are_checked(spark):
    rows = [(1, "response", "a", None), (2, "revisit", "a", 1), (3, "revisit", "b", 1), (4, "revisit", "a", 9), (None, "response", "a", None)]
    read = spark.createDataFrame(rows, "page_id long, record_type string, payload_digest string, refers_to long")
    assert Counter((r["page_id"], r["refers_ok"]) for r in warc.checked_revisits(read).collect()) == Counter([(1, None), (2, True), (3, False), (4, None), (None, None)])


def test_equal_rows_that_tie_are_all_responses(spark):
    big = "<p>" + "tie " * 400
    df = spark.createDataFrame([(5, "u", big), (5, "u", big), (4, "u", big)], "page_id long, url string, html string")
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, df).collect()) == Counter([(5, "response", None), (5, "response", None), (4, "revisit", 5)])


def test_encoder_on_letters_that_change_when_lowered():
    """Every character whose lower case has another length or class, composes, or is white space; and special tokens."""
    import unicodedata

    from tokenizers import Tokenizer

    enc, tok = token_index.MemoEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    odd = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (len(c.lower()) != 1 or c.isalpha() != c.lower().isalpha() or c.lower() != c or not unicodedata.is_normalized("NFC", c) or unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc"))]
    texts = [t for c in odd for t in (f"{c},", f"a{c}.", f"{c}A, {c}")] + ["<|ENDOFTEXT|> x.", "<|endoftext|>.", "wait... so, e.g. 3.5, 'Tis, x's, y'S.", "a,\nb.\n\nc"]
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)


def test_encoder_memo_turns_over(monkeypatch):
    monkeypatch.setattr(token_index, "MEMO_WORDS", 50)
    enc, fresh = token_index.MemoEncoder(VOCABULARY), token_index.MemoEncoder(VOCABULARY)
    texts = [" ".join(f"w{(i * j) % 97}x" for j in range(20)) for i in range(2000)]
    assert enc.encode_all(texts) == [fresh.encode(t) for t in texts]


# -- language model


def test_lm_base_and_order(spark, docs, none):
    rows = [r.asDict() for r in docs.collect()]
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1
    words = lambda t: [*WORD.findall(lower(t or "")), None]
    c = Counter(w for r in rows if not held(r["doc_id"]) for w in words(r["text"]))
    n, v = sum(c.values()), len(c)
    got = lm_score.lm_scores(docs, VOCABULARY).collect()
    assert len(got) == len(rows)
    want = Counter((r["doc_id"], held(r["doc_id"]), len(words(r["text"])), sum(c[w] > 0 for w in words(r["text"])), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(r["text"])), 6)) for r in rows)
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_score.lm_scores(none, VOCABULARY).count() == 0


def _small_model(size=60, kind=np.float64):
    """A model over few symbols, with several classes, and weights that differ from the first ones everywhere."""
    r = np.random.RandomState(3)
    layout = lm_score.Layout(np.r_[(r.rand(size) ** 8 * 1000).round(), 40])
    p = {k: (v + r.randn(*v.shape) * 0.2).astype(kind) for k, v in lm_score.fresh(layout).items()}
    return layout, p


def _texts(layout, lengths, seed=1):
    r, end = np.random.RandomState(seed), layout.rank[-1]
    return [np.concatenate([[end], r.randint(0, layout.pad, n), [end]]).astype(np.int32) for n in lengths]


def plain_log_probability(layout, p, seq):
    """Sum over a text, place by place: keys from the window's start, then class and member."""
    total, d = 0.0, lm_score.HEAD_DIM
    x = [p["e"][i] + p["p"][j] for i, j in zip(seq, [layout.pad, *seq])]
    for i in range(len(seq) - 1):
        first = max(0, (i // lm_score.SPAN - 1) * lm_score.SPAN)
        o = []
        for h in range(lm_score.HEADS):
            q = (x[i] @ p["q"])[h * d : h * d + d] / d**0.5
            w = np.exp([q @ (x[j] @ p["kv"])[h * d : h * d + d] + p["r"][h][i - j] for j in range(first, i + 1)])
            o.append(sum(a * (x[j] @ p["kv"])[lm_score.DIM + h * d :][:d] for a, j in zip(w / w.sum(), range(first, i + 1))))
        h = x[i] + np.concatenate(o) @ p["o"]
        z = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
        y = seq[i + 1]
        c = np.exp(z @ p["uc"] + p["bc"])
        k = layout.class_of[y]
        lo, hi = layout.cuts[k], layout.cuts[k + 1]
        m = np.exp(p["u"][lo:hi] @ z + p["b"][lo:hi])
        total += np.log(c[k] / c.sum() * m[y - lo] / m.sum())
    return total


def test_score_equals_the_plain_version():
    layout, p = _small_model()
    assert len(layout.cuts) > 4 and max(np.diff(layout.cuts)) > 1
    seqs = _texts(layout, (0, 1, 15, 16, 17, 31, 33, 70))
    w, row = lm_score.windows(seqs, layout.pad)
    got = np.bincount(row, lm_score.Attention(layout, p).log_probability(w).sum(1), len(seqs))
    assert np.allclose(got, [plain_log_probability(layout, p, s) for s in seqs], rtol=1e-6)


def test_model_is_a_distribution_and_causal():
    layout, p = _small_model()
    m = lm_score.Attention(layout, p)
    every = [np.r_[s[:20], y, s[21:]] for s in _texts(layout, (40,)) for y in range(layout.pad)]
    lp = [m.log_probability(lm_score.windows([s], layout.pad)[0]) for s in every]
    assert abs(sum(np.exp(x.ravel()[19]) for x in lp) - 1) < 1e-6
    assert all(np.allclose(x.ravel()[:19], lp[0].ravel()[:19]) for x in lp)


def test_classes_are_bounded_runs():
    layout = lm_score.Layout(np.r_[1e6, 1e5, np.ones(10_000), 5])
    assert np.diff(layout.cuts).max() <= lm_score.LARGEST and layout.cuts[-1] == 10_003 and sorted(layout.rank) == list(range(10_003))


def test_gradients_match_differences():
    layout, p = _small_model()
    m = lm_score.Attention(layout, p)
    w, _ = lm_score.windows(_texts(layout, (15, 3)), layout.pad)  # no ids before the span: those are constants to the gradient
    g, rows = m.gradients(w)
    for k in lm_score.TABLES:
        g[k] = np.zeros_like(p[k])
    for k, at, d in rows:
        g[k][at] += d
    n = (w[:, lm_score.SPAN + 2 :] != layout.pad).sum()
    for name in p:
        flat, at = p[name].reshape(-1), int(np.abs(g[name]).argmax())
        old, loss = flat[at], []
        for step in (1e-5, -1e-5):
            flat[at] = old + step
            loss.append(-m.log_probability(w).sum() / n)
        flat[at] = old
        want = (loss[0] - loss[1]) / 2e-5
        assert abs(want) > 1e-4 and abs(want - g[name].reshape(-1)[at]) < 1e-3 * abs(want) + 1e-6, name


def test_windows_count_each_target_once():
    layout, _ = _small_model()
    seqs = _texts(layout, (0, 15, 16, 17, 100))
    w, row = lm_score.windows(seqs, layout.pad)
    for i, s in enumerate(seqs):
        y = w[row == i][:, lm_score.SPAN + 2 :].ravel()
        assert y[y != layout.pad].tolist() == s[1:].tolist()


def test_keys_before_the_span_are_constants():
    """The gradient of a later window, with respect to weights that only its own places use."""
    layout, p = _small_model()
    m = lm_score.Attention(layout, p)
    w = lm_score.windows(_texts(layout, (40,)), layout.pad)[0][1:2]
    g, _ = m.gradients(w)
    for name in ("q", "o", "w1", "b1", "w2", "uc", "bc", "r"):
        flat, at, loss = p[name].reshape(-1), int(np.abs(g[name]).argmax()), []
        old = flat[at]
        for step in (1e-5, -1e-5):
            flat[at] = old + step
            loss.append(-m.log_probability(w).sum() / lm_score.SPAN)
        flat[at] = old
        assert abs((loss[0] - loss[1]) / 2e-5 - g[name].reshape(-1)[at]) < 1e-3 * abs(g[name].reshape(-1)[at]) + 1e-6, name


def test_training_takes_every_window_once(spark, monkeypatch):
    layout, p = _small_model(kind=np.float32)
    r = np.random.RandomState(4)
    blobs = [r.randint(0, 50, n).astype("<u2").tobytes() for n in (0, 5, 40, 300, 40, 700)] * 20
    df = spark.createDataFrame([(i if i % 7 else None, bytearray(b)) for i, b in enumerate(blobs)], "doc_id long, ids binary")
    rounds = [[bytes(x["ids"]) for x in df.filter(lm_score.round_of() == turn).collect()] for turn in range(len(lm_score.SHARES))]
    assert Counter(b for x in rounds for b in x) == Counter(blobs) and len(rounds[2]) > len(rounds[1]) > len(rounds[0]) > 0
    seen = Counter()
    monkeypatch.setattr(lm_score.Attention, "gradients", lambda self, w: seen.update(x.tobytes() for x in w) or ({}, []))
    monkeypatch.setattr(lm_score, "POOL", 100)
    t, want = lm_score.Trainer(layout, p, None, 0, 10), Counter()
    for i in range(0, len(blobs), 7):
        w, _ = lm_score.windows(lm_score._sequences(blobs[i : i + 7], layout.rank, 2), layout.pad)
        want.update(x.tobytes() for x in w)
        t.add(w)
    t.learn()
    assert seen == want


def test_weights_are_averaged_in_groups(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FAN", 3)
    r = np.random.RandomState(1)
    rows = [(t, "e", 0, float(t + 1), bytearray(r.rand(4).astype(np.float32).tobytes())) for t in range(11)] + [(5, "q", 0, 2.0, bytearray(np.ones(2, np.float32).tobytes()))]
    got = {x["name"]: np.frombuffer(x["w"], np.float32) for x in lm_score.averaged(spark.createDataFrame(rows, lm_score._WEIGHTS), 11).collect()}
    e = [x for x in rows if x[1] == "e"]
    assert np.allclose(got["e"], sum(x[3] * np.frombuffer(x[4], np.float32) for x in e) / sum(x[3] for x in e)) and got["q"].tolist() == [1, 1] and len(got) == 2


def test_held_out_texts_score_above_the_base(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_score.lm_scores(df, VOCABULARY).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print("score and base per word:", r[0] / r[2], r[1] / r[2])
    assert r[0] > r[1]


# -- mixing


def test_mixing(spark, docs, none):
    rows = [r.asDict() for r in docs.collect()]
    got = [r.asDict() for r in mixing.mix_report(docs).collect()]
    size = lambda t: len(WORD.findall(t or ""))
    total = Counter()
    for r in rows:
        total[r["source"]] += size(r["text"])
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(total.values())
    while True:
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            open_.discard(s)
        rest = 1.5 * sum(total.values()) - sum(target.values())
    target |= share
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter((r["doc_id"], size(r["text"]), total[r["source"]], round(target[r["source"]], 6)) for r in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = Counter()
    for r in got:
        by[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert all(abs(by[total[s], round(target[s], 6)] - target[s]) <= 1 for s in order)
    assert mixing.mix_report(none).count() == 0


def test_mixing_reruns_agree_and_blocks_are_dealt(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5)).alias("source"), F.repeat(F.lit("w "), (F.col("id") * 7 % 90).cast("int")).alias("text"))
    a, b = ({tuple(r) for r in mixing.mix_report(df.repartition(n)).collect()} for n in (2, 7))
    assert a == b
    sources = mixing.targets(mixing.sized(df))
    s = mixing.slots(sources, block=16).toPandas()
    assert not s.duplicated(["shard", "position"]).any() and not s.duplicated(["skey", "pass", "block_no"]).any()
    want = {r["skey"]: round(r["target"]) for r in sources.collect()}
    assert s.groupby("skey").words.sum().to_dict() == want


def plain_permuted(x, n, keys, seed):
    """The permutation with Python numbers; Spark's xxhash64 takes 4 bytes of an int, 8 of a long, the bytes of a text."""
    import math

    import xxhash

    def hashed(salt, k, other):
        h = 42
        for v in (salt.encode(), int(k).to_bytes(4, "little"), int(other).to_bytes(8, "little"), *(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little") for v in keys)):
            h = xxhash.xxh64(v, seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    a = max(1, math.isqrt(n))
    b = max(1, n // a)

    def stirred(x, salt):
        if x >= a * b:
            return x
        left, right = divmod(x, b)
        for k in range(2 * mixing.ROUNDS):
            if k % 2 == 0:
                left = (left + hashed(salt, k, right) % a) % a
            else:
                right = (right + hashed(salt, k, left) % b) % b
        return left * b + right

    x = stirred(x, f"{seed}1")
    return stirred((x + n // 2) % n if x < n else x, f"{seed}2")


def test_taken_equals_the_plain_mix(spark):
    """Every document's words taken, from slots, permutations and packed blocks written down in plain Python."""
    rows = [(i, ["a", "b", "ü", None][i % 7 % 4], " ".join("w" * (i * 13 % 90))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    placed, sources, pieces = mixing._mix(df, 16, "mix")
    want, order = Counter(), {}
    for r in sorted(placed.collect(), key=lambda r: r["start"]):
        order.setdefault(r["skey"], []).extend([r["doc_id"]] * r["size"])
    for s in sources.collect():
        words, take = order[s["skey"]], round(s["target"])
        n_blocks, n_full, t = -(-len(words) // 16), len(words) // 16, 0
        while take:
            p, j = divmod(t, n_blocks)
            at = plain_permuted(j, n_full, [s["skey"], p], "mix-block") if j < n_full else j
            got = words[at * 16 : at * 16 + 16][:take] if p == take_passes(s, words) else words[at * 16 : at * 16 + 16]
            want.update(got)
            take, t = take - len(got), t + 1
    assert {r["doc_id"]: r["taken"] for r in mixing.mixed(df, 16).collect()} == {i: want[i] for i, *_ in rows}


def take_passes(s, words):
    return round(s["target"]) // len(words)


def test_shard_counts_are_a_draw_without_replacement(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    sources = spark.createDataFrame([(f"={i}", 16 * n, float(16 * n)) for i, n in enumerate((600, 300, 100))], "skey string, source_size long, target double")
    draw = mixing.drawn(mixing.wanted(sources, 16)).toPandas().pivot(index="shard", columns="skey", values="n").fillna(0)
    assert len(draw) == 10 and (draw.sum(axis=1) == 100).all() and draw.sum().tolist() == [600, 300, 100]
    # The spread of a hypergeometric draw: n p (1 - p) (N - n) / (N - 1), about 21.6 for the largest source.
    assert 4 < draw["=0"].var() < 70 and draw["=0"].nunique() > 3


def test_many_sources_and_ranges(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.col("id") % 1000).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    got = mixing.targets(mixing.sized(df)).toPandas().set_index("skey")
    w = {k: (3, 1, 2)[i % 3] for i, k in enumerate(sorted(got.index))}
    assert abs(got.target.sum() - 1.5 * got.source_size.sum()) < 1e-6 and (got.target <= 2 * got.source_size + 1e-9).all()
    free = got[got.target < 2 * got.source_size - 1e-9]
    assert np.ptp([r.target / w[k] for k, r in free.iterrows()]) < 1e-6


def test_permutation_covers(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("long")).withColumn("k", F.lit("x"))
        got = [r["o"] for r in mixing.permuted(df, "id", "n", ["k"], "o", "s").orderBy("id").collect()]
        assert sorted(got) == list(range(n)) and got == [plain_permuted(x, n, ["x"], "s") for x in range(n)]


def test_mixed_documents_keep_their_columns(spark, docs):
    m = mixing.mix_documents(docs)
    assert m.columns == docs.columns
    words = m.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == sum(r["taken"] for r in mixing.mix_report(docs).collect())


def test_mixed_texts_are_the_words_of_the_chosen_blocks(spark):
    text = lambda i: "  " + "".join(f"d{i}w{j}" + ("\t\n" if j % 3 else " ") for j in range(i * 37 % 150))
    rows = [(i, text(i), "abc"[i % 3]) for i in range(40)] + [(7, text(7), "b"), (None, text(5), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    placed, sources, _ = mixing._mix(df, 16, "mix")
    blocks, texts = {}, {r[0]: r[1] for r in rows}
    for r in sorted(placed.collect(), key=lambda r: r["start"]):
        for w in WORD.findall(texts[r["doc_id"]]):
            blocks.setdefault(r["skey"], []).append(w)
    want = Counter(w for s in mixing.slots(sources, 16).collect() for w in blocks[s["skey"]][s["block_no"] * 16 :][: s["words"]])
    got = [r["text"] for r in mixing.mix_documents(df, 16).collect()]
    assert Counter(w for t in got for w in WORD.findall(t)) == want
    assert all(len(WORD.findall(t)) <= 16 and any(t in r[1] for r in rows) for t in got)


def test_mix_is_written_by_the_shards_drawn(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 8)
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.concat(F.lit("d"), F.repeat(F.lit("w "), (F.col("id") * 7 % 50 + 1).cast("int"))).alias("text"))
    placed, sources, pieces = mixing._mix(df, 16, "mix")
    drawn = Counter((s["shard"], s["skey"]) for s in mixing.slots(sources, 16).collect())
    places = {(p["shard"], p["position"], p["skey"]) for p in pieces.collect()}
    assert Counter((s, k) for s, _, k in places) == drawn and len({s for s, _, _ in places}) > 3
    assert len(places) == len({p[:2] for p in places}) == sum(drawn.values())
    ids = {(r["skey"], r["start"]): r["doc_id"] for r in placed.filter("size > 0").collect()}
    first = {}
    for p in pieces.collect():
        i = ids[p["skey"], p["start"]]
        first[i] = min(first.get(i, (1 << 60, 0)), (p["shard"], p["position"]))
    got = mixing.mixed(df, 16).select("doc_id", "shard", "position").collect()
    assert {r["doc_id"]: (r["shard"], r["position"]) for r in got if r["shard"] is not None} == first
    assert {"shard", "position"} <= set(mixing.mix_report(df).columns)
    # The documents come in the order of the mix: each task holds whole shards.
    order = sorted(((p["shard"], p["position"], p["start"], ids[p["skey"], p["start"]]) for p in pieces.collect()))
    parts = mixing.mix_documents(df, 16).select("doc_id", F.spark_partition_id().alias("part")).collect()
    by_part = {}
    for r in parts:
        by_part.setdefault(r["part"], []).append(r["doc_id"])
    runs = {}
    for s, _, _, i in order:
        runs.setdefault(s, []).append(i)
    left = dict(runs)
    for found in by_part.values():
        while found:
            s = next(s for s in sorted(left) if left[s] == found[: len(left[s])])
            found = found[len(left.pop(s)) :]
    assert not left


# -- near duplicates


def components(rows, k, percent):
    sets, links = [], {}
    for r in rows:
        w = WORD.findall(lower(r["text"] or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    for i in range(len(rows)):
        links.setdefault(find(i), []).append(rows[i]["doc_id"])
    least = {c: min((x for x in ids if x is not None), default=None) for c, ids in links.items()}
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, docs, none, k):
    rows = [r.asDict() for r in docs.collect()]
    want = Counter((r["doc_id"], n, c, c is not None and r["doc_id"] == c) for r, (n, c) in zip(rows, components(rows, k, 80)))
    assert Counter(tuple(r) for r in near_dup.near_duplicates(docs, k).collect()) == want
    assert near_dup.near_duplicates(none, k).count() == 0


def test_near_duplicate_families(spark):
    """Chains and large families of edited copies: every region size, and components that few links hold together."""
    r, rows = np.random.RandomState(5), []
    for family in range(6):
        words = [f"f{family}_{i}" for i in range(80)]
        for _ in range((3, 9, 20, 60, 120, 2)[family]):
            w = list(words)
            for i in r.choice(80, r.randint(0, 7), replace=False):
                w[i] = f"e{r.randint(10**9)}"
            rows.append({"doc_id": len(rows), "text": " ".join(w)})
            if family == 2:
                words = w
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(spark.createDataFrame(rows).repartition(5), 4).collect()}
    assert got == {x["doc_id"]: c for x, (_, c) in zip(rows, components(rows, 4, 80))}


def test_boilerplate_that_does_not_link(spark, monkeypatch):
    """A large region of pages that share 60 to 75 % of their text, among them a few true links: the exact rest finds
    all of them, by few comparisons."""
    r, rows, base = np.random.RandomState(8), [], [f"b{i}" for i in range(70)]
    for i in range(260):
        rows.append({"doc_id": i, "text": " ".join(base + [f"own{i}_{j}" for j in range(r.randint(24, 45))])})
    for i in range(0, 40, 4):  # a link: one word of the last changed
        words = rows[i]["text"].split()
        words[-2] = "other"
        rows.append({"doc_id": len(rows), "text": " ".join(words)})
    met, old = [], near_dup.confirmed
    monkeypatch.setattr(near_dup, "confirmed", lambda pairs, sets, percent: met.append(pairs.count()) or old(pairs, sets, percent))
    monkeypatch.setattr(near_dup, "NEIGHBOURS", 1)
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(spark.createDataFrame(rows).repartition(5), 4).collect()}
    assert got == {x["doc_id"]: c for x, (_, c) in zip(rows, components(rows, 4, 80))} and sum(c != i for i, c in got.items()) == 10
    assert len(met) == 3 and met[2] < 3 * len(rows)  # all pairs would be some 30 000


def test_rows_without_id_are_kept_once(spark):
    rows = [(1, "one two three four five"), (None, "one two three four five"), (None, "six"), (None, "six"), (None, None), (None, None), (2, "seven")]
    got = near_dup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "one two three four five"), (None, "six"), (None, None), (2, "seven")])


def test_deduplicate_keeps_one(spark, docs):
    out = near_dup.deduplicate(docs)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and len(ids) == len(set(ids)) and {18, 21} - set(ids) == {21}


# -- token counts


def plain_segmentations(word, pieces):
    """Every segmentation of a short word: (log probability, tokens), pieces as a list."""
    if not word:
        return [(0.0, [])]
    n = len(word[-1].encode())
    out = [(s + n * pieces.byte, [*p, *[None] * n]) for s, p in plain_segmentations(word[:-1], pieces)]
    for k in range(1, len(word) + 1):
        if word[-k:] in pieces.place:
            out += [(s + pieces.scores[pieces.place[word[-k:]]], [*p, word[-k:]]) for s, p in plain_segmentations(word[:-k], pieces)]
    return out


def plain_count(word, pieces):
    """Viterbi over one word by itself."""
    word = "▁" + word
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        options = [(-(best[i - 1][0] + n * pieces.byte), best[i - 1][1] + n)]
        options += [(-(best[j][0] + pieces.scores[pieces.place[word[j:i]]]), best[j][1] + 1) for j in range(i) if word[j:i] in pieces.place]
        s, c = min(options)
        best.append((-s, c))
    return best[-1][1]


def test_token_counts(spark, docs, none):
    from hopgrid.llm.common import shared_dir

    path, folder = public_tokenizers.path("piece_bpe_32k.model"), shared_dir(spark, "t")
    pieces = token_counts._load(folder, token_counts.train(docs.select("doc_id", "text"), token_counts.vocabulary(path), folder))
    rows = [r.asDict() for r in docs.collect()]
    # Training by the same rounds over one word at a time.
    words, plain = Counter(w for r in rows for w in WORD.findall(r["text"] or "")), token_counts.Pieces(token_counts.vocabulary(path))
    for _ in range(token_counts.ROUNDS):
        total = np.zeros(len(plain.scores))
        for w, n in words.items():
            plain.expect_one("▁" + w, n, total)
        plain = plain.trained(total)
    assert np.allclose(pieces.scores, plain.scores, atol=1e-6)
    want = Counter((r["doc_id"], len(w), sum(plain_count(x, pieces) for x in w)) for r in rows for w in [WORD.findall(r["text"] or "")])
    assert Counter(map(tuple, token_counts.token_counts(docs, path).collect())) == want
    assert token_counts.token_counts(none, path).count() == 0


def _few_pieces():
    p = token_counts.Pieces(["▁", "a", "b", "ab", "▁ab", "aba", "bab", "▁abab"])
    return token_counts.Pieces(p.pieces, np.round(np.log(np.random.RandomState(1).dirichlet(np.ones(9))), 6))


def test_shared_prefixes_equal_single_words(monkeypatch):
    words = sorted({"".join(p) for n in range(1, 6) for p in __import__("itertools").product("abé", repeat=n)})
    pieces = _few_pieces()
    for size in (50_000, 7):
        monkeypatch.setattr(token_counts, "WORDS", size)
        assert pieces.counts(words).tolist() == [plain_count(w, pieces) for w in words] == [pieces.count_one("▁" + w) for w in words]


def test_expectation_equals_all_segmentations():
    words, pieces = sorted(["abab", "aba", "é", "babab", "abé", "a"]), _few_pieces()
    n = np.arange(1.0, 7.0)
    want = np.zeros(9)
    for w, times in zip(words, n):
        every = plain_segmentations("▁" + w, pieces)
        total = sum(np.exp(s) for s, _ in every)
        for s, p in every:
            for x in p:
                want[-1 if x is None else pieces.place[x]] += times * np.exp(s) / total
    one = np.zeros(9)
    for w, times in zip(words, n):
        pieces.expect_one("▁" + w, times, one)
    assert np.allclose(pieces.expected(words, n), want) and np.allclose(one, want)


def test_each_prefix_is_one_node():
    words = sorted(["ab", "abc", "abd", "b", "bcd"])
    assert token_counts.Trie(["▁" + w for w in words], _few_pieces()).size == 1 + len({("▁" + w)[:i] for w in words for i in range(1, len(w) + 2)})


def test_no_pieces_and_very_long_words():
    none = token_counts.Pieces([])
    assert none.counts(["a", "é"]).tolist() == [4, 5]  # the mark has three bytes
    pieces = _few_pieces()
    long = "ab" * 50_000
    assert pieces.counts(sorted(["ab", long])).tolist() == [plain_count("ab", pieces), plain_count_long(long, pieces)]


def plain_count_long(word, pieces):
    word, best = "▁" + word, [(0.0, 0)]
    for i in range(1, len(word) + 1):
        options = [(-(best[i - 1][0] + len(word[i - 1].encode()) * pieces.byte), best[i - 1][1] + len(word[i - 1].encode()))]
        options += [(-(best[j][0] + pieces.scores[pieces.place[word[j:i]]]), best[j][1] + 1) for j in range(max(0, i - 5), i) if word[j:i] in pieces.place]
        s, c = min(options)
        best.append((-s, c))
    return best[-1][1]


# -- fingerprints


def plain_print(text):
    """A fingerprint bin by bin, with Python numbers, from the words' hashes."""
    from hopgrid.llm.common import hashed_words

    mask, words = (1 << 64) - 1, WORD.findall(lower(text))

    def mix(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & mask
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & mask
        return x ^ x >> 33

    if not words:
        return None
    h = [int(hashed_words(pa.array([w]))[0][0]) for w in words]
    least, k = {}, min(fp.SHINGLE, len(h))
    for i in range(len(h) - k + 1):
        x = k
        for w in h[i : i + k]:
            x = mix((x * 0x9E3779B97F4A7C15 + w) & mask)
        b = x >> 55
        least[b] = min(least.get(b, mask), x & (1 << 55) - 1)
    out = []
    for b in range(512):
        tries = [b, *(mix(attempt * 512 + b + 0x51ED270B) % 512 for attempt in range(fp.ATTEMPTS)), *((b + step) % 512 for step in range(1, 512))]
        at = next(x for x in tries if x in least)
        out.append(mix(least[at]) & 15)
    return out


def plain_likeness(a, b):
    if a is None or b is None:
        return float(a == b)
    return min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b)) / 512 - 1 / 16) / (15 / 16)))


def test_fingerprints(spark, docs, none):
    """Every column against the plain version; the order of rows of one doc_id is that of a hash, so those follow either way."""
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    texts = [r["text"] or "" for r in rows]
    want = Counter()
    for i, t in enumerate(texts):
        n, following = len(t) // 4, texts[(i + 1) % len(texts)]
        e = t[: len(t) - n] + following[:n]
        a, b, c = plain_print(t), plain_print(e), plain_print(following)
        code = lambda x: "".join("0123456789abcdef"[v] for v in x or [])
        want[rows[i]["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest(), code(a), code(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)] += 1
    got = fp.fingerprint_report(docs).collect()
    have = Counter((*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)
    assert have == want
    assert fp.fingerprint_report(none).count() == 0


def test_single_document_follows_itself(spark):
    r = fp.fingerprint_report(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and r["near_next"] == 1.0


def test_likeness_estimates_jaccard():
    r = np.random.RandomState(0)
    for keep in (0.5, 0.8, 0.95):
        a = [f"a{i}" for i in range(2000)]
        b = a[: int(2000 * keep)] + [f"b{i}" for i in range(2000 - int(2000 * keep))]
        sa, sb = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        x = fp.fingerprints([" ".join(a), " ".join(b)])
        assert abs(fp.likeness(x[:1], x[1:])[0] - len(sa & sb) / len(sa | sb)) < 0.08
        assert (fp.unpacked(fp.packed(x)) == x).all()
    del r


# -- quality


def test_quality_tells_junk_it_was_not_shown(spark):
    """Trained on four fifths of the labels, judged on the rest."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    shown = labels.filter("doc_id % 5 <> 2")
    got = quality.quality_scores(docs, shown).join(labels.filter("doc_id % 5 = 2"), "doc_id").toPandas()
    good, bad = got[got.quality == 1].kept, got[got.quality == 0].kept
    assert len(bad) >= 10 and good.mean() > 0.98 and bad.mean() < 0.25
    kept = quality.keep_good(docs, shown)
    assert kept.columns == docs.columns and kept.count() == quality.quality_scores(docs, shown).filter("kept").count()


def test_quality_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (18, 1), (18, 0), (None, 1), (36, None)], "doc_id long, quality int")
    got = collected(quality.quality_scores(docs, labels))
    assert len(got) == docs.count() and not any(r["kept"] for r in got if r["n_tokens"] == 0)
    nothing = quality.quality_scores(docs, labels.limit(0)).collect()
    assert all(r["kept"] == (r["n_tokens"] > 0) for r in nothing)
    assert quality.quality_scores(none, labels).count() == 0 and quality.keep_good(docs, labels).columns == docs.columns


def test_trusted_documents(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, 0), (4, 0, 0), (5, 1, None), (None, 1, 0), (6, None, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in quality.trusted_ids(labels).collect()} == {1, 5}
    assert {r["doc_id"] for r in quality.trusted_ids(labels.drop("toxic")).collect()} == {1, 2, 5}


SIGNS = re.compile(r"[^\x20\x09-\x0D\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]+|[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]+")


def plain_words(text):
    out, last, run = [], None, 0
    for w in SIGNS.findall(text or ""):
        run = run + 1 if w == last else 0
        out.append(("run", min(run, quality.RUNS - 1)) if run else w)
        last = w
    return out


class PlainKneserNey:
    """Interpolated modified Kneser-Ney by its formulas, over dictionaries."""

    def __init__(self, texts):
        words = Counter(w for t in texts for w in plain_words(t))
        self.known = {w for w, n in words.items() if n >= quality.LEAST}
        self.spellings, self.size = sum(n < quality.LEAST for n in words.values()) + 1, len(self.known) + 1
        tri = Counter(g for t in texts for g in self.grams(t))
        bi = Counter(g[1:] for g in tri)
        uni = Counter(g[1:] for g in bi)
        self.orders = [(c, self.discounts(c), self.contexts(c)) for c in (uni, bi, tri)]

    def grams(self, text):
        w = ["<s>", "<s>", *(x if x in self.known else "<unknown>" for x in plain_words(text))]
        return list(zip(w, w[1:], w[2:]))

    @staticmethod
    def discounts(c):
        n = [0, *(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2] + 1e-9)
        return [min(max(i - (i + 1) * y * n[i + 1] / (n[i] + 1e-9), 0.1), i - 0.1) if n[i] else 0.75 for i in (1, 2, 3)]

    @staticmethod
    def contexts(c):
        out = {}
        for g, n in c.items():
            out.setdefault(g[:-1], []).append(n)
        return out

    def p(self, gram):
        if not gram:
            return 1 / self.size
        c, d, contexts = self.orders[len(gram) - 1]
        seen = contexts.get(gram[:-1])
        if not seen:
            return self.p(gram[1:])
        cut = lambda n: d[min(n, 3) - 1]
        n = c.get(gram, 0)
        return (n - cut(n) if n else 0) / sum(seen) + sum(map(cut, seen)) / sum(seen) * self.p(gram[1:])

    def score(self, text):
        return sum(np.log10(self.p(g) / (self.spellings if g[-1] == "<unknown>" else 1)) for g in self.grams(text))


def test_kneser_ney_equals_the_formulas(spark):
    r = np.random.RandomState(2)
    word = lambda: ["the", "The", "cat,", "sat!!", "on", "mat.", "x%y", "é", f"w{r.randint(40)}"][r.randint(9)]
    rows = [(i, "=" + "xy"[i % 2], " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(60)] + [(60, "=x", "go go go go go go go go go go no no")]
    texts = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    model, seen = quality.train(texts, texts.select("doc_id"))
    seen = {x["doc_id"] for x in seen.collect()}
    assert 35 < len(seen) < 60
    for lang in ("=x", "=y", quality.ALL):
        plain = PlainKneserNey([t for i, x, t in rows if i in seen and lang in (x, quality.ALL)])
        got, n = model.score(lang, pa.array([t for *_, t in rows] + ["", None]))
        assert n.tolist() == [len(plain_words(t)) for *_, t in rows] + [0, 0]
        assert np.allclose(got[:-2], [plain.score(t) for *_, t in rows], atol=2e-5 * n[:-2].max())
        # Given a context, known words and the spellings of the unknown one sum to one.
        numbers = np.arange(quality.UNKNOWN, plain.size + quality.UNKNOWN)
        for a, b in ((0, 0), (3, 4), (4, 3), (5, 1), (1, 1)):
            p = 10.0 ** model.log10(lang, (a << 2 * quality.BITS) | (b << quality.BITS) | numbers)
            p[0] *= plain.spellings
            assert abs(p.sum() - 1) < 1e-4


def test_samples_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_CHARS", 4000)
    texts = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "=b").otherwise("=a").alias("lang"), F.lit("some twenty letters.").alias("text"))
    seen = quality.train(texts, texts.select("doc_id"))[1].count()
    assert 250 < seen < 600  # about 200 documents of each language; those for all are among them


# -- main text


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=x>Menu one</a><a href=y>Menu two</a></nav>
    <div class="cookie-notice"><p>We use cookies here</p></div><article><header><h1>A &amp; B</h1></header><p>First   <b>para</b>\n graph with words enough.<p>Second one &eacute;&#233;&lt;x&gt; goes on.<ul><li>item one<li>item two</ul>
    <div class="ad-slot">Buy now</div><form><input><p>Name</p></form><section id="comments"><p>I disagree with all of it</p></section></article><aside><p>Other things</p></aside><footer>&copy; someone</footer></body></html>"""
    assert html_text.main_text(page) == "A & B\n\nFirst para graph with words enough.\n\nSecond one éé<x> goes on.\n\nitem one\n\nitem two"
    plain = '<body><div id="top"><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><div><h2>Head</h2><div><p>' + "Many words of running text. " * 20 + "</p><p>" + "And still more of them here. " * 20 + '</p></div></div><div class="x"><a href=4>link</a><a href=5>other</a></div></body>'
    got = html_text.main_text(plain)
    assert got.startswith("Head\n\nMany words") and "link" not in got and "a b c" not in got
    for empty in (None, "", "<html></html>", "<nav>only</nav>", "<scr", "<p"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("just text") == "just text" and html_text.main_text("1 < 2 <b>x") == "1 < 2 x"


def test_names_are_evidence_only():
    page = '<article><p>Intro</p><div class="social-history"><p>Long text about the history of it.</p></div><div id="search-results-analysis"><p>More.</p></div><div class="thread"><p>I disagree</p></div></article>'
    assert html_text.main_text(page) == "Intro\n\nLong text about the history of it.\n\nMore."
    large = '<div class="share"><p>' + "This part is most of the page. " * 200 + "</p></div><p>Short</p>"
    assert html_text.main_text(large).startswith("This part")


def test_deep_pages_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        assert html_text.main_text("<div>" * n + "x" + "</div>" * n) == "x"
        html_text.main_text("<b>" * n + "<p>x" * n)
        html_text.main_text("<b><table><td>" + "<i>" * n + "</b>" * n + "y")
        return time.process_time() - began

    took(1000)
    assert took(20_000) < 20 * max(took(4_000), 0.05)  # 5 times the depth; the square would be 25 times the time


def plain_main_text(page):
    """The method written down once more, over the standard library's parser, with sums by recursion."""
    import math
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.at = self.top = {"tag": "html", "kids": [], "up": None}
            self.raw = 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "title"):
                self.at["tags"] = self.at.get("tags", 0) + 1
                self.raw += 1
                return
            if tag in ("br", "meta"):
                self.at["tags"] = self.at.get("tags", 0) + 1
                self.at["kids"].append(" ")
                return
            if tag == "html":
                return
            if tag in html_text.BLOCK:
                x = self.at
                while x and x["tag"] not in html_text.BLOCK:
                    x = x["up"]
                if x and x["tag"] == "p":
                    self.at = x["up"]
            new = {"tag": tag, "kids": [], "up": self.at, "attrs": dict(attrs)}
            self.at["tags"] = self.at.get("tags", 0) + 1
            self.at["kids"].append(new)
            self.at = new

        def handle_endtag(self, tag):
            if tag in ("script", "style", "title"):
                self.raw -= 1
                return
            x = self.at
            while x and x["tag"] != tag:
                x = x["up"]
            if x and x["up"]:
                self.at = x["up"]

        def handle_data(self, data):
            if not self.raw:
                self.at["kids"].append(data)

    t = Tree()
    t.feed(page)

    def totals(x, marked, link, inside):
        marked = marked or html_text._is_marked(x["tag"], x.get("attrs", {}), inside)
        inside = inside or x["tag"] == "article"
        own = sum(len(k) for k in x["kids"] if isinstance(k, str) and k != " ")
        x |= {"marked": marked, "inside": inside, "own": own, "c": own, "t": x.get("tags", 0)}
        x["lc"], x["lt"] = (own if marked or link or x["tag"] == "a" else 0), (x["t"] if marked else 0) + (x["tag"] == "a" and not marked)
        for k in x["kids"]:
            if not isinstance(k, str):
                totals(k, marked, link or x["tag"] == "a", inside)
                for n in ("c", "t", "lc", "lt"):
                    x[n] += k[n]

    totals(t.top, False, False, False)

    def density(x):
        if not x["c"]:
            return 0.0
        base = math.log(x["c"] * x["lc"] / max(1, x["c"] - x["lc"]) + t.top["lc"] / t.top["c"] * x["c"] + math.e)
        return x["c"] / max(1, x["t"]) * math.log(max(1.0, x["c"] / max(1, x["lc"]) * max(1, x["t"]) / max(1, x["lt"]))) / math.log(max(base, math.e))

    best, stack = (0.0, None), [t.top]
    while stack:
        x = stack.pop()
        kids = [k for k in x["kids"] if not isinstance(k, str)]
        stack += kids
        s = (sum(map(density, kids)) + (density(x) * x["own"] / x["c"] if x["own"] else 0)) * (2 if x["inside"] else 1)
        best = max(best, (s, x), key=lambda b: b[0])
    path, x = [], best[1]
    while x:
        path.append(x)
        x = x["up"]
    top = next((x for x in reversed(path) if x["tag"] == "article"), best[1])
    out, line = [], []

    def flush():
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    def write(x):
        for k in x["kids"]:
            if isinstance(k, str):
                line.append(k)
            elif not k["marked"]:
                if k["tag"] in html_text.BLOCK:
                    flush()
                write(k)
                if k["tag"] in html_text.BLOCK:
                    flush()

    write(top)
    flush()
    return "\n\n".join(out)


@pytest.fixture(scope="module")
def web(sf_dir):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf_dir}/pages.parquet", columns=["html"]).column(0).to_pylist()


def test_main_text_equals_the_plain_version(web):
    for h in web:
        assert html_text.main_text(h) == plain_main_text(h)


def test_density_decides(web, monkeypatch):
    want = [html_text.main_text(h) for h in web]
    renamed = [html_text.main_text(h.replace("<article>", "<div>").replace("</article>", "</div>")) for h in web]
    assert sum(a == b for a, b in zip(want, renamed)) >= 0.98 * len(web)
    monkeypatch.setattr(html_text, "_density", lambda n, share: 0.0)
    assert not any(html_text.main_text(h) for h in web)


def test_pages_through_spark(spark, web):
    rows = [(1, "u", web[0]), (1, "u", web[0]), (2, None, None), (None, "v", ""), (3, "w", "<p>Some words " * 5000), (4, "x", web[1])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("mine")})
    got = Counter(map(tuple, html_text.extract(df).collect()))
    assert got == Counter((i, u, t, len(t)) for i, u, h in rows for t in [html_text.main_text(h)])
    assert html_text.extract(df.limit(0)).count() == 0


# -- decontamination


def contamination(rows, items):
    win = {}
    for i, t in items:
        w = PLAIN.findall(lower(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            win.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    out = []
    for r in rows:
        w, hit, found = PLAIN.findall(lower(r["text"] or "")), set(), set()
        for n in {len(k) for k in win}:
            for k in range(len(w) - n + 1):
                if own := win.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((r["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination(spark, docs, none, monkeypatch, block):
    monkeypatch.setattr(dec, "BLOCK_WINDOWS", block)
    items = [(1, " ".join(f"W{i}" for i in range(20, 35))), (2, "Lazy DOG"), (3, None), (4, "..."), (None, "no-id"), (5, "lazy, dog!"), (10, "w30 w31 w32 w33 w34 w35 w36 w37 w38 w39")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [r.asDict() for r in docs.collect()]
    assert Counter(map(tuple, dec.contamination_report(docs, bench).collect())) == Counter(contamination(rows, items))
    kept = dec.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in contamination(rows, items) if not r[-1])
    assert dec.contamination_report(none, bench).count() == 0
    assert not any(r["contaminated"] for r in dec.contamination_report(docs, bench.limit(0)).collect())


def test_a_long_item_is_written_in_pieces(spark):
    words = [f"w{i}" for i in range(12_000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:9]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[5000:5012])), (2, " ".join(words[:9])), (3, "x " + " ".join(words[4995:5004]))], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in dec.contamination_report(docs, bench).collect()} == {1: (12, 1), 2: (9, 1), 3: (0, 0)}


def test_spans_point_into_the_original(spark):
    text = "Intro: The Quick, brown FOX! jumped... End"
    numbers = {w: i + 1 for i, w in enumerate([b"quick", b"brown", b"fox"])}
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    a.add_word((1, 2, 3), (3, ["q"]))
    a.make_automaton()
    n, hit, items = dec.scan(text, numbers, a)
    assert (n, hit, items) == (7, {2, 3, 4}, {"q"}) and [text[i:j] for i, j in dec.spans_of(text, hit)] == ["Quick, brown FOX"]


# -- the whole


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols, out = docs.columns, {}
    from hopgrid.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES:
        new = materialize(stage(spark, docs, d), "test")
        out[name] = (docs, new)
        if name != "token_ids":
            assert new.columns == cols
        docs = new
    before, after = out["benchmark_decontamination"]
    dirty = {r["doc_id"] for r in dec.contamination_report(before, spark.read.parquet(f"{d}/benchmark.parquet")).filter("contaminated").collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - dirty
    before, after = out["near_dedup"]
    rows = [r.asDict() for r in before.select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r, (_, c) in zip(rows, components_fast(rows)) if c == r["doc_id"]}
    before, after = out["token_ids"]
    assert after.count() == before.count()


def components_fast(rows):
    """As components(), with an inverted index."""
    k, percent, top, inv, sets = 5, 80, {}, {}, {}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in rows:
        w = WORD.findall(lower(r["text"] or ""))
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        i, n = r["doc_id"], Counter()
        top[i], sets[i] = i, s
        for x in s:
            n.update(inv.get(x, ()))
            inv.setdefault(x, []).append(i)
        for j, both in n.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [(len(sets[r["doc_id"]]), find(r["doc_id"])) for r in rows]


def test_stages_on_odd_tables(spark, docs, none, tmp_path):
    """Every stage on nulls, repeats, missing ids and clashing columns, and on an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from hopgrid.llm.common import materialize

    labels = [(r["doc_id"], int(r["text"] is not None and len(r["text"]) > 8), 0) for r in docs.filter("doc_id is not null").collect()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "lazy dog"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, table, str(tmp_path)), "odd")
            if name == "quality_classifier":
                scores = quality.quality_scores(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
                kept = {r["doc_id"] for r in scores.groupBy("doc_id").agg(F.min("kept").alias("k")).filter("k and doc_id is not null").collect()}
                assert {r["doc_id"] for r in out.collect()} == kept
            if name == "mixing":
                n = lambda df: df.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
                assert n(out) == (mixing.mix_report(table).agg(F.sum("taken")).first()[0] or 0)
            if name != "token_ids":
                assert out.columns == table.columns


def test_counts_of_many_keys_in_one_task():
    from hopgrid.llm.lm_score import _summed

    big = np.uint64(1 << 63)
    rows = [(np.array([i % 3, i % 5], np.uint64) + big + np.uint64(1), np.array([1, 2])) for i in range(40)]
    want = {}
    for k, n in rows:
        for x, m in zip(k.view(np.int64).tolist(), n.tolist()):
            want[x] = want.get(x, 0) + m
    for limit in (12, 30, 1000):  # sums are folded in on the way, or not
        got = {}
        for b in _summed(iter(rows), limit):
            assert b.schema.types == [pa.int64(), pa.int64()]
            for x, m in zip(*(c.to_pylist() for c in b.columns)):
                got[x] = got.get(x, 0) + m
        assert got == want
