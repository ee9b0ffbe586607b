"""The vectorised words and shingles against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("hopgrid.llm")

from hopgrid.llm.common import hashed_words, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_words_and_shingles():
    r = random.Random(1)
    texts = [None, "", "  ", "one", "One two", "a\tb\x0bc\x1cd é", "x" * (1 << 19) + " y", " ".join(f"w{i}" for i in range(60_000))]
    texts += ["".join(r.choice("aAb \n\té") for _ in range(r.randint(0, 40))) for _ in range(1000)]
    h, n, data, first, end = hashed_words(pa.array(texts), spans=True)
    words = [WORD.findall(t or "") for t in texts]
    raw = data.tobytes()
    assert n.tolist() == [len(w) for w in words] and [raw[a:b].decode() for a, b in zip(first, end)] == [x for w in words for x in w]
    known = {}
    assert all(known.setdefault(lower(x), v) == v for x, v in zip((x for w in words for x in w), h.tolist()))
    assert len(set(known.values())) == len(known)
    s, k = shingles(h, n, 4)
    want = [tuple(map(lower, w[i : i + 4])) for w in words if w for i in range(max(1, len(w) - 3))]
    assert len(want) == len(s) == k.sum()
    known = {}
    assert all(known.setdefault(x, v) == v for x, v in zip(want, s.tolist())) and len(set(known.values())) == len(known)


def test_case_and_slices():
    a = pa.array(["x", None, "The the", "THE", "tHe end"])
    assert len(set(hashed_words(a.slice(2, 2))[0].tolist())) == 1 and len(set(hashed_words(a, lower=False)[0].tolist())) == 6
    assert (hashed_words(a.slice(2))[0] == hashed_words(pa.array(["The the", "THE", "tHe end"]))[0]).all()
    assert np.array_equal(hashed_words(pa.chunked_array([a.slice(0, 2), a.slice(2)]))[0], hashed_words(a)[0])


def test_windows_that_go_on_share_keys_and_values(monkeypatch):
    """Scoring makes the vectors of each id of a text once, also of those that its next window sees; all scores stay the same."""
    from hopgrid.llm import lm_score as lm

    r = np.random.RandomState(3)
    layout = lm.Layout((r.rand(400) ** 6 * 500).round())
    p = {k: (v + r.randn(*v.shape) * 0.1).astype(np.float64) for k, v in lm.fresh(layout).items()}
    texts = [np.r_[399, r.randint(0, 399, n), 399].astype(np.int32) for n in (0, 1, 200, 15, 16, 700, 33)]
    w, _ = lm.windows(texts, layout.pad)
    made = []

    class Rows(np.ndarray):
        def __getitem__(self, at):
            made.append(np.size(at))
            return np.asarray(self)[at]

    monkeypatch.setattr(lm, "SCORE_WINDOWS", 1000)
    m = lm.Attention(layout, p | {"e": p["e"].view(Rows)})
    whole = m.log_probability(w)
    assert sum(made) == len(w) * lm.SPAN  # twice that before
    plain = lm.Attention(layout, p)
    np.testing.assert_allclose(whole, np.concatenate([plain.log_probability(w[i : i + 1]) for i in range(len(w))]), atol=1e-9)
    order = r.permutation(len(w))
    np.testing.assert_allclose(plain.log_probability(w[order]), whole[order], atol=1e-9)
    monkeypatch.setattr(lm, "SCORE_WINDOWS", 5)
    np.testing.assert_allclose(plain.log_probability(w), whole, atol=1e-9)
