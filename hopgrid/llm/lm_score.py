"""Scoring texts with a causal self-attention model trained here, in numpy, on subword ids.

Model. A text is START, its subword ids, END. Ids are ordered by their training count, so all ids of
the vocabulary have rows of their own and frequent ones come first. Each place has the vectors of its
id and of the id before it; masked attention of HEADS heads over the window and a feed-forward layer
give the vector that predicts the next id in two steps: its class, then the id among the class's.
Classes are runs of that order with about equal training counts (at most LARGEST ids each), so that
both steps stay short where the counts are uneven. Windows of 2 * SPAN ids overlap by SPAN: the last
SPAN ids of each are scored, so every id is scored once, with SPAN to 2 * SPAN - 1 ids before it
where the text has them.

Training. One pass over every window of every training document. Trainers take about TRAINER_IDS ids
each; a hash of doc_id and ids deals the documents to rounds (SHARES of 16). In a round every trainer
goes on from the common weights over its windows; keys and values of the SPAN ids before those scored
are constants to a window's gradient (they are scored, and learn, in the window before). Then weights and step sizes
are averaged, weighted by steps, in groups of at most FAN trainers at a time. Only blocks of rows that
a trainer has changed travel.

Base. Words and an end per text under an add-half unigram of the training documents. The most
frequent words (at most HEAD) are looked up where the text is; the rest are joined by hash.

Defined cases: null text is empty (one end, known if any training text has one); null doc_id reads as
"null" in the split; repeated rows are scored each; without training documents all ids are about
equally likely; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, materialize, open_fs, shared_dir
from .token_index import encoder

SPAN, DIM, HEADS, HIDDEN = 16, 24, 2, 48
HEAD_DIM = DIM // HEADS
WIDTH = 2 * SPAN + 2
CLASSES, LARGEST = 48, 2048
TRAINER_IDS = 8_000_000
SHARES = (1, 3, 12)
BATCH, BATCH_STEPS, LARGEST_BATCH, POOL = 64, 400, 512, 1 << 15
STEP, TABLE_STEP = 0.004, 0.08
ROW_BLOCK, FAN = 4096, 64
SCORE_WINDOWS, CLASS_WINDOWS = 128, 4096  # that attention and the classes' ids take at a time in scoring
HEAD = 500_000
END_WORD = 0x656E64

# --------------------------------------------------------------------------- texts


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def windows(seqs: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the sequences (START, ids, END) and each window's row.

    A window is WIDTH long: the id before, 2 * SPAN inputs, and the last target. The targets are its
    last SPAN ids; places before the text and after it are ``pad``.
    """
    lens = np.array([len(s) for s in seqs], np.int64)
    per = -(-(lens - 1) // SPAN)
    sizes = per * SPAN + SPAN + 2
    base = np.cumsum(sizes) - sizes
    flat = np.full(int(sizes.sum()), pad, np.int32)
    at = np.repeat(base + SPAN + 1 - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
    flat[at] = np.concatenate(seqs)
    row = np.repeat(np.arange(len(seqs)), per)
    first = base[row] + SPAN * (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per))
    return flat[first[:, None] + np.arange(WIDTH)], row


# --------------------------------------------------------------------------- model


class Layout:
    """The order of symbols (ids, and the end after them) by training count, and the classes' cuts."""

    def __init__(self, counts: np.ndarray):
        n = counts.astype(np.float64) + 0.5
        order = np.lexsort((np.arange(len(n)), -n))
        self.rank = np.empty(len(n), np.int32)
        self.rank[order] = np.arange(len(n))
        self.n = n = n[order]
        part = np.minimum((np.cumsum(n) - n / 2) / n.sum() * CLASSES, CLASSES - 1).astype(int)
        cuts = [0]
        for hi in np.flatnonzero(np.r_[np.diff(part) > 0, True]) + 1:
            cuts += [*range(cuts[-1] + LARGEST, hi, LARGEST), hi]
        self.cuts = np.array(cuts)
        self.class_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)).astype(np.int16)
        self.pad = len(n)


def fresh(layout: Layout, seed: int = 5) -> dict[str, np.ndarray]:
    """First weights: the model starts near the unigram of the training counts."""
    r = np.random.RandomState(seed)
    n = lambda *s, k=0.2: (r.randn(*s) * k).astype(np.float32)
    z = lambda *s: np.zeros(s, np.float32)
    size, per = layout.pad, np.add.reduceat(layout.n, layout.cuts[:-1])
    return {
        "e": n(size + 1, DIM, k=0.3), "p": n(size + 1, DIM, k=0.1), "u": n(size, DIM, k=0.05), "b": (np.log(layout.n) - np.log(per)[layout.class_of]).astype(np.float32),
        "q": n(DIM, DIM), "kv": n(DIM, 2 * DIM), "r": z(HEADS, 2 * SPAN), "o": n(DIM, DIM, k=0.1), "w1": n(DIM, HIDDEN), "b1": z(HIDDEN), "w2": n(HIDDEN, DIM, k=0.1),
        "uc": n(DIM, len(per), k=0.05), "bc": np.log(per / per.sum()).astype(np.float32),
    }


TABLES = ("e", "p", "u", "b")  # a row a symbol
_KEY, _QUERY = np.arange(2 * SPAN), SPAN + np.arange(SPAN)
_FUTURE = _KEY[None, :] > _QUERY[:, None]
_BACK = np.clip(_QUERY[:, None] - _KEY[None, :], 0, 2 * SPAN - 1)
_NEVER = np.float32(-1e9)
_SCALE = np.float32(HEAD_DIM**-0.5)


def _last_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last, short axis; a product with ones is faster than ``sum`` there."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(x.shape[:-1])


def _column_sums(x: np.ndarray) -> np.ndarray:
    return np.ones(len(x), x.dtype) @ x


def _shares(x: np.ndarray) -> np.ndarray:
    np.exp(x, out=x)
    x *= (1 / _last_sums(x))[..., None]
    return x


def _row_sums(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their rows."""
    order = np.argsort(index)
    keys = index[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(rows[order], first, 0)


class Attention:
    """The model: a layout and weights ``p``."""

    def __init__(self, layout: Layout, p: dict[str, np.ndarray]):
        self.cuts, self.class_of, self.pad, self.p = layout.cuts, layout.class_of, layout.pad, p

    def hidden(self, w: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(w)
        ids, before = w[:, 1:-1], w[:, :-2]
        x = p["e"][ids]
        x += p["p"][before]
        now = x[:, SPAN:].reshape(-1, DIM)
        kv = (x.reshape(-1, DIM) @ p["kv"]).reshape(n, 2 * SPAN, 2, HEADS, HEAD_DIM)
        q = np.ascontiguousarray((now @ (p["q"] * _SCALE)).reshape(n, SPAN, HEADS, HEAD_DIM).transpose(0, 2, 1, 3))
        k = np.ascontiguousarray(kv[:, :, 0].transpose(0, 2, 3, 1))
        v = np.ascontiguousarray(kv[:, :, 1].transpose(0, 2, 1, 3))
        a = q @ k
        a += np.where(_FUTURE, _NEVER, p["r"][:, _BACK])
        a[ids[:, SPAN - 1] == self.pad, :, :, :SPAN] = _NEVER  # a text's first window
        a = _shares(a)
        o = (a @ v).transpose(0, 2, 1, 3).reshape(-1, DIM)
        h = now + o @ p["o"]
        f = h @ p["w1"]
        f += p["b1"]
        np.maximum(f, 0, out=f)
        return {"ids": ids, "before": before, "x": x, "now": now, "q": q, "k": k, "v": v, "a": a, "o": o, "h": h, "f": f, "z": h + f @ p["w2"]}

    def _by_class(self, w: np.ndarray, z: np.ndarray) -> tuple:
        """Counted places, and their vectors, targets and classes, in order of class; each class's run."""
        y = w[:, SPAN + 2 :].ravel()
        at = np.flatnonzero(y != self.pad)
        c = self.class_of[y[at]]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        ends = np.searchsorted(c, np.arange(len(self.cuts)))
        runs = [(i, j, lo, hi) for i, j, lo, hi in zip(ends, ends[1:], self.cuts, self.cuts[1:]) if i < j and hi - lo > 1]
        return at, z[at], y[at], c, runs

    def _outcome(self, w: np.ndarray) -> np.ndarray:
        """The vectors z of ``hidden``. A window that goes on where the one before it ends takes over that one's keys and values."""
        p, n = self.p, len(w)
        x = p["e"][w[:, SPAN + 1 : -1]]
        x += p["p"][w[:, SPAN:-2]]
        now = x.reshape(-1, DIM)
        kv = (now @ p["kv"]).reshape(n, SPAN, 2, HEADS, HEAD_DIM)
        q = (now @ (p["q"] * _SCALE)).reshape(n, SPAN, HEADS, HEAD_DIM).transpose(0, 2, 1, 3)
        k, v = np.empty((n, HEADS, HEAD_DIM, 2 * SPAN), kv.dtype), np.empty((n, HEADS, 2 * SPAN, HEAD_DIM), kv.dtype)
        k[..., SPAN:], v[:, :, SPAN:] = kv[:, :, 0].transpose(0, 2, 3, 1), kv[:, :, 1].transpose(0, 2, 1, 3)
        k[1:, ..., :SPAN], v[1:, :, :SPAN] = k[:-1, ..., SPAN:], v[:-1, :, SPAN:]
        begins = w[:, SPAN] == self.pad  # a text's first window has no keys before
        k[begins, ..., :SPAN], v[begins, :, :SPAN] = 0, 0
        alone = np.flatnonzero(np.r_[True, (w[1:, : SPAN + 2] != w[:-1, SPAN:]).any(1)] & ~begins)
        kv = ((p["e"][w[alone, 1 : SPAN + 1]] + p["p"][w[alone, :SPAN]]).reshape(-1, DIM) @ p["kv"]).reshape(len(alone), SPAN, 2, HEADS, HEAD_DIM)
        k[alone, ..., :SPAN], v[alone, :, :SPAN] = kv[:, :, 0].transpose(0, 2, 3, 1), kv[:, :, 1].transpose(0, 2, 1, 3)
        a = np.ascontiguousarray(q) @ k
        a += np.where(_FUTURE, _NEVER, p["r"][:, _BACK])
        a[begins, :, :, :SPAN] = _NEVER
        np.exp(a, out=a)
        o = a @ v
        o *= (1 / _last_sums(a))[..., None]
        now += o.transpose(0, 2, 1, 3).reshape(-1, DIM) @ p["o"]
        f = now @ p["w1"]
        f += p["b1"]
        np.maximum(f, 0, out=f)
        now += f @ p["w2"]
        return now

    def log_probability(self, w: np.ndarray) -> np.ndarray:
        """Natural log probability of each target (n, SPAN), 0 where there is none."""
        y = w[:, SPAN + 2 :].ravel()
        c = self.class_of[np.minimum(y, self.pad - 1)]
        z, all_ = np.empty((len(y), DIM), self.p["uc"].dtype), np.empty(len(y))
        for i in range(0, len(w), SCORE_WINDOWS):
            here = slice(i * SPAN, (i + SCORE_WINDOWS) * SPAN)
            z[here] = some = self._outcome(w[i : i + SCORE_WINDOWS])
            t = some @ self.p["uc"]
            t += self.p["bc"]
            all_[here] = t[np.arange(len(t)), c[here]]
            all_[here] -= np.log(_last_sums(np.exp(t, out=t)))
        at, z, y, _, runs = self._by_class(w, z)
        found = all_[at]
        for i, j, lo, hi in runs:
            t = z[i:j] @ self.p["u"][lo:hi].T
            t += self.p["b"][lo:hi]
            found[i:j] += t[np.arange(j - i), y[i:j] - lo]
            found[i:j] -= np.log(_last_sums(np.exp(t, out=t)))
        out = np.zeros(len(w) * SPAN)
        out[at] = found
        return out.reshape(len(w), SPAN)

    def gradients(self, w: np.ndarray) -> tuple[dict[str, np.ndarray], list[tuple]]:
        """Gradients of the mean negative log probability: of the small weights, and (table, rows, gradient) of the tables."""
        p, s = self.p, self.hidden(w)
        at, z, y, c, runs = self._by_class(w, s["z"])
        n, g, rows = np.float32(1 / max(1, len(at))), {}, []
        d = z @ p["uc"]
        d += p["bc"]
        d = _shares(d)
        d[np.arange(len(at)), c] -= 1
        d *= n
        g["uc"], g["bc"] = z.T @ d, _column_sums(d)
        dz = d @ p["uc"].T
        for i, j, lo, hi in runs:
            u = p["u"][lo:hi]
            d = z[i:j] @ u.T
            d += p["b"][lo:hi]
            d = _shares(d)
            d[np.arange(j - i), y[i:j] - lo] -= 1
            d *= n
            rows += [("u", slice(lo, hi), d.T @ z[i:j]), ("b", slice(lo, hi), _column_sums(d))]
            dz[i:j] += d @ u
        full = np.zeros((len(w) * SPAN, DIM), z.dtype)
        full[at] = dz
        g["w2"] = s["f"].T @ full
        df = full @ p["w2"].T
        df *= s["f"] > 0
        g["w1"], g["b1"] = s["h"].T @ df, _column_sums(df)
        dh = full + df @ p["w1"].T
        g["o"] = s["o"].T @ dh
        do = np.ascontiguousarray((dh @ p["o"].T).reshape(len(w), SPAN, HEADS, HEAD_DIM).transpose(0, 2, 1, 3))
        a = s["a"]
        own = a[..., SPAN:].transpose(0, 1, 3, 2)
        da = do @ s["v"].transpose(0, 1, 3, 2)
        da -= _last_sums(do * s["o"].reshape(len(w), SPAN, HEADS, HEAD_DIM).transpose(0, 2, 1, 3))[..., None]  # the sums of da * a
        da *= a
        per = da.sum(0)
        g["r"] = np.stack([np.bincount(_BACK[~_FUTURE], x[~_FUTURE], 2 * SPAN) for x in per]).astype(np.float32)
        dq = (da @ s["k"].transpose(0, 1, 3, 2)).transpose(0, 2, 1, 3).reshape(-1, DIM) * _SCALE
        dkv = np.empty((len(w), SPAN, 2, HEADS, HEAD_DIM), full.dtype)
        dkv[:, :, 0] = (da[..., SPAN:].transpose(0, 1, 3, 2) @ s["q"]).transpose(0, 2, 1, 3)
        dkv[:, :, 1] = (own @ do).transpose(0, 2, 1, 3)
        dkv = dkv.reshape(-1, 2 * DIM)
        g["kv"], g["q"] = s["now"].T @ dkv, s["now"].T @ dq
        dx = dh + dq @ p["q"].T + dkv @ p["kv"].T
        rows += [("e", *_row_sums(s["ids"][:, SPAN:].ravel(), dx)), ("p", *_row_sums(s["before"][:, SPAN:].ravel(), dx))]
        return g, rows


class Steps:
    """Adam for the small weights, Adagrad for the rows of tables that a batch touches; ``v`` holds the squares."""

    def __init__(self, p: dict[str, np.ndarray], v: dict[str, np.ndarray] | None = None):
        self.p, self.t = p, 0
        self.m = {k: np.zeros_like(x) for k, x in p.items() if k not in TABLES}
        self.v = v or {k: np.zeros_like(x) for k, x in p.items()}
        self.warm = v is not None

    def take(self, g: dict[str, np.ndarray], rows: list[tuple], rate: float) -> None:
        self.t += 1
        r = np.float32(rate * STEP / (1 - 0.9**self.t) * (1.0 if self.warm else (1 - 0.98**self.t) ** 0.5))
        for k, d in g.items():
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (d - m)
            v += np.float32(0.02) * (d * d - v)
            self.p[k] -= r * m / (np.sqrt(v) + np.float32(1e-6))
        r = np.float32(rate * TABLE_STEP)
        for k, at, d in rows:
            v = self.v[k][at] + d * d
            self.v[k][at] = v
            self.p[k][at] -= r * d / (np.sqrt(v) + np.float32(1e-8))


class Trainer:
    """Takes windows, mixes them in a pool and steps; batches grow with the steps taken."""

    def __init__(self, layout: Layout, p: dict, v: dict | None, done: int, expected: int):
        self.model, self.steps = Attention(layout, p), Steps(p, v)
        self.done, self.expected, self.seen, self.n = done, max(1, expected), 0, 0
        self.pool, self.waiting = [], 0

    def add(self, w: np.ndarray) -> None:
        self.pool.append(w)
        self.waiting += len(w)
        if self.waiting >= POOL:
            self.learn()

    def learn(self) -> None:
        """Step over all windows that wait."""
        if not self.waiting:
            return
        w = np.concatenate(self.pool)
        w, at = w[np.random.RandomState(self.n).permutation(len(w))], 0
        while at < len(w):
            size = min(LARGEST_BATCH, BATCH << min(8, (self.done + self.n) // BATCH_STEPS))
            rate = min(1.0, (self.done + self.n + 1) / 20) * max(0.1, 1 - 0.9 * (self.seen + at) / self.expected)
            self.steps.take(*self.model.gradients(w[at : at + size]), rate)
            at, self.n = at + size, self.n + 1
        self.seen += len(w)
        self.pool, self.waiting = [], 0


# --------------------------------------------------------------------------- passes

_LOADED: dict[str, dict[str, np.ndarray]] = {}


def _save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays of fixed size to the shared folder; returns the file's name."""
    fs, root = open_fs(folder)
    name, data = f"arrays-{uuid.uuid4().hex}", io.BytesIO()
    np.savez(data, **arrays)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(data.getvalue())
    return name


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    if name not in _LOADED:
        if len(_LOADED) > 3:
            _LOADED.pop(next(iter(_LOADED)))
        fs, root = open_fs(folder)
        with fs.open_input_file(f"{root}/{name}") as f:
            with np.load(io.BytesIO(f.read())) as x:
                _LOADED[name] = {k: x[k] for k in x.files}
    return _LOADED[name]


def _summed(rows: Iterator[tuple[np.ndarray, np.ndarray]], limit: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """(k, n) batches of summed counts; sums are handed on whenever they get large."""
    keys, counts, held = [], [], 0

    def flush() -> pa.RecordBatch:
        k, which = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(which, np.concatenate(counts)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64) if k.dtype == np.uint64 else k), pa.array(n)], names=["k", "n"])

    for k, n in rows:
        keys.append(k)
        counts.append(n)
        held += len(k)
        if held > limit:
            b = flush()
            keys, counts, held = [b.column(0).to_numpy().view(k.dtype)], [b.column(1).to_numpy()], 0
            if b.num_rows > limit // 2:
                yield b
                keys, counts = [], []
            else:
                held = b.num_rows
    if keys:
        yield flush()


def _unigrams(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                n = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), f"<u{width}"))
                yield np.r_[np.flatnonzero(n), -1], np.r_[n[n > 0], b.num_rows]  # -1: ends

        yield from _summed(rows())

    return run


def _sequences(blobs: list[bytes], rank: np.ndarray, width: int) -> list[np.ndarray]:
    end = rank[-1:]
    return [np.concatenate([end, rank[np.frombuffer(x, f"<u{width}")], end]) for x in blobs]


def round_of() -> Column:
    """The round that trains on a document (doc_id, ids)."""
    ticket, cuts = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(sum(SHARES))), np.cumsum(SHARES).tolist()
    return sum((ticket >= c).cast("int") for c in cuts[:-1])


_WEIGHTS = "trainer int, name string, block int, steps double, w binary"


def _train(folder: str, layout_name: str, weights_name: str, width: int, done: int, expected: int):
    """Train on all windows of this task's texts; gives the blocks of weights and squares that changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(_load(folder, layout_name)["counts"])
        start = _load(folder, weights_name)
        copy = {k: x.copy() for k, x in start.items()}
        p, v = {k: x for k, x in copy.items() if not k.startswith("v.")}, {k[2:]: x for k, x in copy.items() if k.startswith("v.")}
        t = Trainer(layout, p, v or None, done, expected)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                w, _ = windows(_sequences(b.column("ids").to_pylist(), layout.rank, width), layout.pad)
                t.add(w)
        t.learn()
        if t.n:
            trainer = TaskContext.get().partitionId()
            for name, x in [*t.steps.p.items(), *((f"v.{k}", x) for k, x in t.steps.v.items())]:
                for block in range(0, len(x), ROW_BLOCK):
                    new = x[block : block + ROW_BLOCK]
                    if name not in start or not np.array_equal(new, start[name][block : block + ROW_BLOCK]):
                        yield pa.RecordBatch.from_arrays([pa.array([trainer], pa.int32()), pa.array([name]), pa.array([block], pa.int32()), pa.array([float(t.n)]), pa.array([new.tobytes()], pa.binary())], names=["trainer", "name", "block", "steps", "w"])

    return run


def _average(table: pa.Table) -> pa.Table:
    """Mean of one block over at most FAN trainers or groups of them, weighted by steps."""
    total, sum_ = 0.0, 0.0
    for w, n in zip(table.column("w"), table.column("steps").to_pylist()):
        total, sum_ = total + n, sum_ + np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * n
    return table.slice(0, 1).set_column(3, "steps", pa.array([total])).set_column(4, "w", pa.array([(sum_ / total).astype(np.float32).tobytes()], pa.binary()))


def averaged(blocks: DataFrame, trainers: int) -> DataFrame:
    """One row for each (name, block). Groups hold at most FAN rows, however many trainers there are."""
    blocks = materialize(blocks, "lm-trained")
    while True:
        groups = -(-trainers // FAN)
        blocks = blocks.withColumn("trainer", F.expr(f"trainer div {FAN}").cast("int")).select("trainer", "name", "block", "steps", "w")
        blocks = materialize(blocks.groupBy("trainer", "name", "block").applyInArrow(_average, _WEIGHTS), "lm-averaged")
        if groups <= 1:
            return blocks
        trainers = groups


def _score(folder: str, layout_name: str, weights_name: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(_load(folder, layout_name)["counts"])
        model = Attention(layout, _load(folder, weights_name))
        for whole in batches:
            for start in range(0, whole.num_rows, 250):
                b = whole.slice(start, 250)
                w, row = windows(_sequences(b.column("ids").to_pylist(), layout.rank, width), layout.pad)
                score = np.zeros(b.num_rows)
                for i in range(0, len(w), CLASS_WINDOWS):
                    score += np.bincount(row[i : i + CLASS_WINDOWS], model.log_probability(w[i : i + CLASS_WINDOWS]).sum(1), b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(score / np.log(10.0))], names=["rid", "score"])

    return run


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, and their number in each text."""
    h, n = hashed_words(column)
    return np.insert(h, np.cumsum(n), END_WORD), n + 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                train = pa.array([not held_out(i) for i in b.column("doc_id").to_pylist()], pa.bool_())
                h, _ = _words(b.column("text").filter(train))
                if len(h):
                    yield np.unique(h, return_counts=True)

    yield from _summed(rows())


_CODED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, total double, tail array<long>, ids binary"


def _encode(path: str, folder: str, head_name: str):
    """Per text: a row number, n_tokens, the head words' part, the hashes of the other words, and the subword ids.

    Row numbers hold for the written result of this pass only, so they survive lost executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, head = encoder(path), _load(folder, head_name)
        k, v, n = head["k"], head["v"], 0
        part = TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                words, lens = _words(b.column("text"))
                row = np.repeat(np.arange(len(lens)), lens)
                place = np.minimum(np.searchsorted(k, words), max(len(k) - 1, 0))
                hit = k[place] == words if len(k) else np.zeros(len(words), bool)
                known = np.bincount(row, hit, len(lens)).astype(np.int64)
                total = np.bincount(row[hit], v[place[hit]], len(lens)) if len(k) else np.zeros(len(lens))
                offsets = np.concatenate([[0], np.cumsum(lens - known)])
                tail = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words[~hit].view(np.int64)))
                rid = pa.array((part << 36) + n + np.arange(len(lens)))
                n += len(lens)
                yield pa.RecordBatch.from_arrays([rid, b.column("doc_id"), pa.array([held_out(i) for i in b.column("doc_id").to_pylist()]), pa.array(lens), pa.array(known), pa.array(total), tail, pa.array(enc.encode_all(b.column("text").to_pylist()), pa.binary())], names=[c.split()[0] for c in _CODED.split(", ")])

    return run


# --------------------------------------------------------------------------- whole


def encoded(texts: DataFrame, folder: str, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """Written rows of all texts (ids, parts of the base score) and their base scores:
    rid, doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    counts = materialize(texts.mapInArrow(_count_words, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "lm-words")
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    below = np.log10(tokens + 0.5 * (kinds + 1))
    # The head: words of a count that HEAD words at most reach.
    reach, least = 0, 1
    for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("c")).count().orderBy(F.desc("c")).collect():  # 10 000 rows at most
        reach += r["count"]
        if reach > HEAD:
            least = r["c"] + 1
            break

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("k").to_numpy(), b.column("n").to_numpy()) for b in batches] or [(np.empty(0, np.int64),) * 2]
        k, n = (np.concatenate(c) for c in zip(*parts))
        k = k.view(np.uint64)
        order = np.argsort(k)
        yield pa.RecordBatch.from_arrays([pa.array([_save(folder, {"k": k[order], "v": np.log10(n[order] + 0.5) - below})])], names=["file"])

    # Only the head's rows, HEAD at most, go to one task.
    head = counts.filter(F.col("n") >= least).repartition(1).mapInArrow(write, "file string").first()["file"]
    per = materialize(texts.mapInArrow(_encode(tokenizer_path, folder, head), _CODED), "lm-texts")
    tail = per.select("rid", F.explode("tail").alias("k")).groupBy("rid", "k").agg(F.count("*").alias("m"))
    joined = tail.join(counts, "k", "left").groupBy("rid").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("more"), F.sum(F.col("m") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - F.lit(float(below)))).alias("rest"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return per, per.join(joined, "rid", "left").select("rid", "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more")).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("total") + zero("rest")).alias("base_score"))


def train(coded: DataFrame, folder: str, width: int, vocabulary: int) -> tuple[str, str]:
    """Names of the saved counts and weights; what the driver holds is bounded by the vocabulary."""
    texts = coded.filter(~F.col("held_out"))
    uni = texts.mapInArrow(_unigrams(width), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # vocabulary rows
    counts = np.zeros(vocabulary + 1)
    counts[uni["k"]] = uni["n"]  # -1, the ends, comes last
    layout_name, layout = _save(folder, {"counts": counts}), Layout(counts)
    weights = fresh(layout)
    if not counts.sum():
        return layout_name, _save(folder, weights)
    # No more trainers than the written table has partitions; several of those make one trainer without a shuffle.
    parts = texts.rdd.getNumPartitions()
    trainers = max(1, min(parts, round(float(counts.sum()) / TRAINER_IDS)))
    done = 0
    for turn, share in enumerate(SHARES):
        expected = int(counts.sum() / SPAN / trainers * share / sum(SHARES))
        job = _train(folder, layout_name, _save(folder, weights), width, done, expected)
        got, steps = {}, 0
        for r in averaged(texts.filter(round_of() == turn).coalesce(trainers).mapInArrow(job, _WEIGHTS), trainers).collect():  # the tables' blocks, once
            got.setdefault(r["name"], {})[r["block"]] = np.frombuffer(r["w"], np.float32)
            steps = max(steps, int(r["steps"] / trainers))
        for name, blocks in got.items():
            like = weights[name.removeprefix("v.")]
            new = weights[name].copy() if name in weights else np.zeros_like(like)
            for block, x in blocks.items():
                new[block : block + ROW_BLOCK] = x.reshape(-1, *like.shape[1:])
            weights[name] = new
        for name in [k for k in weights if not k.startswith("v.")]:
            weights.setdefault(f"v.{name}", np.zeros_like(weights[name]))
        done += steps
    return layout_name, _save(folder, {k: x for k, x in weights.items() if not k.startswith("v.")})


def lm_scores(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    width = 2 if vocabulary <= 1 << 16 else 4
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = shared_dir(docs.sparkSession, "lm")
    coded, base = encoded(texts, folder, tokenizer_path)
    names = train(coded.select("doc_id", "held_out", "ids"), folder, width, vocabulary)
    scored = coded.select("rid", "ids").mapInArrow(_score(folder, *names, width), "rid long, score double")
    return base.join(scored, "rid").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
