"""Benchmark decontamination with one Aho-Corasick automaton over words.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z become a-z. A window is
ten consecutive words of an item; an item of fewer words (but not none) is one window.
Benchmark words get numbers, windows become number sequences in one automaton, and each text
is scanned once as the sequence of its words' numbers (0: no benchmark word). Windows are made and
dealt by their hash to blocks of about ``BLOCK_WINDOWS`` in tasks, which write each block to the shared
folder; the driver gets the files' names only. A benchmark of more than one block is scanned block
after block in the same pass over the documents, each by workers of its own, so what a worker holds
stays bounded.

Defined cases: null or empty text has no words and no hits; items without words match nothing;
repeated items (or items with equal windows) are each reported; a null item id reads as "null";
an empty benchmark leaves every document clean; extra columns of ``docs`` are kept.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, materialize, open_fs, shared_dir

WINDOW = 10
BLOCK_WINDOWS = 200_000
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])


def normal_words(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8: only ASCII bytes are mapped, so every non-ASCII character is a word character."""
    return text.encode().translate(_TABLE).split() if text else []


def _windows_of(width: int):
    """Rows (item, window: its words joined by spaces), some thousand at a time however long an item is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                w = normal_words(text)
                for i in range(0, max(1, len(w) - width + 1) if w else 0, 5000):
                    rows = [b" ".join(w[j : j + width]) for j in range(i, min(i + 5000, max(1, len(w) - width + 1)))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows)), pa.array(rows, pa.binary())], names=["item", "window"])

    return run


def write_blocks(benchmark: DataFrame, folder: str, width: int = WINDOW) -> list[str]:
    """Write the benchmark's windows in blocks of about BLOCK_WINDOWS; the files' names, one a block."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    rows = materialize(items.mapInArrow(_windows_of(width), "item string, window binary").distinct(), "benchmark-windows")
    blocks = -(-rows.count() // BLOCK_WINDOWS)
    if not blocks:
        return []

    def write(table: pa.Table) -> pa.Table:
        fs, root = open_fs(folder)
        name = f"block-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/{name}", compression=None) as f, pa.ipc.new_file(f, table.schema) as out:
            out.write_table(table)
        return pa.table({"file": [name]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    return sorted(r["file"] for r in materialize(dealt.groupBy("block").applyInArrow(write, "file string"), "benchmark-blocks").collect())


_AUTOMATA: dict[str, tuple] = {}


def _automaton(folder: str, name: str) -> tuple:
    """The worker's automaton for one block: word numbers, automaton."""
    if name not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        fs, root = open_fs(folder)
        with fs.open_input_file(f"{root}/{name}") as f:
            table = pa.ipc.open_file(f).read_all()
        numbers: dict[bytes, int] = {}
        owners: dict[tuple, list[str]] = {}
        for item, window in zip(table.column("item").to_pylist(), table.column("window").to_pylist()):
            owners.setdefault(tuple(numbers.setdefault(x, len(numbers) + 1) for x in window.split(b" ")), []).append(item)
        auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, items in owners.items():
            auto.add_word(key, (len(key), items))
        auto.make_automaton()
        _AUTOMATA[name] = numbers, auto
    return _AUTOMATA[name]


def scan(text: str | None, numbers: dict[bytes, int], auto) -> tuple[int, set[int], set[str]]:
    """Number of words, hit word positions and items with an occurring window."""
    words = normal_words(text)
    hit: set[int] = set()
    items: set[str] = set()
    if auto is not None and words:
        get = numbers.get
        for end, (n, owners) in auto.iter(tuple([get(w, 0) for w in words])):
            hit.update(range(end - n + 1, end + 1))
            items.update(owners)
    return len(words), hit, items


def spans_of(text: str, hit: set[int]) -> list[list[int]]:
    """[start, end) code points in the original text of each run of neighbouring hit words."""
    at = [m.span() for m in _WORDS.finditer(lower_ascii(text))]
    runs = [[w for _, w in g] for _, g in groupby(enumerate(sorted(hit)), lambda x: x[1] - x[0])]
    return [[at[r[0]][0], at[r[-1]][1]] for r in runs]


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, hits: str = "hits") -> DataFrame:
    """``docs`` (with a ``text`` column) plus ``hits``: n_words, hit word positions, items, spans in the original."""
    out = docs
    if hits in docs.columns:
        raise ValueError(f"documents have a column {hits!r} already; name another")
    kept = docs.schema.fields
    schema = T.StructType([*kept, T.StructField(hits, _HITS)])
    folder = shared_dir(docs.sparkSession, "benchmark")
    for k, name in enumerate(write_blocks(benchmark, folder, width) or [None]):

        def run(batches: Iterator[pa.RecordBatch], name=name, first=k == 0) -> Iterator[pa.RecordBatch]:
            numbers, auto = _automaton(folder, name) if name else ({}, None)
            for batch in batches:
                texts = batch.column("text")
                before = [None] * batch.num_rows if first else batch.column(hits).to_pylist()
                rows = []
                for value, old in zip(texts, before):
                    text = value.as_py()
                    n, hit, items = scan(text, numbers, auto)
                    if old:
                        hit |= set(old["words"])
                        items |= set(old["items"])
                    rows.append({"n_words": n, "words": sorted(hit), "items": sorted(items), "spans": spans_of(text, hit) if hit else []})
                kind = pa.struct([("n_words", pa.int64()), ("words", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64())))])
                names = [f.name for f in kept]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, kind)], names=[*names, hits])

        out = out.mapInArrow(run, schema)
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    h = find_contamination(docs.select("doc_id", "text"), benchmark)
    return h.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.size("hits.words").cast("long").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits.words") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark window, with their own columns."""
    name = "hits"
    while name in docs.columns:
        name = f"_{name}"
    return find_contamination(docs, benchmark, hits=name).filter(F.size(f"{name}.words") == 0).drop(name)
