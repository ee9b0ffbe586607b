"""Token-id shards with a minimal-perfect-hash index over document keys.

Layout of an output folder::

    ids-<partition>-<attempt>-<k>.bin   raw little-endian ids (uint16 when the vocabulary fits, else uint32)
    ids-<partition>-<attempt>-<k>.len   uint32 token counts, one per record in file order
    manifest (Parquet)                  one row per record: key, file, row, byte offset, counts
    index (Parquet)                     one row per index bucket: a minimal perfect hash (bit levels with
                                        ranks), stored fingerprints and the location of every key

Rows are written in ascending ``doc_id`` order (nulls first; equal ids by a hash of the text).
Files are named by task attempt and only the manifest of successful tasks points
at them, so a lost executor leaves orphans but never a wrong byte.
Defined cases: null or empty text encodes to the end id alone; repeated keys are
stored in runs of consecutive records, one for each writer task that has some, each with an index entry; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, open_fs, shared_dir

SHARD_BYTES = 256 << 20
BUCKET_KEYS = 4096
MEMO_WORDS = 250_000
END_ID = 1

# --------------------------------------------------------------------------- encoding

_MEMO: dict[str, "MemoEncoder"] = {}
#: Signs that end a piece and stand after a letter or digit.
_SIGNS = r"[!-/:-@\[-`{-~]"
_STOP = re.compile(rf"{_SIGNS}(?<=[^\W_].){_SIGNS}*(?= |\Z)")


class MemoEncoder:
    """The library's ids of whole texts, with a bounded memo of space-separated pieces.

    The tokenizer's normaliser and pre-tokenizer never join anything over white space, so a text's
    ids are those of its pieces. Where it changes nothing, a text is lower-cased first (the
    tokenizer does so itself) and final signs are set apart from the letter or digit before them,
    which gives far fewer different pieces; other texts are split as they stand. All ids come from
    the library: unknown words of letters go to it as one text, of which each word's ids end with a
    word-end piece, other unknown pieces as one text with a special token between them. Frequent pieces outlive a full memo.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(self.tok.get_vocab_size())])
        between = [(i, x.content) for i, x in self.tok.get_added_tokens_decoder().items() if x.special and not (x.normalized or x.lstrip or x.rstrip or x.single_word) and x.content.startswith("<|")]
        self.between = between[-1] if between else None
        self.memo, self.old = {"": b""}, {}

    @staticmethod
    def spaced(text: str) -> str:
        """``text`` with the same ids, split at spaces into few different pieces where that is safe."""
        if not text.isascii():
            low = text.lower()
            same = len(low) == len(text) and "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
            if not same:
                return text
        elif "<|" not in text:
            low = text.lower()
        if "<|" in text:  # special tokens are told by their case
            return text
        return _STOP.sub(r" \g<0>", low.replace("\n", " "))

    def _ids(self, text: str) -> np.ndarray:
        """The library's ids of one text; the call that leaves out places in the text."""
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, missing: set[str]) -> None:
        """Put the pieces' ids into the memo."""
        memo, old = self.memo, self.old
        words, others = [], []
        for piece in missing:
            if (got := old.get(piece)) is not None:
                memo[piece] = got
            elif piece.isalpha() and piece.islower() and len(piece.lower()) == len(piece):
                words.append(piece)
            else:
                others.append(piece)
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = self._ids(" ".join(some))
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(some):
                others += some
                continue
            raw, at = ids.tobytes(), (at * self.width).tolist()
            memo.update(zip(some, [raw[x:y] for x, y in zip([0, *at], at)]))
        together = [x for x in others if "<|" not in x] if self.between else []
        for i in range(0, len(together), 500):
            some = together[i : i + 500]
            number, sign = self.between
            ids = self._ids(sign.join(some))
            at = np.flatnonzero(ids == number)
            raw, first, end = ids.tobytes(), np.r_[0, at + 1] * self.width, np.r_[at, len(ids)] * self.width
            if len(first) == len(some):
                memo.update(zip(some, [raw[x:y] for x, y in zip(first.tolist(), end.tolist())]))
        for piece in others:
            if piece not in memo:
                memo[piece] = self._ids(piece).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Raw ids of each text; null gives none."""
        out: list = [None] * len(texts)
        for start in range(0, len(texts), 256):
            if len(self.memo) > MEMO_WORDS:
                self.old, self.memo = self.memo, {"": b""}
            split = [self.spaced(t).split(" ") if t else [] for t in texts[start : start + 256]]
            missing = set().union(*split).difference(self.memo)
            if missing:
                self._learn(missing)
            get = self.memo.__getitem__
            out[start : start + 256] = [b"".join(map(get, x)) for x in split]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str) -> MemoEncoder:
    """The worker's encoder; it stays between tasks of a reused Python worker."""
    if path not in _MEMO:
        _MEMO[path] = MemoEncoder(path)
    return _MEMO[path]


# --------------------------------------------------------------------------- minimal perfect hash


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Keys (distinct 64-bit hashes) to 0..n-1: at each level keys alone in their cell are placed, the others
    go to the next, smaller level; a slot is the rank of its cell's bit over all levels."""

    GAMMA = 2.0

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.first = np.cumsum([0, *(int(b.sum()) for b in bits)])
        self.ranks = [np.cumsum(b, dtype=np.int64) - b for b in bits]

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        bits, rest, level = [], keys, 0
        while len(rest):
            size = max(1, int(cls.GAMMA * len(rest)))
            cell = (_mix(rest, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            bits.append(alone.astype(np.uint8))
            rest, level = rest[~alone[cell]], level + 1
            if level > 200:
                raise ValueError("keys are not distinct")
        return cls(bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level holds it (then it is no key)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            if not len(open_):
                break
            cell = (_mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[cell] == 1
            out[open_[hit]] = self.first[level] + self.ranks[level][cell[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.bits], b"".join(np.packbits(b).tobytes() for b in self.bits)

    @classmethod
    def load(cls, sizes: list[int], blob: bytes) -> "PerfectHash":
        bits, at = [], 0
        for n in sizes:
            k = (n + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(blob, np.uint8, k, at), count=n))
            at += k
        return cls(bits)


# --------------------------------------------------------------------------- writing

_MANIFEST = "doc_id long, part int, file string, row long, at long, n_tokens long, before long"


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ids of ``docs`` (doc_id, text) in ascending doc_id order; returns the manifest, already written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        fs, root = open_fs(folder)
        attempt, k, out, name, lens, row, at, before, last = uuid.uuid4().hex, 0, None, "", [], 0, 0, 0, object()

        def close() -> None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.len") as f:
                f.write(np.array(lens, "<u4").tobytes())

        for batch in batches:
            ids, rows = batch.column(0), []
            keys = ids.to_pylist()
            for key, own in zip(keys, enc.encode_all(batch.column(1).to_pylist())):
                if out is None or (at >= shard_bytes and key != last):
                    if out is not None:
                        close()
                    name, k, lens, row, at = f"ids-{part:06d}-{attempt}-{k}", k + 1, [], 0, 0
                    out = fs.open_output_stream(f"{root}/{name}.bin")
                payload = own + end
                out.write(payload)
                n = len(payload) // enc.width
                rows.append((part, name, row, at, n, before))
                lens.append(n)
                row, at, before, last = row + 1, at + len(payload), before + n, key
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())))],
                names=["doc_id", "part", "file", "row", "at", "n_tokens", "before"],
            )
        if out is not None:
            close()

    # Ranged by the text's hash too, so that rows of one doc_id are split like any others.
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return materialize(ordered.mapInArrow(run, _MANIFEST), "manifest")


def build_index(manifest: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """Index rows, one per bucket of about ``bucket_keys`` keys and written to the shared folder, and the number of buckets."""
    # A run: rows of one key that follow one another in a file. Keys have as many runs as writer tasks hold their rows, mostly one.
    runs = manifest.groupBy("doc_id", "part", "file").agg(F.min(F.struct("row", "at", "n_tokens", "before")).alias("first"), F.count("*").alias("n_rows")).select("doc_id", "part", "file", "first.*", "n_rows")
    own = Window.partitionBy("doc_id")
    runs = runs.withColumns({"run": (F.row_number().over(own.orderBy("part", "file")) - 1).cast("long"), "n_runs": F.count("*").over(own)})
    keys = materialize(runs.select(*_hashes(), "part", "file", "row", "at", "n_tokens", "before", "n_rows", "n_runs"), "index-keys")
    buckets = max(1, -(-keys.count() // bucket_keys))

    def build(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in table.column_names if c != "file"}
        h = col["h"].view(np.uint64)
        mph = PerfectHash.build(h)
        order = np.argsort(mph.slots(h))
        sizes, blob = mph.dump()
        files, which = np.unique(np.array(table.column("file").to_pylist()), return_inverse=True)
        pack = lambda a, t: a[order].astype(t).tobytes()
        return pa.Table.from_pylist(
            [{"bucket": int(col["bucket"][0]), "levels": sizes, "bits": blob, "fingerprints": (col["g"].view(np.uint64)[order] >> np.uint64(32)).astype("<u4").tobytes(), "files": files.tolist(), "file_no": pack(which, "<u4"), "places": np.stack([col[c][order] for c in _PLACES]).astype("<i8").tobytes()}],
            schema=_INDEX_ARROW,
        )

    return materialize(keys.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(build, _INDEX), "index"), buckets


_PLACES = ("part", "row", "at", "n_tokens", "before", "n_rows", "n_runs")


def _hashes() -> tuple[Column, Column]:
    """Key hash and fingerprint of a run (doc_id, run)."""
    return F.xxhash64("doc_id", "run").alias("h"), F.xxhash64(F.lit("fingerprint"), "doc_id", "run").alias("g")


_INDEX = "bucket int, levels array<int>, bits binary, fingerprints binary, files array<string>, file_no binary, places binary"
_INDEX_ARROW = pa.schema([("bucket", pa.int32()), ("levels", pa.list_(pa.int32())), ("bits", pa.binary()), ("fingerprints", pa.binary()), ("files", pa.list_(pa.string())), ("file_no", pa.binary()), ("places", pa.binary())])
_FOUND = "doc_id long, part int, file string, row long, at long, n_tokens long, before long, n_rows long, n_runs long"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("file", pa.string()), ("row", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("n_rows", pa.int64()), ("n_runs", pa.int64())])


def lookup(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Locations of ``keys`` (doc_id, distinct), one for each run; a key that was never stored gives no row."""
    first = materialize(_probed(keys.select("doc_id", F.lit(0).cast("long").alias("run")), index, buckets), "token-first-runs")
    more = first.filter("n_runs > 1").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_runs") - 1)).alias("run"))
    return first if more.isEmpty() else first.unionByName(_probed(more, index, buckets))


def _probed(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    probe = keys.select("doc_id", *_hashes()).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND_ARROW.empty_table()
        row = right.to_pylist()[0]
        mph = PerfectHash.load(row["levels"], row["bits"])
        h, g = (left.column(c).to_numpy().view(np.uint64) for c in ("h", "g"))
        slot = mph.slots(h)
        known = slot >= 0
        known[known] = np.frombuffer(row["fingerprints"], "<u4")[slot[known]] == (g[known] >> np.uint64(32)).astype(np.uint32)
        slot = slot[known]
        places = np.frombuffer(row["places"], "<i8").reshape(len(_PLACES), -1)[:, slot]
        names = np.array(row["files"])[np.frombuffer(row["file_no"], "<u4")[slot]] if len(slot) else []
        return pa.Table.from_arrays(
            [left.column("doc_id").combine_chunks().filter(pa.array(known)), pa.array(places[0].astype(np.int32)), pa.array(names, pa.string()), *(pa.array(x) for x in places[1:])],
            schema=_FOUND_ARROW,
        )

    return probe.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, _FOUND)


def read_documents(found: DataFrame, folder: str, width: int) -> DataFrame:
    """Read the located records: one row per stored record, with the crc32 of its ids as uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        name, f, lens = None, None, None
        for batch in batches:
            col = batch.to_pydict()
            out = []
            for key, part, file, row, at, n, before, n_rows in zip(*(col[c] for c in ("doc_id", "part", "file", "row", "at", "n_tokens", "before", "n_rows"))):
                if file != name:
                    name, f, lens = file, fs.open_input_file(f"{root}/{file}.bin"), None
                counts = [n]
                if n_rows > 1:
                    if lens is None:
                        with fs.open_input_file(f"{root}/{file}.len") as g:
                            lens = np.frombuffer(g.read(), "<u4")
                    counts = lens[row : row + n_rows].tolist()
                for k in counts:
                    f.seek(at)
                    ids = np.frombuffer(f.read(k * width), f"<u{width}")
                    if len(ids) != k:
                        raise OSError(f"{file}: {len(ids)} of {k} ids at {at}")
                    out.append((key, part, before, k, zlib.crc32(ids.astype("<u4").tobytes())))
                    at, before = at + k * width, before + k
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    spread = found.repartitionByRange("part", "file", "at").sortWithinPartitions("part", "file", "at")
    return spread.mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write, index, then read every document back through the index: doc_id, start, n_tokens, ids_crc32."""
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    folder = shared_dir(spark, "token-ids")
    manifest = write_shards(docs, folder, tokenizer_path, end_id)
    index, buckets = build_index(manifest)
    found = materialize(lookup(manifest.select("doc_id").distinct(), index, buckets), "token-places")
    # One row per writer task: a few bytes for each some hundred MB of text.
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals.createOrReplaceTempView("hopgrid_shard_totals")
    base = spark.sql("select part, coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as base from hopgrid_shard_totals")
    return read_documents(found, folder, width).join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
