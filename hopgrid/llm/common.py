"""Shared folder, files and small text helpers of the training-data operators."""

from __future__ import annotations

import getpass
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: White space of the word definition: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def lower_ascii(text: str) -> str:
    """A-Z to a-z; every other character stays."""
    return text.translate(_LOWER) if not text.isascii() else text.lower()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: 0 white space, 2 ASCII signs, 1 all else (letters, digits, and every character beyond ASCII).
_KIND = np.array([0 if s else 1 if b >= 128 or chr(b).isalnum() else 2 for b, s in enumerate(_SPACE)], np.uint8)
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_LOWERED = _VALUES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2^64, at least ``n`` of each."""
    size = max(_PIECE, n) + 1
    if size not in _POWERS:
        if size > _PIECE + 1:  # one very long word: not kept
            return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, _BACK))
        _POWERS[size] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, _BACK))
    return _POWERS[size]


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The joined UTF-8 of a string column and each row's first place, and the end; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    joined = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return joined, at - at[0]


def hashed_words(column, lower: bool = True, spans: bool = False, signs: bool = False):
    """64-bit hashes of the words of a string column, row after row, and the number of words of each row.

    Words are runs of bytes other than space and \\t-\\r; with ``lower`` A-Z hash as a-z. A word's hash is a
    polynomial in its bytes modulo 2^64, taken from running sums over pieces cut between words, then
    mixed: no word becomes a Python object. With ``signs`` a word ends where letters meet signs, too. With ``spans``: also the joined bytes, and each word's first place and end there.
    """
    data, rows = _bytes_of(column)
    value = _LOWERED if lower else _VALUES
    space = _SPACE[data]
    before = np.ones(len(data), bool)  # a word can begin here
    before[1:] = (np.diff(_KIND[data]) != 0) if signs else space[:-1]
    before[rows[:-1][rows[:-1] < len(data)]] = True
    first = np.flatnonzero(before & ~space)
    after = np.ones(len(data), bool)
    after[:-1] = before[1:] | space[1:]  # before[1:] holds where the next place begins a word or a row
    end = np.flatnonzero(after & ~space) + 1
    counts = np.diff(np.searchsorted(first, rows))
    out = np.empty(len(first), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(end, first[i] + _PIECE, "right")))
            at = first[i]
            n = int(end[j - 1] - at)
            up, back = _powers(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(value[data[at : at + n]] * up[:n], out=sums[1:])
            a, b = first[i:j] - at, end[i:j] - at
            out[i:j] = (sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)
            i = j
    out = mix64(out)
    return (out, counts, data, first, end) if spans else (out, counts)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``k`` words (all its words if fewer), and their number in each row."""
    n = np.where(counts > k, counts - k + 1, np.minimum(counts, 1))
    base = np.cumsum(counts) - counts
    at = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    width = np.repeat(np.minimum(counts, k), n)
    with np.errstate(over="ignore"):
        out = width.astype(np.uint64)
        for i in range(k):
            live = i < width
            step = mix64(out * np.uint64(_BASE) + hashes[np.where(live, at + i, at)])
            out = step if live.all() else np.where(live, step, out)
    return out, n


def shared_dir(spark: SparkSession, label: str) -> str:
    """URI of a new folder that the driver and all executors see, below ``spark.checkpoint.dir``.

    Where the setting is absent (tests on a local master) a folder below the
    local temp folder is used. The folder goes when the application ends.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints/{getpass.getuser()}"
    if root.startswith("/"):
        root = f"file://{root}"
    uri = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    _FOLDERS.append(uri)
    return uri


_FOLDERS: list[str] = []


def folders_so_far() -> int:
    """A mark for ``release_since``."""
    return len(_FOLDERS)


def release_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the shared folders made since ``mark``, but for those of the written tables ``keep``."""
    kept = {df._folder for df in keep}
    for uri in _FOLDERS[mark:]:
        if uri not in kept:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _FOLDERS.remove(uri)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    uri = shared_dir(spark, label)
    df.write.mode("overwrite").parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    out._folder = uri
    return out


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path of a shared folder's URI (file, hdfs, s3, gs)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.removeprefix("file:").replace("//", "/", 1) if uri.startswith("file:///") else uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    try:
        return int(spark.conf.get(key, str(default)))
    except ValueError:
        return default
