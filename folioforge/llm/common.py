"""Shared helpers of the training-data operators: tables, shared scratch space, vectorised text hashing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the vectorised kernels hold at a time.
SLICE_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULT = np.uint64(0x9E3779B97F4A7C55)
MULT_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and driver and executors are one process (tests, a laptop) a local temporary folder
    takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = getattr(scratch, "local", None)
        if held is None:
            held = scratch.local = tempfile.mkdtemp(prefix="folioforge-")
            atexit.register(shutil.rmtree, held, True)
        root = f"file://{held}"
    return f"{root}/folioforge-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """df written to the shared folder and read again: short lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, longer where `df` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent().getParent()
            if folder.getName().startswith("folioforge-"):
                folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def powers(base: np.uint64, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006  one array a process and base
    have = kept.get(int(base))
    if have is None or len(have) < n:
        out = np.empty(max(n, SLICE_BYTES + 4096), np.uint64)
        out[0] = 1
        out[1:] = base
        have = kept[int(base)] = np.cumprod(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash may be used."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]: a polynomial over random byte codes, taken as a difference of prefix sums."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(MULT, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(MULT_INV, n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about `limit` bytes; null reads as empty. No row is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_bounds(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-separator bytes, and the row of each; a run ends with its row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separator[data]
    first = inside[1:-1] & ~inside[:-2]
    cuts = offs[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[1:-1][cuts]
    starts = np.flatnonzero(first)
    last = inside[1:-1] & ~inside[2:]
    back = cuts[cuts > 0] - 1
    last[back] = inside[1:-1][back]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word [^\\x20\\x09-\\x0D]+ after A-Z became a-z."""
    starts, ends, rows = word_bounds(data, offs)
    return range_hash(LOWER[data], starts, ends), rows


def window_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of `width` words of a row; a row with fewer words gives its whole sequence."""
    counts = np.bincount(rows, minlength=n_rows)
    n = len(words)
    out_h, out_r = [], []
    if n >= width:
        m = n - width + 1
        acc = np.zeros(m, np.uint64)
        for k in range(width):
            acc += words[k : k + m] * powers(MULT, width + 1)[k]
        whole = rows[:m] == rows[width - 1 :]
        out_h.append(mix(acc[whole] + np.uint64(width)))
        out_r.append(rows[:m][whole])
    first = np.concatenate([[0], np.cumsum(counts)])
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        w = words[first[r] : first[r + 1]]
        out_h.append(mix(np.array([(w * powers(MULT, width + 1)[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64)))
        out_r.append(np.array([r]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]
