"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from vectorised passes over the bytes of whole texts. Trees are grown in numpy on a bounded sample of
labelled rows, then flattened into arrays, so that scoring a batch is a few array lookups for each level of the trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import LOWER, WHITE, range_hash, text_slices, word_bounds

#: Labelled rows that the trees are fitted on, at most; taken by a hash of the key, evenly over all labelled rows.
SAMPLE = 20_000

FEATURES = (
    "log_bytes", "log_words", "bytes_a_word", "word_bytes_sd", "upper", "digit", "space", "newline", "other_bytes",
    "stop_punct", "comma", "pipe", "bang", "symbols", "braces", "quotes", "at", "distinct_words", "distinct_lines",
    "bytes_a_line", "symbol_words", "upper_words", "top_word", "byte_entropy", "short_words", "long_words", "distinct_pairs",
)

_SETS = {"upper": range(65, 91), "digit": range(48, 58), "space": (32,), "newline": (10,), "other_bytes": range(128, 256), "stop_punct": b".?", "comma": b",;:", "pipe": b"|", "bang": b"!", "symbols": b"#$%&*+=^~<>\\_", "braces": b"{}[]()", "quotes": b"\"'`", "at": b"@/"}
_LINE = np.zeros(256, bool)
_LINE[10] = True


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    n, size = len(offs) - 1, np.diff(offs)
    out = dict.fromkeys(FEATURES, np.zeros(n))
    if len(data):
        row = np.repeat(np.arange(n), size)
        hist = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
        total = np.maximum(size, 1)[:, None]
        for name, chars in _SETS.items():
            out[name] = hist[:, list(chars)].sum(1) / total[:, 0]
        share = hist / total
        out["byte_entropy"] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
        starts, ends, of = word_bounds(data, offs)
        words = np.bincount(of, minlength=n).astype(float)
        some = np.maximum(words, 1)
        length = (ends - starts).astype(float)
        mean = np.bincount(of, length, n) / some
        out |= {"log_bytes": np.log1p(size), "log_words": np.log1p(words), "bytes_a_word": mean, "word_bytes_sd": np.sqrt(np.maximum(np.bincount(of, length**2, n) / some - mean**2, 0))}
        out |= {"short_words": np.bincount(of, length <= 2, n) / some, "long_words": np.bincount(of, length >= 12, n) / some}
        h = range_hash(LOWER[data], starts, ends)
        last, first = data[ends - 1], data[starts]
        letter = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128)
        stop = np.isin(last, np.frombuffer(b".,;:?", np.uint8))
        out["symbol_words"] = np.bincount(of, ~(letter | stop), n) / some
        out["upper_words"] = np.bincount(of, (first >= 65) & (first <= 90), n) / some
        out["distinct_words"], out["top_word"] = _distinct(h, of, n)
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C55) + h[1:]
        same = of[:-1] == of[1:]
        out["distinct_pairs"] = _distinct(pair[same], of[:-1][same], n)[0]
        ls, le, lof = word_bounds(data, offs, _LINE)
        out["distinct_lines"] = _distinct(range_hash(data, ls, le), lof, n)[0]
        out["bytes_a_line"] = size / np.maximum(np.bincount(lof, minlength=n), 1)
    return np.stack([np.asarray(out[k], np.float32) for k in FEATURES], 1)


def _distinct(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values over all values of each row, and the commonest value's share."""
    total = np.maximum(np.bincount(of, minlength=n), 1)
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, of))
    hs, os_ = h[order], of[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (os_[1:] != os_[:-1])
    at = np.flatnonzero(new)
    runs, top = np.diff(np.append(at, len(hs))), np.zeros(n)
    np.maximum.at(top, os_[at], runs)
    return np.bincount(os_[at], minlength=n) / total, top / total


@dataclass
class Trees:
    """Every tree of a boosted model in flat arrays, node by node; leaves point at themselves."""

    edges: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Logistic boosting on histograms of binned features; ties go to the earlier feature and the lower cut."""
    n, d = x.shape
    share = (y.sum() + 1) / (n + 2) if n else 0.5
    base = float(np.log(share / (1 - share)))
    grid = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for j in range(d)]
    binned = np.stack([np.searchsorted(grid[j], x[:, j], "left") for j in range(d)], 1) if n else np.zeros((0, d), int)
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)
    flat = binned + np.arange(d) * bins
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        queue = [(np.arange(n), 0)]
        feature.append(0), cut.append(np.inf), left.append(roots[-1]), right.append(roots[-1]), value.append(0.0)
        spots = [roots[-1]]
        while queue:
            rows, level = queue.pop()
            at = spots.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if level < depth and hs > 2 * least:
                part = flat[rows].ravel()
                hg = np.bincount(part, np.repeat(g[rows], d), d * bins).reshape(d, bins).cumsum(1)
                hh = np.bincount(part, np.repeat(h[rows], d), d * bins).reshape(d, bins).cumsum(1)
                gain = np.where((hh >= least) & (hs - hh >= least), hg**2 / (hh + l2) + (gs - hg) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2), -1)
                k = int(np.argmax(gain))
                if gain.ravel()[k] > 1e-6 and k % bins < len(grid[k // bins]):
                    best = k // bins, k % bins
            if best is None:
                step = -rate * gs / (hs + l2)
                value[at] = float(step)
                margin[rows] += step
                continue
            j, b = best
            goes = binned[rows, j] <= b
            feature[at], cut[at] = j, float(grid[j][b])
            for side, sub in ((left, rows[goes]), (right, rows[~goes])):
                side[at] = len(feature)
                feature.append(0), cut.append(np.inf), left.append(len(feature) - 1), right.append(len(feature) - 1), value.append(0.0)
                queue.append((sub, level + 1))
                spots.append(side[at])
    return Trees(np.zeros(0), np.array(feature or [0]), np.array(cut or [np.inf], np.float32), np.array(left or [0]), np.array(right or [0]), np.array(value or [0.0]), np.array(roots or [0]), depth, base)


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and the FEATURES of each row as one array column `stats`."""
    rest = docs.select(*keep).schema

    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            got = [statistics(d, o) for _, _, d, o in text_slices(column)]
            x = np.concatenate(got) if got else np.zeros((0, len(FEATURES)), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*keep, "stats"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{schema}, stats array<float>")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, **how) -> Trees:
    """Trees from at most `sample` labelled rows of `docs`, the first by a hash of the key; null labels are left out.

    Several labels of one key: the highest counts. Without any labelled row the score is a constant 0.5.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    marks = marks.orderBy(F.xxhash64(key), key).limit(sample)  # bounded by `sample`, so it may be broadcast
    got = features(docs.select(key, text).join(F.broadcast(marks), key), [key, "_y"], text).toPandas() if sample else None
    if got is None or got.empty:
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    got = got.sort_values(key, kind="stable")
    return fit(np.stack(got["stats"].to_numpy()), got["_y"].to_numpy(float), **how)


def score(docs: DataFrame, model: Trees, keep: list[str] | None = None, text: str = "text", name: str = "score") -> DataFrame:
    """`keep` columns (all by default) plus `name`: the probability of label 1.

    A null text reads as empty; rows are scored one by one, so null keys, ties and repeated rows stay as they are, and an
    empty table gives no rows. `name` must not be one of `keep`.
    """
    keep = keep or docs.columns
    rest = docs.select(*keep).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo, hi, d, o in text_slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(lo, hi - lo)
                p = m.probability(statistics(d, o))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p)], [*keep, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{schema}, `{name}` double")
