"""N-gram Jaccard join: count-vector R-trees over families of texts that share groups of shingles.

The shingles of a text are hashed into groups; the group counts are a point, and the summed coordinate minima of two
points bound the overlap of the two sets from above. An R-tree over the points carries coordinate maxima, so whole
nodes fall away; pairs that survive are verified on the sets.

Group counts of unrelated long texts are alike, so one tree over everything would prune little. Which texts come into
one tree is settled by the groups themselves, exactly: sets of a and b shingles with Jaccard similarity >= 0.8 differ in
at most D = (a + b) / 9 shingles, which lie in at most D of K groups, so of any D + m groups that are not empty in one of
them, m hold the very same shingles in both. Every text therefore lists its first D + m groups that are not empty
(`meetings`); those that two texts have in common are kept, texts that share fewer than m drop out, each text leaves out
its m - 1 most crowded ones, and what still hangs together is a family. A family goes to one R-tree with its texts, once.
In a large corpus short texts hang together in long chains, each text by another group; a family of more than BLOCK
shingles or BLOCK_TEXTS texts is taken apart into its groups where that is less work (`places`), since similar texts
have a kept group in common. What is still larger than a block is cut into blocks, and each pair of blocks is a task of
its own. Pairs never leave their task: it emits spanning edges between components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import discard, mix, stored, text_slices, window_hashes, word_hashes
from folioforge.llm.graph import components

WIDTH, NUM, DEN = 5, 80, 100
#: m is n // MARGIN + 1: the larger it is, the more groups are listed and the fewer texts remain.
MARGIN = 32
#: Shingles and texts that one block of a family holds, about.
BLOCK, BLOCK_TEXTS = 1_000_000, 2048
#: Groups that the sets of a family which is taken apart keep, at most, on average: near copies have more.
MOST_KEPT = 32
#: Places of so few texts and shingles share one tree of about BIN texts.
FEW, FEW_SHINGLES, BIN = 32, BLOCK // 64, 64
#: A group that so many texts of one slice of the input have is spread over SALTS places.
HOT, SALTS = 32, 64
#: Bits of the filter that keeps texts without a family from the shuffle: 8 MB, whatever the input's size.
SIEVE_BITS = 26
_GROUP, _SIZE, _SINGLE = (np.uint64(k) for k in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def sets_of(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, and the bounds of each text's run."""
    n = len(offs) - 1
    h, r = window_hashes(*word_hashes(data, offs), n, width)
    h = h >> np.uint64(2)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h.astype(np.int64), np.searchsorted(r, np.arange(n + 1))


def overlap_needed(a, b, num: int = NUM, den: int = DEN):
    """The least intersection of sets of a and b elements whose Jaccard similarity is num / den."""
    return -((-num * (a + b)) // (num + den))


def listed_groups(h: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the groups that each set has to list; h and b as of sets_of.

    Sizes from 2^j to 2^(j+1) - 1 are class j with its own number of groups; a set that can be similar to one of the next
    class lists groups of that class too. A set with fewer groups than it would have to list lists them all and, since
    two such sets may have none in common, the first of its shingles one by one as well.
    """
    n = np.diff(b)
    out_t, out_r = [], []
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    u = h.astype(np.uint64)
    code, high = mix(u ^ _GROUP), u >> np.uint64(30)
    level = np.frexp(np.maximum(n, 1).astype(float))[1]  # 2^(level - 1) <= n < 2^level
    most = n * DEN // NUM
    margin = n // MARGIN + 1
    few = np.zeros(len(n), bool)
    for step in (0, 1):
        top = np.left_shift(1, level + step)
        use = (n > 0) if step == 0 else most >= np.left_shift(1, level)
        differ = (n + np.minimum(most, top - 1)) * (DEN - NUM) // (DEN + NUM)
        quota = np.where(use, differ + margin, 0)
        groups = (top * 8 // 25 + 8).astype(np.uint64)
        at = np.flatnonzero(use[row])
        if not len(at):
            continue
        r = row[at]
        g = (high[at] * groups[r]) >> np.uint64(32)
        first = np.ones(len(at), bool)
        first[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        starts = np.flatnonzero(first)
        total = np.add.reduceat(code[at], starts)
        of = r[starts]
        have = np.bincount(of, minlength=len(n))
        place = np.arange(len(of)) - np.repeat(np.cumsum(have) - have, have)
        keep = place < quota[of]
        few |= use & (have < quota)
        out_t.append(mix(total + (g[starts] + np.uint64(1)) * _SIZE + (level[of] + step).astype(np.uint64) * _SINGLE)[keep])
        out_r.append(of[keep])
    least = -(-NUM * n // DEN)
    p = np.where(few, n - least + np.minimum(margin, least), 0)
    if p.sum():
        out = np.repeat(b[:-1], p) + np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
        out_t.append(mix(u[out] ^ _SINGLE))
        out_r.append(np.repeat(np.arange(len(n)), p))
    return np.concatenate(out_t), np.concatenate(out_r)


class CountTree:
    """An R-tree over count vectors, packed by size and then by the first coordinates."""

    FAN = 16

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        m = len(sizes)
        tile = max(self.FAN, int(np.sqrt(m * self.FAN)))
        by_size = np.argsort(sizes, kind="stable")
        tiles = np.empty(m, int)
        tiles[by_size] = np.arange(m) // tile
        self.order = np.lexsort((*counts[:, : min(4, counts.shape[1])].T[::-1], tiles))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.levels, top, low, high = [], self.counts, self.sizes, self.sizes
        while len(top) > self.FAN:
            cuts = np.arange(0, len(top), self.FAN)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def near(self, point: np.ndarray, size: int, num: int = NUM, den: int = DEN) -> np.ndarray:
        """Rows whose similarity to the set behind `point` can reach num / den."""
        at = None
        for top, low, high in [*self.levels[::-1], (self.counts, self.sizes, self.sizes)]:
            if at is None:
                at = np.arange(len(top))
            else:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(top)]
            fits = (high[at] * den >= num * size) & (low[at] * num <= den * size)
            at = at[fits]
            at = at[np.minimum(top[at], point).sum(1, dtype=np.int64) >= overlap_needed(size, low[at], num, den)]
        return self.order[at]


def group_counts(elements: np.ndarray, bounds: np.ndarray, groups: int) -> np.ndarray:
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    part = (mix(elements.astype(np.uint64)) & np.uint64(groups - 1)).astype(np.int64)
    counts = np.bincount(row * groups + part, minlength=n * groups).reshape(n, groups)
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def similar(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    """Whether den * |a & b| >= num * |a | b| for ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    same = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return len(a) > 0 and same >= overlap_needed(len(a), len(b), num, den)


def linked(keys: np.ndarray, elements: np.ndarray, bounds: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges (key, key) of the similarity graph of one block; of two sides, only pairs across them are tried."""
    sizes = np.diff(bounds)
    m, edges = len(keys), []
    if m < 2:
        return edges
    groups = 1 << int(np.clip(np.log2(max(sizes.mean(), 1) / 2), 4, 9))
    counts = group_counts(elements, bounds, groups)
    tree, root = CountTree(counts, sizes), np.arange(m)
    codes = np.unique(elements, return_inverse=True)[1]
    mark = np.zeros(len(elements) + 1, bool)
    for i in range(1, m):
        near = tree.near(counts[i], int(sizes[i]))
        near = near[near < i]
        if side is not None:
            near = near[side[near] != side[i]]
        own = codes[bounds[i] : bounds[i + 1]]
        # one of each component first: the rest of a component that is met need not be looked at
        while len(near := near[root[near] != root[i]]):
            one = np.unique(root[near], return_index=True)[1]
            tried = near[one]
            mark[own] = True
            at = np.repeat(bounds[tried] - np.concatenate([[0], np.cumsum(sizes[tried])[:-1]]), sizes[tried]) + np.arange(sizes[tried].sum())
            same = np.add.reduceat(mark[codes[at]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[tried])[:-1]]))
            mark[own] = False
            near = np.delete(near, one)
            for j in tried[(same >= overlap_needed(int(sizes[i]), sizes[tried])) | (keys[tried] == keys[i])].tolist():
                edges.append((int(keys[i]), int(keys[j])))
                a, b = sorted((int(root[i]), int(root[j])))
                root[root == b] = a
    return edges


def by_group(columns: list[str], body: Callable[[list[np.ndarray | pa.Array]], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function over partitions sorted by the first column: body sees the whole of each group."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1 if len(key) else np.zeros(0, int)
            if held and len(key) and held[-1].column(0)[-1].as_py() != key[0]:
                yield from body(pa.Table.from_batches(held).combine_chunks())
                held = []
            lo = 0
            for hi in cuts:
                yield from body(pa.Table.from_batches([*held, batch.slice(lo, hi - lo)]).combine_chunks())
                held, lo = [], hi
            if len(key):
                held.append(batch.slice(lo))
        if held:
            yield from body(pa.Table.from_batches(held).combine_chunks())

    return run


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    bounds = array.offsets.to_numpy()
    return array.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0]


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def run_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def signatures(docs: DataFrame) -> DataFrame:
    """(key, n, s1, s2) of rows (key, text): set size and two 64-bit checksums of the set."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(1)):
                h, b = sets_of(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(b), pa.int64()), *map(pa.array, checksums(h, b))], ["key", "n", "s1", "s2"])

    return docs.select("key", "text").mapInArrow(run, "key long, n long, s1 long, s2 long")


def checksums(h: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    u = h.astype(np.uint64)
    return [run_sums(mix(u ^ np.uint64(salt)), b).view(np.int64) for salt in (0, 0x5DEECE66D)]


#: Groups that a set of n shingles shares with any similar one among those that both list, at least.
LEAST_SHARED = f"CAST((n * {NUM}) DIV {MARGIN * DEN} + 1 AS INT)"


def meetings(docs: DataFrame) -> DataFrame:
    """(tok, s, n): the listed groups of every set that another set has too; a set is named by its first checksum.

    One shuffle. A task sends a set once, however many copies it reads, and spreads groups that are common in its input
    over SALTS places, with two witnesses at the place where the rest of the group is counted.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                h, b = sets_of(data, offs)
                s = checksums(h, b)[0]
                fresh = np.zeros(len(s), bool)
                for i, x in enumerate(s.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen = set()
                t, r = listed_groups(h, b)
                keep = fresh[r]
                t, r = t[keep], r[keep]
                of, n = s[r], np.diff(b)[r].astype(np.int64)
                _, back, many = np.unique(t, return_inverse=True, return_counts=True)
                salt = np.where(many[back] >= HOT, 1 + (mix(of.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)
                if salt.any():
                    hot = np.flatnonzero(salt)
                    hot = hot[np.argsort(back[hot], kind="stable")]
                    new = np.flatnonzero(np.append(True, np.diff(back[hot]) > 0))
                    two = hot[np.concatenate([new, new + 1])]
                    t, of, n, salt = (np.concatenate([x, y]) for x, y in ((t, t[two]), (of, of[two]), (n, n[two]), (salt, np.zeros(len(two), np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(of), pa.array(salt << 40 | n)], ["tok", "s", "w"])

    def shared(batches):
        """Rows of runs (tok, salt) with two sets at least; a row waits until its run has a second set."""
        held, known = None, None
        for batch in batches:
            tok, s, w = (batch.column(i).to_numpy() for i in range(3))
            if held is not None:
                tok, s, w = (np.concatenate([[a], b]) for a, b in zip(held, (tok, s, w)))
                held = None
            if not len(tok):
                continue
            salt = w >> 40
            new = np.append(True, (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1]))
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            more = np.add.reduceat((s != s[starts][run_of]).astype(np.int64), starts) > 0
            more |= salt[starts] > 0
            if known == (int(tok[0]), int(salt[0])):
                more[0] = True
            known = (int(tok[-1]), int(salt[-1])) if more[-1] else None
            if not more[-1]:
                held = (tok[-1], s[-1], w[-1])
            once = np.append(True, new[1:] | (s[1:] != s[:-1]))
            keep = more[run_of] & once
            yield pa.RecordBatch.from_arrays([pa.array(tok[keep]), pa.array(s[keep]), pa.array(w[keep] & ((1 << 40) - 1))], ["tok", "s", "n"])

    sent = docs.select("text").mapInArrow(run, "tok long, s long, w long")
    salt = F.shiftright("w", 40)
    return sent.repartition("tok", salt).sortWithinPartitions("tok", salt, "s").mapInArrow(shared, "tok long, s long, n long")


def families(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component): the sets that may be similar to another one, and their family, from rows (tok, s, n); and

    (tok, s): the groups that each set keeps. Two similar sets have one of these in common.
    """
    own = Window.partitionBy("s")
    enough = stored(met.withColumn("_c", F.count("*").over(own)).where(f"_c >= {LEAST_SHARED}").drop("_c"))
    sizes = enough.groupBy("tok").agg(F.count("*").alias("_m"), F.min("s").alias("_lo"), F.max("s").alias("_hi")).where("_lo <> _hi").select("tok", "_m")
    # similar sets share at least as many groups as either has to; the one of these that comes first by size has the
    # others after it in both lists, so both keep it although each leaves out its LEAST_SHARED - 1 largest
    largest = own.orderBy(F.desc("_m"), F.desc("tok"))
    placed = enough.join(sizes, "tok").withColumns({"_r": F.row_number().over(largest), "_c": F.count("*").over(own)})
    kept = stored(placed.where(f"_c >= {LEAST_SHARED} AND _r >= {LEAST_SHARED}").select("tok", "s"))
    least = kept.groupBy("tok").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("tok", "lo")
    edges = stored(kept.join(least, "tok").where("s <> lo").select(F.col("s").alias("a"), F.col("lo").alias("b")).distinct())
    out = components(edges)
    discard(enough, edges)
    return out, kept


def sieve_of(keys: DataFrame) -> np.ndarray:
    """A bit for each SIEVE_BITS-bit prefix of a hash of `key`; words are combined on the executors."""
    place = F.shiftrightunsigned(F.xxhash64("key"), 64 - SIEVE_BITS)
    words = keys.select(place.alias("p")).selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, CAST(p & 63 AS INT)) AS v")
    got = words.groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()  # at most 2^20 rows
    out = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    out[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).view(np.uint64)
    return out


def sifted(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (key, text) whose key may be among `keys`; most others stay where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve_of(keys))

    def run(batches):
        bits = shared.value
        for batch in batches:
            p = batch.column(2).to_numpy().view(np.uint64)
            keep = (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
            yield batch.select([0, 1]).filter(pa.array(keep))

    return docs.select("key", "text", F.shiftrightunsigned(F.xxhash64("key"), 64 - SIEVE_BITS).alias("p")).mapInArrow(run, "key long, text string")


def blocks() -> Column:
    """Into how many blocks a group of rows with set sizes n is cut."""
    return F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int")


def places(members: DataFrame, kept: DataFrame) -> DataFrame:
    """`members`, rows (key, s, n, component), with families of several blocks taken apart where that is less work.

    The work of a place is the shingles that its tasks read, and a quarter of the pairs of its texts. A family that is
    taken apart has a place for each group that two of its sets keep (`kept`, rows (tok, s)): its sets come once for each
    of theirs, with the place as component. Near copies, which have very many groups in common, stay together. Places of
    few texts are put together, about BIN texts in one.
    """
    work = F.col("_b") * F.col("_n") + F.col("_m") * F.col("_m") / 4
    size = [blocks().alias("_b"), F.sum("n").cast("double").alias("_n"), F.count("*").cast("double").alias("_m")]
    # families that keep very many groups, or whose tasks would read too much in any case, are not joined with them
    keeps = kept.groupBy("s").agg(F.count("*").alias("_k"))
    least = [F.sum(F.col("n") * F.col("_k")).alias("_least"), F.avg("_k").alias("_each")]
    large = members.join(keeps, "s").groupBy("component").agg(*size, *least).where("_b > 1").withColumn("_whole", work).where(f"_least < _whole AND _each <= {MOST_KEPT}").select("component", "_whole")
    met = stored(kept.join(members.join(F.broadcast(large), "component"), "s"))
    apart = met.groupBy("component", "tok").agg(*size, F.first("_whole").alias("_whole")).where("_m > 1")
    chosen = apart.groupBy("component").agg(F.sum(work).alias("_apart"), F.first("_whole").alias("_whole")).where("_apart < _whole").select("component")
    chosen = F.broadcast(stored(chosen))
    shared = apart.join(chosen, "component", "left_semi").select("component", "tok")
    single = met.drop("_whole").join(shared, ["component", "tok"]).withColumn("component", F.xxhash64("component", "tok"))
    names = ["key", "s", "n", "component"]
    placed = stored(members.join(chosen, "component", "left_anti").select(names).union(single.select(names)))
    few = placed.groupBy("component").agg((F.count("*") <= FEW) & (F.sum("n") <= FEW_SHINGLES)).toDF("component", "_few")
    bins = F.pmod(F.xxhash64("component", F.lit(5)), F.lit(placed.count() // BIN + 1))
    return placed.join(few, "component").withColumn("component", F.when(F.col("_few"), bins).otherwise(F.col("component"))).select(names).distinct()


def family_edges(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (a, b) between similar texts of one place, from texts (key, text) and rows (key, s, n, component)."""
    sizes = members.groupBy("component").agg(blocks().alias("_b"))
    dealt = members.join(sizes, "component").withColumn("_r", F.pmod(F.xxhash64("key", "s", F.lit(7)), F.col("_b")).cast("int"))
    rows = sifted(docs, members).join(dealt, "key").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    group = F.xxhash64("component", F.least("_r", "_s"), F.greatest("_r", "_s"))

    def body(t: pa.Table):
        sets, sums = [], []
        for _, _, data, offs in text_slices(t["text"]):
            h, b = sets_of(data, offs)
            sums.append(checksums(h, b)[0])
            sets += np.split(h, b[1:-1])
        right = np.concatenate(sums) == t["s"].to_numpy()  # another text of a repeated key has a set of its own
        sets = [x for x, ok in zip(sets, right) if ok]
        side = t["side"].to_numpy()[right]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
        edges = linked(t["key"].to_numpy()[right], np.concatenate(sets) if sets else np.zeros(0, np.int64), bounds, side if (side != side[:1]).any() else None)
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    sent = rows.select(group.alias("g"), "key", "s", F.col("_r").alias("side"), "text").repartition("g").sortWithinPartitions("g", "key", "s")
    return sent.mapInArrow(by_group(["g", "key", "s", "side", "text"], body), "a long, b long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row of `docs`.

    component_id is the least key reachable over links of Jaccard similarity >= 0.8 between the five-word shingle sets
    (A-Z lower-cased); a text of fewer words is one shingle, a null or blank text an empty set linked with nothing.
    Rows with a null key take no part and have a null component. Equal sets (by size and 128 bits of checksum) are one
    class throughout, so groups of copies of any size cost one representative. Rows with one key are one document: what
    is linked with one of its texts is linked with all. Other columns of `docs` are not read; an empty table gives none.
    """
    base = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    known = base.where("key IS NOT NULL")
    sig = stored(signatures(base))
    held = sig.where("key IS NOT NULL AND n > 0")
    least = stored(held.groupBy("s1", "s2", "n").agg(F.min("key").alias("rep")))

    met = stored(meetings(known))
    family, kept = families(met)
    discard(met)
    members = stored(least.join(family, F.col("s1") == F.col("node")).select(F.col("rep").alias("key"), F.col("s1").alias("s"), "n", "component"))
    placed = stored(places(members, kept))
    discard(kept, members)
    twice = held.groupBy("key").agg(F.min(F.struct("s1", "s2", "n")).alias("_lo"), F.max(F.struct("s1", "s2", "n")).alias("_hi")).where("_lo <> _hi").select("key")
    same = held.join(twice, "key", "left_semi").join(least, ["s1", "s2", "n"]).select(F.col("key").alias("a"), F.col("rep").alias("b"))
    edges = stored(family_edges(known, placed).union(same))
    comp = components(edges)

    named = least.join(comp, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("_c"))
    rows = sig.join(named, ["s1", "s2", "n"], "left")
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("_c", "key")).alias("component_id"))
