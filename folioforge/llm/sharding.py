"""Sharding along a Hilbert curve, by DataFrame functions alone.

Several metadata dimensions are quantised to the cells of a grid, the grid is walked along its Hilbert curve, and the
walk is cut into runs. A shard then covers a compact box of every dimension, so the minima and maxima of its files
prune on any of them. The global order is one range-partitioned sort on several columns, so no single value (a hot
source, a group of copies) can fill a task; ranks are partition offsets plus places, with no global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import stored

#: Bits of the grid in each dimension; values of a dimension that its cuts are taken from, at most.
BITS, MOST = 6, 4096
#: Groups with more than one row in HOT are matched by a broadcast of at most HOT rows, all others by their text.
HOT = 1000


def cuts_of(rows: DataFrame, column: str, bits: int = BITS) -> list[tuple]:
    """(value, cell) at most 2^bits - 1 times, ascending: from a value on, its cell is the share of rows below it."""
    seen = rows.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(MOST).collect()
    total, out, at = sum(r["count"] for r in seen), [], 0
    for r in sorted(seen, key=lambda r: r[0]):
        cell = at * (1 << bits) // total
        if cell > (out[-1][1] if out else 0):
            out.append((r[0], cell))
        at += r["count"]
    return out


def quantised(value: Column, cuts: list[tuple]) -> Column:
    """The cell of the last cut up to a value, so cells keep the order of the values; null is in the first one."""
    if not cuts:
        return F.lit(0)
    steps = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(c).alias("c")) for v, c in cuts])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda n, x: F.when(x["v"] <= value, x["c"]).otherwise(n)), F.lit(0))


def with_hilbert(rows: DataFrame, dims: list[Column], name: str = "hilbert", bits: int = BITS) -> DataFrame:
    """`rows` with the position on the Hilbert curve through the grid of len(dims) x 2^bits cells.

    The coordinates are turned into the transposed index bit by bit from the top (exchange or invert the low bits of
    the first axis), then Gray-coded, then their bits are dealt out. Each step is a column of its own that the next one
    uses more than once, so none is computed again inside another.
    """
    n = len(dims)
    steps = [F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)]

    def turn(x: Column, s: Column) -> Column:
        low, hit = s["q"] - 1, x[s["i"]].bitwiseAND(s["q"]) != 0
        swap = x[0].bitwiseXOR(x[s["i"]]).bitwiseAND(low)
        return F.transform(x, lambda v, k: v.bitwiseXOR(F.when(hit, F.when(k == 0, low).otherwise(0)).otherwise(F.when((k == 0) | (k == s["i"]), swap).otherwise(0))))

    rows = rows.withColumn("_turned", F.aggregate(F.array(*steps), F.array(*dims), turn))
    gray = [F.col("_turned")[0]]
    for k in range(1, n):
        gray.append(gray[-1].bitwiseXOR(F.col("_turned")[k]))
    rows = rows.withColumns({f"_gray{k}": g for k, g in enumerate(gray)})
    flip = F.lit(0)
    for b in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(f"_gray{n - 1}").bitwiseAND(1 << b) != 0, (1 << b) - 1).otherwise(0))
    rows = rows.withColumn("_flip", flip)
    bit = [(b, k) for b in range(bits - 1, -1, -1) for k in range(n)]
    index = sum((F.getbit(F.col(f"_gray{k}").bitwiseXOR(F.col("_flip")), F.lit(b)).cast("long") * F.lit(1 << (len(bit) - 1 - at)) for at, (b, k) in enumerate(bit)), F.lit(0).cast("long"))
    return rows.withColumn(name, index).drop("_turned", "_flip", *[f"_gray{k}" for k in range(n)])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `_rank` (from 0, gapless in the given order) and `_total`; ties are broken by `order` alone.

    A sort task numbers its own rows; the written table keeps those numbers, so a lost executor cannot change them.
    """
    placed = stored(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    along = Window.orderBy("_part")  # a row for each task of the sort
    offsets = sizes.select("_part", (F.sum("_n").over(along) - F.col("_n")).alias("_from"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_from") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_place", "_from")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = ()) -> DataFrame:
    """key, size, text_crc32, hilbert, shard, slot and the columns `keep` of every row.

    Law `rows`: shards are equal runs along the curve, so their row counts differ by one at most. The dimensions are the
    size and `dims`; rows of equal text take the metadata of the group's least key, so a group lies together on the
    curve and is cut only where a shard ends. Within a cell: by text checksum, then by a hash of the key, then the key.
    A null text has no bytes; null keys, repeated rows and columns missing from `docs` are allowed; an empty table gives
    no rows.
    """
    dims = tuple(d for d in dims if d in docs.columns)
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("_key"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("_text"), *[F.col(d).cast("string").alias(f"_d{i}") for i, d in enumerate(dims)], *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    names = [f"_d{i}" for i in range(len(dims))]
    rows = rows.withColumn("_log", F.floor(F.log2("size") * 32).cast("int"))
    cuts = [cuts_of(rows, "_log"), *[cuts_of(rows, n) for n in names]]
    first = stored(rows.groupBy("_text", "size").agg(F.count("*").alias("_n"), F.min(F.struct("_key", *names)).alias("_first")).where("_n > 1"))
    total = rows.count()
    hot = first.where(F.col("_n") > max(total // HOT, HOT)).select(F.col("_text").alias("_ht"), F.col("size").alias("_hs"), F.col("_first").alias("_hot"))
    rows = rows.join(F.broadcast(hot), (F.col("_text") == F.col("_ht")) & (F.col("size") == F.col("_hs")), "left")
    # rows that have found their group go to places of their own in the second join
    rows = rows.withColumns({"_jt": F.when(F.col("_hot").isNull(), F.col("_text")).otherwise(F.xxhash64("_key", "_text")), "_js": F.when(F.col("_hot").isNull(), F.col("size")).otherwise(F.lit(-1))})
    group = first.select(F.col("_text").alias("_jt"), F.col("size").alias("_js"), "_first")
    rows = rows.join(group, ["_jt", "_js"], "left").withColumn("_own", F.coalesce("_hot", "_first", F.struct("_key", *names)))
    rows = with_hilbert(rows, [quantised(F.col("_log"), cuts[0]), *[quantised(F.col(f"_own.{n}"), c) for n, c in zip(names, cuts[1:])]])
    rows = rows.select("_key", "size", "text_crc32", "hilbert", "_text", F.xxhash64("_key").alias("_spread"), *[f"_k{i}" for i in range(len(keep))])
    done = ranked(rows, ["hilbert", "text_crc32", "_text", "_spread", "_key"])
    exact = F.expr(f"CAST((_rank * {shards}) DIV _total AS INT)")
    start = F.expr(f"(shard * _total + {shards - 1}) DIV {shards}")
    return done.withColumn("shard", exact).withColumn("slot", F.col("_rank") - start).select(F.col("_key").alias(key), "size", "text_crc32", "hilbert", "shard", "slot", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def write_shards(docs: DataFrame, path: str, shards: int = 16, **how) -> None:
    """Writes whole rows of `docs`, one folder a shard, in curve order; statistics of its files then prune on every dimension."""
    key = how.get("key", "doc_id")
    rest = tuple(c for c in docs.columns if c != key)
    done = shard(docs, shards, keep=rest, **how).withColumn("_slot", F.col("slot"))
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    done.select(*[F.col(c) for c in names], "shard", "_slot").repartitionByRange("shard", "_slot").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)
