"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a byte is a boundary where the hash of the last REACH bytes is the greatest
within SPAN bytes on either side. Boundaries so depend on nothing farther away than SPAN + REACH bytes, and an insertion
moves only those next to it: a repeated passage has the same chunks wherever it stands. Chunks are matched by digest,
and runs of repeated chunks of a text are its repeated passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import WHITE, fresh, range_hash, stored, text_slices

#: Bytes that the gear hash looks back at; bytes on either side among which a boundary must be the greatest.
REACH, SPAN = 8, 16
#: The least length of a repeated passage that is reported, in words.
LEAST_WORDS = 25

GEAR = np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash (shift by one, add the byte's code) of the last REACH bytes, by doubling."""
    h = GEAR[data]
    width = 1
    while width < REACH:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint64(width)
        h = h + shifted
        width *= 2
    return h


def sliding_max(h: np.ndarray, span: int) -> np.ndarray:
    """The greatest of h[i - span : i] (exclusive of i); 0 where there is none."""
    pad = np.concatenate([np.zeros(span, h.dtype), h])
    out, width = pad, 1
    while width * 2 <= span:
        out = np.maximum(out[:-width], out[width:])
        width *= 2
    # two windows of `width` cover the span
    return np.maximum(out[: len(h)], out[span - width : span - width + len(h)])


def boundaries(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Ends of chunks: places after a boundary byte, between characters of UTF-8. Bytes of other rows count for none."""
    gap = SPAN + REACH
    n, size = len(offs) - 1, np.diff(offs)
    # rows are laid out with zeros between them, so that no window sees two rows
    at = np.repeat(np.arange(n) * gap + offs[:-1], size) + (np.arange(len(data)) - np.repeat(offs[:-1], size)) + gap
    wide = np.zeros(len(data) + (n + 1) * gap, np.uint64)
    h = gear_hashes(data) >> np.uint64(1)
    place = np.arange(len(data)) - np.repeat(offs[:-1], size)
    h = np.where(place >= REACH - 1, h, 0)
    wide[at] = h
    before = sliding_max(wide, SPAN)
    after = sliding_max(wide[::-1], SPAN)[::-1]
    peak = (h > 0) & (h > before[at]) & (h >= after[at]) & (np.repeat(size, size) - place > 1)
    ends = np.flatnonzero(peak) + 1
    for _ in range(3):  # a boundary inside a character moves to the character's end
        ends += (data[np.minimum(ends, len(data) - 1)] & 0xC0 == 0x80) & (ends < len(data))
    return np.unique(ends)


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, start, n, words, digest): the chunks of every text; start and n in bytes, pos counts from 0.

    A null or empty text has no chunk.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(1)):
                if not len(data):
                    continue
                ends = np.unique(np.concatenate([boundaries(data, offs), offs[1:][np.diff(offs) > 0]]))
                starts = np.concatenate([[0], ends[:-1]])
                row = np.searchsorted(offs, starts, "right") - 1
                blank = WHITE[data]
                begins = ~blank
                begins[1:] &= blank[:-1]
                count = np.zeros(len(data) + 1, np.int64)
                np.cumsum(begins, out=count[1:])
                digest = range_hash(data, starts, ends).view(np.int64)
                first = np.searchsorted(row, np.arange(hi - lo))
                columns = [np.arange(len(row)) - first[row], starts - offs[row], ends - starts, count[ends] - count[starts], digest]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), *(pa.array(c.astype(np.int32)) for c in columns[:4]), pa.array(digest)], ["key", "pos", "start", "n", "words", "digest"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, pos int, start int, n int, words int, digest long")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, start, bytes, words, copies, first): the passages of each text that stand elsewhere too.

    A passage is a run of chunks, at least `least_words` words long, each of which occurs in another place of the
    corpus (another text, or the same one again); it has a row for each piece whose chunks have the same first holder.
    copies: the least number of places that a chunk of the piece has; first: the least key that holds it; `kept`: this
    row is that holder, whose text stays.
    Rows with a null key take no part; rows with one key are one text's parts, and count as places. Null and empty texts
    have no passage; other columns of `docs` are not read. A chunk whose 64-bit digest equals another's by chance is no
    passage of `least_words` words by itself.
    """
    parts = chunked(docs.where(F.col(key).isNotNull()).select(key, text), key, text)
    known = parts.groupBy("digest", "n").agg(F.count("*").alias("copies"), F.min("key").alias("first")).where("copies > 1")
    met = parts.join(known, ["digest", "n"])
    place = Window.partitionBy("key").orderBy("start", "pos", "digest")
    # a chunk opens a passage unless the one before it ends where it starts
    opened = F.when(F.lag(F.col("start") + F.col("n")).over(place) == F.col("start"), 0).otherwise(1)
    turned = F.when(F.lag("first").over(place) == F.col("first"), F.col("_new")).otherwise(1)
    runs = met.withColumn("_new", opened).withColumn("_piece", turned).withColumns({"_run": F.sum("_new").over(place), "_piece": F.sum("_piece").over(place)})
    pieces = runs.groupBy("key", "_run", "_piece").agg(F.min("start").alias("start"), F.sum("n").alias("bytes"), F.sum("words").alias("words"), F.min("copies").alias("copies"), F.min("first").alias("first"))
    long = pieces.withColumn("_all", F.sum("words").over(Window.partitionBy("key", "_run"))).where(F.col("_all") >= least_words)
    return long.select(F.col("key").alias(key), "start", "bytes", "words", "copies", "first", (F.col("first") == F.col("key")).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with every repeated passage cut from all texts but its first holder; texts without one are unchanged.

    Rows with a null key or text stay as they are. Rows with one key lose what any of them would lose at that place, so
    keys should be unique; repeated rows stay repeated. Columns of any name come along; an empty table gives no rows.
    """
    cut = fresh(docs, "_cut")
    gone = stored(repeats(docs, key, text, least_words).where(~F.col("kept")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias(cut)))
    raw = F.encode(F.col(text), "UTF-8")

    def step(acc, x):
        return F.struct((x["start"] + x["bytes"]).cast("int").alias("at"), F.concat(acc["out"], F.substring(raw, acc["at"] + 1, x["start"] - acc["at"])).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.encode(F.lit(""), "UTF-8").alias("out"))
    rest = F.aggregate(cut, zero, step, lambda a: F.concat(a["out"], F.substring(raw, a["at"] + 1, F.octet_length(raw))))
    return docs.join(gone, key, "left").withColumn(text, F.when(F.col(cut).isNotNull(), F.decode(rest, "UTF-8")).otherwise(F.col(text))).select(*docs.columns)
