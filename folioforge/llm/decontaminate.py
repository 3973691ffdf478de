"""Benchmark decontamination by template canonicalisation.

Words become tokens of a template: numbers, units and names turn into typed placeholders, everything else is lower-case
letters. Windows of the template are hash-joined with the windows of the benchmark items, so a question whose numbers
or names were exchanged still meets its original. Every text has three templates (TEMPLATES), since what is a name can
only be guessed: one without names meets copies in another case, one in which each capitalised word is a name meets
copies with other names at the start of a sentence. Items shorter than a window are searched with their own length. For every (document, item) that meets, the slots are then compared:
one value of the item must always be replaced by the same value, as a re-parameterised copy does and chance does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import LOWER, MULT, mix, powers, range_hash, stored, text_slices, word_bounds

#: Template tokens in a window; the share of an item's windows that a document must hold; the share of slots that must
#: agree with one consistent exchange of values.
WINDOW, CONTAINED, CONSISTENT = 8, 0.6, 0.9
#: A window with fewer literal words (a table of numbers, a list of names) is compared by its own words, not by its
#: template: all such windows have a few templates in common.
LEAST_WORDS = 2
#: Bits of the filter that keeps windows of no item from the join: 2 MB, whatever the benchmark's size.
FILTER_BITS = 24
#: What counts as a name: capitalised words inside a sentence, none, all capitalised words.
TEMPLATES = ("inner", "none", "all")
#: Words of the shortest item that is searched inside documents; in how many literal words its numbers and units may be
#: exchanged. Shorter items are found only as a whole document: one or two words are no sign of a leak.
SHORTEST, LITERAL = 3, 4

#: Words after a number that are units (fixed values).
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years"
    " usd eur gbp dollar dollars euro euros cent cents percent pct mph kmh kph w kw kwh v a ohm hz khz mhz ghz b kb mb gb tb c f k meter meters metre metres"
    " mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres"
).split()

_SEP = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _SEP[_lo:_hi] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[*b".!?:;\n\"|"]] = True
NUMBER, NAME, UNIT = (np.uint64(k) for k in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xCBBB9D5DC1059ED8))


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(range_hash(LOWER[data], ends - np.diff(ends, prepend=0), ends))


_UNITS = _hash_words(UNITS)


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 in lower case for A-Z and the capitals of Latin-1, Greek and Cyrillic; lengths stay the same."""
    out = LOWER[data]
    if len(data) > 1 and data.max() > 127:
        lead, tail = data[:-1], out[1:]
        first = out[:-1]
        latin = (lead == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        near = ((lead == 0xCE) & (tail >= 0x91) & (tail <= 0x9F)) | ((lead == 0xD0) & (tail >= 0x90) & (tail <= 0x9F))
        far = ((lead == 0xCE) & (tail >= 0xA0) & (tail <= 0xA9)) | ((lead == 0xD0) & (tail >= 0xA0) & (tail <= 0xAF))
        tail[latin | near] += 0x20
        tail[far] -= 0x20
        first[far] += 1
    return out


def template(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, value, row, place): token of the first template and own hash of every word, its row and its number in the row."""
    tokens, value, rows, place = templates(data, offs)
    return tokens[0], value, rows, place


def templates(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, value, row, place): the tokens of every word in each of TEMPLATES, its own hash, row and number in the row.

    A word is a run of letters, digits and bytes above 127; one point or comma between two digits belongs to the word.
    Words with a digit are numbers; unit words after a number are units; the names are those of the template.
    """
    starts, ends, rows = word_bounds(data, offs, _SEP)
    if len(starts) > 1:
        gap = np.minimum(ends[:-1], len(data) - 1)
        joined = (starts[1:] - ends[:-1] == 1) & (rows[1:] == rows[:-1]) & ((data[gap] == 44) | (data[gap] == 46)) & _DIGIT[data[ends[:-1] - 1]] & _DIGIT[data[starts[1:]]]
        starts, rows, ends = starts[np.append(True, ~joined)], rows[np.append(True, ~joined)], ends[np.append(~joined, True)]
    value = range_hash(lowered(data), starts, ends)
    if not len(starts):
        return [value] * len(TEMPLATES), value, rows, rows
    digit = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 48) & (data < 58), out=digit[1:])
    number = digit[ends] > digit[starts]
    upper = (data[starts] >= 65) & (data[starts] <= 90)
    new_row = np.ones(len(starts), bool)
    new_row[1:] = rows[1:] != rows[:-1]
    closes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_END[data], out=closes[1:])
    opens = new_row.copy()
    opens[1:] |= closes[starts[1:]] > closes[ends[:-1]]
    second = np.zeros(len(starts), bool)
    inner = np.minimum(starts + 1, len(data) - 1)
    second[:] = (ends - starts > 1) & (((data[inner] >= 97) & (data[inner] <= 122)) | (data[inner] >= 128))
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1] & ~new_row[1:]
    at = np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)
    unit = after & (_UNITS[at] == value)
    tokens = [np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value))) for name in (upper & ~opens & second, np.zeros(len(starts), bool), upper & second)]
    first = np.flatnonzero(new_row)
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    return tokens, value, rows, place


def windows(token: np.ndarray, rows: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of every window of `width` template tokens in a row.

    A row of fewer tokens has one window, over all of them, of another hash.
    """
    n = len(token)
    hashes, at = [], []
    if n >= width:
        m = n - width + 1
        acc = np.zeros(m, np.uint64)
        for k in range(width):
            acc += token[k : k + m] * powers(MULT, width + 1)[k]
        whole = np.flatnonzero(rows[:m] == rows[width - 1 :])
        hashes.append(mix(acc[whole] + np.uint64(width)))
        at.append(whole)
    if n:
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        size = np.diff(np.append(first, n))
        for f, s in zip(first[size < width], size[size < width]):
            hashes.append(mix(np.array([(token[f : f + s] * powers(MULT, width + 1)[:s]).sum(dtype=np.uint64) + np.uint64(s)], np.uint64)))
            at.append(np.array([f]))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(at)


def short_windows(token: np.ndarray, rows: np.ndarray, width: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """windows of `width` tokens, without those of shorter rows."""
    h, at = windows(token, rows, width)
    m = int((rows[: max(len(rows) - width + 1, 0)] == rows[width - 1 :]).sum()) if len(rows) >= width else 0
    return mix(h[:m] + np.uint64(salt) * NAME), at[:m]


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, mode, h, at, values): each window of an item with the word hashes in it.

    mode is the place in TEMPLATES, or the next number for an item that is shorter than a window.
    """
    return _windows(items, key, text, None).withColumnRenamed("key", "item")


def _windows(rows: DataFrame, key: str, text: str, shared) -> DataFrame:
    """The windows of items (`shared` is None), or those of documents that the shared filter and widths let through."""
    kind = rows.schema[key].dataType.simpleString()
    short, names = len(TEMPLATES), ["key", "mode", "h", "at", "values"]

    def drawn(data, offs, widths):
        """(mode, width, hash, first word) of all windows, and the words."""
        tokens, value, of, place = templates(data, offs)
        out, own = [], windows(value, of)[0]
        left = np.bincount(of, minlength=len(offs) - 1)[of] - place
        for m, token in enumerate(tokens):
            h, at = windows(token, of)
            words = np.zeros(len(token) + 1, np.int64)
            np.cumsum((token != NUMBER) & (token != UNIT) & (token != NAME), out=words[1:])
            bare = words[at + np.minimum(WINDOW, left[at])] - words[at] < LEAST_WORDS
            out.append((m, WINDOW, mix(np.where(bare, mix(own ^ UNIT), h) + np.uint64(m) * NUMBER), at))
        plain = tokens[1]
        if widths is None:  # an item's own length, its numbers and units exchangeable if enough literal words are left
            size = np.bincount(of, minlength=len(offs) - 1)
            literal = np.bincount(of, (plain != NUMBER) & (plain != UNIT), len(offs) - 1)
            for w in range(SHORTEST, WINDOW):
                for salt, token, rows_of in ((1, plain, (size == w) & (literal >= LITERAL)), (2, value, (size == w) & (literal < LITERAL))):
                    own = np.flatnonzero(rows_of[of])
                    if len(own):
                        h, at = short_windows(token[own], of[own], w, salt)
                        out.append((short, w, h, own[at]))
        for w in widths or ():
            out += [(short, w, *short_windows(token, of, w, salt)) for salt, token in ((1, plain), (2, value))]
        return out, value, of, place

    def run(batches):
        sieve, widths = (None, None) if shared is None else shared.value
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(1)):
                keys = batch.column(0).slice(lo, hi - lo)
                out, value, of, place = drawn(data, offs, widths)
                for mode, width, h, at in out:
                    if sieve is not None:
                        b = h >> np.uint64(64 - FILTER_BITS)
                        keep = (sieve[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        h, at = h[keep], at[keep]
                    if not len(h):
                        continue
                    span = at[:, None] + np.arange(width)
                    inside = (span < len(of)) & (of[np.minimum(span, len(of) - 1)] == of[at][:, None])
                    bounds = np.concatenate([[0], np.cumsum(inside.sum(1))])
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value[span[inside]].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(of[at])), pa.array(np.full(len(h), mode, np.int32)), pa.array(h.view(np.int64)), pa.array(place[at].astype(np.int64)), lists], names)

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, mode int, h long, at long, values array<long>")


def sieve_of(windows: DataFrame) -> np.ndarray:
    """A bit for each FILTER_BITS-bit prefix of a window hash that some item has; bytes are combined on the executors."""
    place = f"shiftrightunsigned(h, {64 - FILTER_BITS})"
    parts = windows.selectExpr(f"shiftright({place}, 3) AS b", f"shiftleft(1, CAST({place} & 7 AS INT)) AS v").groupBy("b").agg(F.bit_or("v").alias("v"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    got = parts.toPandas()  # at most 2^21 rows
    out[got["b"].to_numpy(int)] = got["v"].to_numpy(np.uint8)
    return out


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(key, item, windows, total, contained, consistent, exact): the items that each document holds.

    contained: the share of the item's distinct template windows found in the document, at least CONTAINED. The figures
    are those of the first template by which the document holds the item.
    consistent: over all words of the found windows, the share in which the item's word is exchanged for its commonest
    counterpart, at least CONSISTENT. exact: the share of words that are the same in both.
    Null or empty texts and items hold nothing; rows with a null key take no part; repeated rows with one key count as
    one document, repeated items each count. Documents with nothing found have no row.
    """
    spark = docs.sparkSession
    known = stored(item_windows(items.where(F.col(item_key).isNotNull()), item_key, item_text))
    widths = sorted(r.w for r in known.where(F.col("mode") == len(TEMPLATES)).select(F.size("values").alias("w")).distinct().collect())  # fewer than WINDOW
    shared = spark.sparkContext.broadcast((sieve_of(known), widths))
    found = _windows(docs.where(F.col(key).isNotNull()), key, text, shared)
    pair = ["key", "item", "mode"]
    sizes = known.groupBy("item", "mode").agg(F.countDistinct("h").alias("of"))
    met = found.join(known.select("item", "mode", "h", F.col("values").alias("own")), ["mode", "h"])
    # a document may hold a window many times: one row for each pair, window and set of values; read twice, so written
    pairs = stored(met.groupBy(*pair, "h", "own", "values").agg(F.lit(1).alias("_one")))
    words = pairs.select(*pair, F.explode(F.arrays_zip("own", "values")).alias("w")).groupBy(*pair, "w.own", "w.values").agg(F.count("*").alias("c"))
    best = words.groupBy(*pair, "own").agg(F.max("c").alias("top"), F.sum("c").alias("all"), F.sum(F.when(F.col("own") == F.col("values"), F.col("c")).otherwise(0)).alias("same"))
    slots = best.groupBy(*pair).agg((F.sum("top") / F.sum("all")).alias("consistent"), (F.sum("same") / F.sum("all")).alias("exact"))
    held = pairs.groupBy(*pair).agg(F.countDistinct("h").alias("windows")).join(sizes, ["item", "mode"]).withColumn("contained", F.col("windows") / F.col("of")).where(F.col("contained") >= CONTAINED)
    done = held.join(slots, pair).where(F.col("consistent") >= CONSISTENT)
    done = done.groupBy("key", "item").agg(F.min(F.struct("mode", "windows", "of", "contained", "consistent", "exact")).alias("b")).select("key", "item", "b.*")
    return done.select(F.col("key").alias(key), F.col("item").alias(item_key), "windows", F.col("of").alias("total"), "contained", "consistent", "exact")


def cleaned(docs: DataFrame, items: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """`docs` without the documents that hold a benchmark item; rows with a null key stay."""
    held = stored(leaks(docs, items, key, **how).select(key).distinct())
    return docs.join(held, key, "left_anti").select(*docs.columns)
