"""Fonts: character maps, widths, glyph tables, and text through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.runs import expanded
from folioforge.sources.syntax import Parser, SyntaxIssue

SUBTYPES = ("Type0", "Type1", "MMType1", "Type3", "TrueType", "CIDFontType0", "CIDFontType2")
BASE_ENCODINGS = ("StandardEncoding", "SymbolEncoding", "MacRomanEncoding", "WinAnsiEncoding", "MacExpertEncoding", "Identity-H", "None")
#: Font flags by bit.
FLAGS = {"FixedPitch": 1, "Serif": 2, "Symbolic": 3, "Script": 4, "Nonsymbolic": 6, "Italic": 7, "AllCap": 17, "SmallCap": 18, "ForceBold": 19}


def parse_cmap(data: bytes) -> dict[int, str]:
    """Codes to text: single entries, ranges from a string (its last byte counts up to 255) and ranges from an array."""
    p, out = Parser(data), {}

    def text(b: bytes) -> str | None:
        try:
            return b.decode("utf-16-be")
        except UnicodeDecodeError:
            return None

    def put(code: int, b: bytes) -> None:
        t = text(b)
        if t is not None:
            out[code] = t

    while (word := p.peek()) and word != b"endcmap":
        if word not in (b"beginbfchar", b"beginbfrange"):
            try:
                p.value()
            except SyntaxIssue:
                p.next()
            continue
        p.next()
        try:
            while p.peek() not in (b"endbfchar", b"endbfrange", b""):
                if word == b"beginbfchar":
                    code, b = p.value(), p.value()
                    put(int.from_bytes(code), b)
                    continue
                lo, hi, to = int.from_bytes(p.value()), int.from_bytes(p.value()), p.value()
                for k, code in enumerate(range(lo, hi + 1)):
                    if isinstance(to, list):
                        if k < len(to):
                            put(code, to[k])
                    elif to and to[-1] + k <= 255:
                        put(code, to[:-1] + bytes([to[-1] + k]))
        except SyntaxIssue:
            break
    return out


def write_cmap(table: dict[int, str]) -> bytes:
    """Single codes as characters, runs of consecutive codes as ranges from arrays."""
    runs: list[list[int]] = []
    for code in sorted(table):
        if runs and runs[-1][-1] + 1 == code:
            runs[-1].append(code)
        else:
            runs.append([code])
    h = lambda t: b"<" + t.encode("utf-16-be").hex().encode() + b">"
    c = lambda n: b"<%04x>" % n
    ones, many = [r[0] for r in runs if len(r) == 1], [r for r in runs if len(r) > 1]
    out = [b"begincmap"]
    if ones:
        out += [b"%d beginbfchar" % len(ones), *[c(k) + b" " + h(table[k]) for k in ones], b"endbfchar"]
    if many:
        out += [b"%d beginbfrange" % len(many), *[c(r[0]) + b" " + c(r[-1]) + b" [" + b" ".join(h(table[k]) for k in r) + b"]" for r in many], b"endbfrange"]
    return b"\n".join([*out, b"endcmap"])


def width_rows(singles: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """(group, cid, width) from single entries (cid, width, ord) and ranges (low, high, width, ord); the last write wins."""
    both = singles.select(*group, "cid", "width", "ord").unionByName(expanded(ranges, "low", "high", "cid").select(*group, "cid", "width", "ord"))
    return both.groupBy(*group, "cid").agg(F.max_by("width", "ord").alias("width"))


def widths_of(codes: DataFrame, widths: DataFrame, keys: list[str], default: float) -> DataFrame:
    return codes.join(widths, keys, "left").withColumn("width", F.coalesce("width", F.lit(default)))


def glyph_ids(table: DataFrame, data: str) -> DataFrame:
    """(…, cid, gid): a big-endian table of 16-bit glyph numbers by cid."""
    at = F.sequence(F.lit(0), F.floor(F.octet_length(data) / 2).cast("int") - 1)
    rows = table.where(F.octet_length(data) >= 2).withColumn("cid", F.explode(at))
    return rows.withColumn("gid", F.conv(F.hex(F.substring(F.col(data), F.col("cid") * 2 + 1, F.lit(2))), 16, 10).cast("int")).drop(data)
