"""Text, name and date functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations of inline images (fixed values of the format).
KEY_ABBREVIATIONS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
VALUE_ABBREVIATIONS = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
RENDERING_INTENTS = ("AbsoluteColorimetric", "RelativeColorimetric", "Saturation", "Perceptual")
COUNTER_STYLES = {"D": "Arabic", "R": "RomanUpper", "r": "RomanLower", "A": "AlphaUpper", "a": "AlphaLower"}


def lookup(c: Column, names: dict[str, str]) -> Column:
    """names[c], or c itself."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(pairs, c), c)


def encode_text(c: Column) -> Column:
    """Printable ASCII as it is, anything else as UTF-16BE behind its mark."""
    return F.when(c.rlike("^[ -~]*$"), F.encode(c, "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(c, "UTF-16BE")))


def decode_text(c: Column) -> Column:
    """The inverse of encode_text; malformed parts become U+FFFD."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        from folioforge.sources.writer import lossy_text

        return s.map(lambda x: None if x is None else lossy_text(bytes(x)))

    return run(c)


def is_integer(c: Column) -> Column:
    return c.rlike("^-?[0-9]+$")


def leading_number(c: Column) -> Column:
    """The numeric head of a lexeme, in single precision; what follows it is cut off, and + is no sign."""
    return F.regexp_extract(c, r"^-?[0-9]*(?:\.[0-9]*)?", 0).try_cast("float")


def parse_date(c: Column) -> Column:
    """struct of D:YYYYMMDDHHmmSSOHH'mm; parts that are absent or no numbers take their default, year is required."""
    head = F.regexp_extract(c, r"^D:([^+\-Z]*)", 1)
    zone = F.regexp_extract(c, r"^D:[^+\-Z]*[+\-Z](.*)$", 1)
    sign = F.regexp_extract(c, r"^D:[^+\-Z]*([+\-Z])", 1)

    def part(s: Column, at: int, size: int, default: int) -> Column:
        digits = F.substring(s, at, size)
        return F.coalesce(F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int")), F.lit(default))

    year = F.substring(head, 1, 4)
    names = (("month", 5, 1), ("day", 7, 1), ("hour", 9, 0), ("minute", 11, 0), ("second", 13, 0))
    return F.when(
        year.rlike("^[0-9]{4}$"),
        F.struct(
            year.cast("int").alias("year"), *[part(head, at, 2, d).alias(n) for n, at, d in names],
            F.when(sign == "+", "Later").when(sign == "-", "Earlier").otherwise("Universal").alias("rel"),
            part(zone, 1, 2, 0).alias("tz_hour"), part(zone, 4, 2, 0).alias("tz_minute"),
        ),
    )


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "'D:'yyyyMMddHHmmss'Z00''00'")


def date_timestamp(d: Column) -> Column:
    """The instant of a parsed date; null where its parts are none."""
    local = F.try_make_timestamp(d["year"], d["month"], d["day"], d["hour"], d["minute"], d["second"].cast("decimal(16,6)"))
    shift = (d["tz_hour"] * 3600 + d["tz_minute"] * 60) * F.when(d["rel"] == "Later", -1).when(d["rel"] == "Earlier", 1).otherwise(0)
    return F.timestamp_seconds(F.unix_micros(local) / 1_000_000 + shift)
