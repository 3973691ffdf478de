"""What pages use: fonts, embedded functions, colour spaces and images of whole files, and names resolved to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import codecs
from folioforge.functions.numeric import StackError
from folioforge.operators.fonts import BASE_ENCODINGS, SUBTYPES, parse_cmap
from folioforge.operators.views import _at, found, once, shown
from folioforge.sources.files import FAULTS, File, Options, _flat, code_of
from folioforge.sources.syntax import Name, Ref, Stream, SyntaxIssue, kind_of

# Fonts ---------------------------------------------------------------------------------------------------------------

CID_SUBTYPES = ("Type0", "CIDFontType0", "CIDFontType2")


def _dict(f: File, v: Any) -> dict:
    v = f.resolve(v)
    return v.info if isinstance(v, Stream) else v if isinstance(v, dict) else {}


def _numbers(f: File, v: Any) -> list[float]:
    v = f.resolve(v)
    if v is None:
        return []
    if not isinstance(v, list):
        raise SyntaxIssue("UnexpectedPrimitive", kind_of(v))
    out = [f.resolve(x) for x in v]
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in out):
        raise SyntaxIssue("UnexpectedPrimitive", "a number is needed")
    return [float(x) for x in out]


def widths(f: File, font: dict, depth: int = 4) -> tuple[float, dict[int, float]] | None:
    """(default, widths by code): a table from FirstChar on, or the runs of a font by numbers; a composite font has its
    descendant's. None where a simple font has no FirstChar."""
    kind = f.resolve(font.get("Subtype"))
    if kind == "Type0":
        below = f.resolve(font.get("DescendantFonts"))
        return widths(f, _dict(f, below[0]), depth - 1) if isinstance(below, list) and below and depth else None
    if kind in CID_SUBTYPES:
        default = f.resolve(font.get("DW"))
        out: dict[int, float] = {}
        items = f.resolve(font.get("W"))
        items, at = [f.resolve(x) for x in items] if isinstance(items, list) else [], 0
        while at + 1 < len(items):
            first, second = items[at], items[at + 1]
            if isinstance(second, list):
                out |= {first + i: w for i, w in enumerate(_numbers(f, second))}
                at += 2
            else:
                if at + 2 >= len(items) or second - first > 65_535:
                    raise SyntaxIssue("UnexpectedPrimitive", "W")
                out |= dict.fromkeys(range(first, second + 1), float(items[at + 2]))
                at += 3
        return float(default) if isinstance(default, (int, float)) else 1000.0, out
    first = f.resolve(font.get("FirstChar"))
    return (0.0, {first + i: w for i, w in enumerate(_numbers(f, font.get("Widths")))}) if isinstance(first, int) else None


def encoding(f: File, font: dict) -> tuple[str | None, dict[int, str]]:
    """(base, names by code): a named encoding, or a dictionary with differences from its base."""
    v = f.resolve(font.get("Encoding"))
    base, out, code = v, {}, 0
    if isinstance(v, dict):
        base = f.resolve(v.get("BaseEncoding"))
        for x in f.resolve(v.get("Differences")) or []:
            x = f.resolve(x)
            if isinstance(x, Name):
                out[code] = str(x)
                code += 1
            elif isinstance(x, int):
                code = x
            else:
                raise SyntaxIssue("UnexpectedPrimitive", kind_of(x))
    if base is None:
        return None, out
    return (str(base) if base in BASE_ENCODINGS else "Other"), out


def font_row(f: File, d: dict) -> tuple:
    kind = f.resolve(d.get("Subtype"))
    if kind not in SUBTYPES:
        raise SyntaxIssue("UnknownVariant", str(kind))
    name = f.resolve(d.get("BaseFont"))
    if f.resolve(d.get("Type")) != "Font" or name is None and kind != "Type3":
        raise SyntaxIssue("MissingEntry", "Type or BaseFont")
    own = _dict(f, (f.resolve(d.get("DescendantFonts")) or [None])[0]) if kind == "Type0" else d
    base, names = encoding(f, d)
    wide, table = widths(f, d), _dict(f, own.get("FontDescriptor"))
    data = next((f.decoded(s) for k in ("FontFile", "FontFile2", "FontFile3") if isinstance(s := f.resolve(table.get(k)), Stream)), None)
    cmap, gids = f.resolve(d.get("ToUnicode")), f.resolve(own.get("CIDToGIDMap"))
    raw = f.decoded(gids) if isinstance(gids, Stream) else b""
    glyphs = np.frombuffer(raw[: len(raw) // 2 * 2], ">u2").tolist() if raw else None
    return (
        str(kind), None if name is None else str(name), kind in CID_SUBTYPES, base, list(names.items()), wide[0] if wide else None, list(wide[1].items()) if wide else None,
        list(parse_cmap(f.decoded(cmap)).items()) if isinstance(cmap, Stream) else None, glyphs, data,
    )


FONT = "subtype string, base_font string, is_cid boolean, encoding string, differences map<int,string>, default_width double, widths map<int,double>, to_unicode map<int,string>, glyphs array<int>, data binary"


def fonts(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, obj, at, FONT columns): the fonts of all pages' resources by name; one that is none is an error row."""

    def rows(file_id, f):
        for obj, at, d, _ in found(f, "Font"):
            try:
                yield file_id, obj, at, *font_row(f, d)
            except FAULTS as e:
                yield file_id, obj, at, *[None] * 10, code_of(e), str(e)[:1000]

    return _flat(files, f"file_id string, obj bigint, at string, {FONT}", rows, options or Options())


def standard(name: str) -> dict[str, Any]:
    """A font that every reader has."""
    return {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name(name), "Encoding": Name("StandardEncoding")}


def unicode_of(codes: DataFrame, fonts: DataFrame, code: str = "code") -> DataFrame:
    """rows (file_id, at, code) with `text`, what the font's map makes of the code; null where it has none."""
    table = fonts.where("to_unicode IS NOT NULL").select("file_id", "at", F.explode("to_unicode").alias(code, "text"))
    return codes.join(table, ["file_id", "at", code], "left")


# Functions -----------------------------------------------------------------------------------------------------------


def _pairs(v: list[float]) -> list[tuple[float, float]]:
    return list(zip(v[::2], v[1::2]))


def _clip(x: float, lo: float, hi: float) -> float:
    return max(min(x, hi), lo)


def _stack(source: bytes) -> Callable[[list[float]], list[float]]:
    body = source[source.index(b"{") + 1 : source.rindex(b"}")].split()

    def run(args: list[float]) -> list[float]:
        s = list(args)
        for w in body:
            try:
                if w in (b"add", b"sub", b"mul"):
                    b, a = s.pop(), s.pop()
                    s.append(a + b if w == b"add" else a - b if w == b"sub" else a * b)
                elif w == b"abs":
                    s.append(abs(s.pop()))
                elif w == b"dup":
                    s.append(s[-1])
                elif w == b"exch":
                    s[-2:] = [s[-1], s[-2]]
                elif w == b"pop":
                    s.pop()
                elif w == b"cvr":
                    s[-1] = float(s[-1])
                elif w == b"index":
                    n = int(s.pop())
                    if n < 0:
                        raise StackError("StackUnderflow")
                    s.append(s[-1 - n])
                elif w == b"roll":
                    j, n = int(s.pop()), int(s.pop())
                    if not 0 <= n <= len(s):
                        raise StackError("StackUnderflow")
                    if n:
                        top = s[-n:]
                        s[-n:] = top[n - j % n :] + top[: n - j % n]
                else:
                    s.append(float(w))
            except IndexError:
                raise StackError("StackUnderflow") from None
        return s

    return run


def function(f: File, v: Any, depth: int = 8) -> Callable[[list[float]], list[float]]:
    """The function that a dictionary or stream states, over lists of numbers: sampled, exponential, stitching, or a program."""
    v = f.resolve(v)
    d = v.info if isinstance(v, Stream) else v
    if not isinstance(d, dict) or not depth:
        raise SyntaxIssue("UnexpectedPrimitive", kind_of(v))
    kind, domain, bounds = f.resolve(d.get("FunctionType")), _pairs(_numbers(f, d.get("Domain"))), _pairs(_numbers(f, d.get("Range")))
    if not domain:
        raise SyntaxIssue("MissingEntry", "Domain")
    if kind == 2:
        c0, c1, n = _numbers(f, d.get("C0")) or [0.0], _numbers(f, d.get("C1")) or [1.0], float(f.resolve(d.get("N")))

        def exponential(x: list[float]) -> list[float]:
            out = [a + x[0] ** n * (b - a) for a, b in zip(c0, c1)]
            return [_clip(y, *r) for y, r in zip(out, bounds)] if bounds else out

        return exponential
    if kind == 3:
        parts = [function(f, p, depth - 1) for p in f.resolve(d.get("Functions"))]
        edges, encode = [domain[0][0], *_numbers(f, d.get("Bounds")), domain[0][1]], _pairs(_numbers(f, d.get("Encode")))
        if len(edges) != len(parts) + 1 or len(encode) != len(parts):
            raise SyntaxIssue("UnexpectedPrimitive", "Bounds")

        def stitching(x: list[float]) -> list[float]:
            t = _clip(x[0], *domain[0])
            k = next((i for i in range(len(parts) - 1) if t < edges[i + 1]), len(parts) - 1)
            (e0, e1), lo, hi = encode[k], edges[k], edges[k + 1]
            return parts[k]([e0 if hi == lo else e0 + (t - lo) * (e1 - e0) / (hi - lo)])

        return stitching
    if not isinstance(v, Stream):
        raise SyntaxIssue("UnsupportedFunctionType", str(kind))
    data = f.decoded(v)
    if kind == 4:
        run = _stack(data)

        def program(x: list[float]) -> list[float]:
            out = run(x)
            if len(out) != len(bounds):
                raise StackError(f"{len(out)} values for {len(bounds)} outputs")
            return out

        return program
    if kind != 0:
        raise SyntaxIssue("UnsupportedFunctionType", str(kind))
    size, outs = [int(n) for n in _numbers(f, d.get("Size"))], len(bounds)
    encode = _pairs(_numbers(f, d.get("Encode"))) or [(0.0, n - 1.0) for n in size]
    decode = _pairs(_numbers(f, d.get("Decode"))) or bounds
    if not 1 <= len(size) <= 3 or int(f.resolve(d.get("Order")) or 1) != 1:
        raise SyntaxIssue("UnsupportedFunctionType", "sampled")

    def sampled(x: list[float]) -> list[float]:
        """Multilinear between the samples around the place; samples outside the table count as 0."""
        place = [_clip(v, *r) * e[1] + e[0] for v, r, e in zip(x, domain, encode)]
        low, out = [int(np.floor(p)) for p in place], []
        for j in range(outs):
            total = 0.0
            for corner in range(1 << len(size)):
                weight, at, step, inside = 1.0, 0, 1, True
                for i, p in enumerate(place):
                    up = corner >> i & 1
                    weight *= p - low[i] if up else 1 - (p - low[i])
                    inside &= 0 <= low[i] + up < size[i]
                    at, step = at + (low[i] + up) * step, step * size[i]
                if inside and weight and at * outs + j < len(data):
                    total += weight * data[at * outs + j]
            out.append(total / 255 * (decode[j][1] - decode[j][0]) + decode[j][0])
        return out

    return sampled


# Colour spaces -------------------------------------------------------------------------------------------------------

COLOUR = "kind string, base string, components int, hival int, lookup binary, names array<string>, params string"
_SIZES = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4, "CalGray": 1, "CalRGB": 3, "CalCMYK": 4, "Lab": 3}


def colour_space(f: File, v: Any, depth: int = 5) -> tuple:
    """kind, base or alternate, components, highest index, table, names of inks, parameters."""
    v = f.resolve(v)
    if not depth:
        raise SyntaxIssue("Recursion", "colour space")
    if isinstance(v, Name):
        return (str(v) if v in _SIZES or v == "Pattern" else "Named", None if v in _SIZES or v == "Pattern" else str(v), _SIZES.get(v), None, None, None, None)
    if not isinstance(v, list) or not v or not isinstance(kind := f.resolve(v[0]), Name):
        raise SyntaxIssue("UnexpectedPrimitive", kind_of(v))
    if kind == "Indexed":
        base, table = colour_space(f, v[1], depth - 1), f.resolve(v[3])
        data = f.decoded(table) if isinstance(table, Stream) else table
        if not isinstance(data, bytes):
            raise SyntaxIssue("UnexpectedPrimitive", kind_of(table))
        return "Indexed", base[0], base[2], f.resolve(v[2]), data, None, None
    if kind in ("Separation", "DeviceN"):
        inks = f.resolve(v[1])
        names = [str(f.resolve(x)) for x in (inks if isinstance(inks, list) else [inks])]
        return str(kind), colour_space(f, v[2], depth - 1)[0], len(names), None, None, names, None
    if kind == "ICCBased":
        info = _dict(f, v[1])
        other = info.get("Alternate")
        return "ICCBased", None if other is None else colour_space(f, other, depth - 1)[0], f.resolve(info.get("N")), None, None, None, None
    if kind in _SIZES:
        return str(kind), None, _SIZES[kind], None, None, None, shown(f.resolve(v[1])) if len(v) > 1 else None
    if kind == "Pattern":
        return "Pattern", colour_space(f, v[1], depth - 1)[0] if len(v) > 1 else None, None, None, None, None, None
    return "Other", str(kind), None, None, None, None, None


def colour_spaces(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, at, COLOUR columns): the colour spaces of all pages' resources by name."""

    def rows(file_id, f):
        for _, _, d, _ in found(f, "Resources"):
            for at, v in _dict(f, d.get("ColorSpace")).items():
                try:
                    yield file_id, at, *colour_space(f, v)
                except FAULTS as e:
                    yield file_id, at, *[None] * 7, code_of(e), str(e)[:1000]

    return _flat(files, f"file_id string, at string, {COLOUR}", rows, options or Options())


def indexed_colour(index, spaces_lookup, components):
    """The bytes of an index in the table of an Indexed colour space."""
    return F.substring(spaces_lookup, (index * components + 1).cast("int"), components)


# Images --------------------------------------------------------------------------------------------------------------

#: Filters whose output is an image, with the ending of a file that holds their data.
IMAGE_FILTERS = {"DCTDecode": "jpg", "JPXDecode": "jp2", "JBIG2Decode": "jbig2", "CCITTFaxDecode": "tif", "FlateDecode": "bin"}


def raw_image(f: File, s: Stream) -> tuple[bytes, str | None]:
    """The data as it is before the last filter, if that one makes an image, and that filter's name."""
    chain = f.filters(s.info)
    last = chain[-1][0] if chain and chain[-1][0] in IMAGE_FILTERS else None
    return codecs.decode_chain(s.data, chain[:-1] if last else chain, f.options.limit), last


def image_bytes(f: File, s: Stream) -> bytes:
    """Decoded samples; bits are inverted where Decode runs from 1 to 0 at one bit a component."""
    data = f.decoded(s)
    if f.resolve(s.info.get("BitsPerComponent")) == 1 and _numbers(f, s.info.get("Decode")) == [1.0, 0.0]:
        data = codecs.inverted_bits(data)
    return data


def images(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, obj, at, width, height, bits, space, filter, ext, raw, data): images of all pages' resources; `raw` can be
    saved as a file with the ending `ext`. An image that can't be decoded is an error row that keeps `raw`."""

    def rows(file_id, f):
        for obj, at, d, s in found(f, "Image"):
            head = file_id, obj, at, *(f.resolve(d.get(k)) for k in ("Width", "Height", "BitsPerComponent")), shown(d["ColorSpace"]) if "ColorSpace" in d else None
            try:
                raw, last = raw_image(f, s)
            except FAULTS as e:
                yield *head, None, None, None, None, code_of(e), str(e)[:1000]
                continue
            try:
                yield *head, last, IMAGE_FILTERS.get(last or "", "bin"), raw, image_bytes(f, s)
            except FAULTS as e:
                yield *head, last, IMAGE_FILTERS.get(last or "", "bin"), raw, None, code_of(e), str(e)[:1000]

    return _flat(files, "file_id string, obj bigint, at string, width int, height int, bits int, space string, filter string, ext string, raw binary, data binary", rows, options or Options())


# Contents and names ---------------------------------------------------------------------------------------------------


def page_content(f: File, page: dict) -> bytes:
    """The parts of a page's content one after another, with nothing between them."""
    v = f.resolve(page.get("Contents"))
    parts = [f.resolve(x) for x in v] if isinstance(v, list) else [v]
    return b"".join(f.decoded(s) for s in parts if isinstance(s, Stream))


def page_contents(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, page, obj, parts, decoded): the whole content of every page; page counts from 0."""

    def rows(file_id, f):
        for at, (obj, _, d, _) in enumerate(found(f, "Page")):
            v = f.resolve(d.get("Contents"))
            yield file_id, at, obj, len(v) if isinstance(v, list) else int(v is not None), page_content(f, d)

    return _flat(files, "file_id string, page int, obj bigint, parts int, decoded binary", rows, options or Options())


def page_resources(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, page, category, name, ref_id): what a page's resources, or those of the nearest ancestor, name."""

    def rows(file_id, f):
        for at, (_, _, d, _) in enumerate(found(f, "Page")):
            for category, held in inherited(f, d, "Resources").items():
                for name, v in _dict(f, held).items():
                    yield file_id, at, category, name, v.id if isinstance(v, Ref) else None

    return _flat(files, "file_id string, page int, category string, name string, ref_id bigint", rows, options or Options())


def inherited(f: File, page: dict, key: str, depth: int = 16) -> Any:
    """A page's value, or that of the nearest ancestor that has it; an empty dictionary where none has."""
    while depth and key not in page and "Parent" in page:
        page, depth = _dict(f, page["Parent"]), depth - 1
    v = f.resolve(page.get(key))
    return {} if v is None else v


#: The resource category that an instruction's name belongs to.
CATEGORIES = {"TextFont": "Font", "XObject": "XObject", "GraphicsState": "ExtGState", "StrokeColorSpace": "ColorSpace", "FillColorSpace": "ColorSpace", "Shade": "Shading"}


def named_resources(ops: DataFrame, resources: DataFrame) -> DataFrame:
    """Instructions (file_id, page, ord, variant, name) with the resource that their name stands for; null where it has none."""
    pairs = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    asked = ops.withColumn("category", pairs[F.col("variant")]).where("category IS NOT NULL AND name IS NOT NULL")
    return asked.join(resources, ["file_id", "page", "category", "name"], "left")
