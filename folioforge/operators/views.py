"""Typed records of whole files: every dictionary type of the format as one DataFrame, arrays and nested values included.

A view names where its dictionaries hang (SOURCES) and what their keys are (FIELDS). A value behind a reference is read
through it; a missing key has its default; a wrong value of an optional key is null where the reader is tolerant, and of
a required key an error row. Nothing here recurses along references, and no object is visited twice on one walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import Any

from pyspark.sql import DataFrame

from folioforge.sources.files import FAULTS, File, Options, _flat, code_of
from folioforge.sources.syntax import Name, Ref, Stream, SyntaxIssue, kind_of, serialize

#: Column type of each kind of field.
KINDS = {
    "int": "int", "number": "double", "bool": "boolean", "string": "binary", "bytes": "binary", "name": "string", "ref": "bigint", "refs": "array<bigint>", "numbers": "array<double>",
    "names": "array<string>", "strings": "array<binary>", "keys": "map<string,string>", "text": "string", "rect": "struct<left:double,bottom:double,right:double,top:double>",
    "dest": "struct<page:bigint,view:string,args:array<double>,name:binary>",
}

#: Where the dictionaries of a record hang: `trailer`, a key of another record (its value, or each of a list), with `*`
#: each value of a dictionary, `type:X` all objects of that type, or a walk of its own.
SOURCES = {
    "Trailer": "trailer", "Catalog": "Trailer.Root", "Info": "Trailer.Info", "ViewerPreferences": "Catalog.ViewerPreferences", "NameDictionary": "Catalog.Names", "MarkInformation": "Catalog.MarkInfo",
    "Outlines": "Catalog.Outlines", "OutlineItem": "walk:outline", "InteractiveForm": "Catalog.AcroForm", "StructTreeRoot": "Catalog.StructTreeRoot", "StructElem": "StructTreeRoot.K", "PagesNode": "walk:trees", "Page": "walk:pages",
    "Resources": "Page.Resources", "AdditionalPageActions": "Page.AA", "Annot": "Page.Annots", "AppearanceStreams": "Annot.AP", "AppearanceCharacteristic": "Annot.MK", "Action": "OutlineItem.A Annot.A Catalog.OpenAction",
    "FileSpec": "walk:attachments", "EmbeddedFile": "FileSpec.EF*", "ParamDict": "EmbeddedFile.Params", "PageLabel": "walk:labels", "GraphicsState": "Resources.ExtGState*", "Pattern": "Resources.Pattern*", "XObject": "Resources.XObject*",
    "Image": "Resources.XObject*", "Form": "Resources.XObject*", "PostScript": "Resources.XObject*", "Field": "walk:fields", "AdditionalFormActions": "Field.AA", "Signature": "Field.V", "SeedValue": "Field.SV", "SignatureReference": "Signature.Reference",
    "ObjectStream": "type:ObjStm", "IndexStream": "type:XRef", "StreamInfo": "walk:streams", "Font": "Resources.Font*", "FontDescriptor": "Font.FontDescriptor",
}

#: Keys that tell the records of one source apart.
CHECKS = {"Image": ("Subtype", "Image"), "Form": ("Subtype", "Form"), "PostScript": ("Subtype", "PS"), "Signature": ("Type", "Sig")}

_ACTIONS = "GoTo|Launch|Thread|URI|Sound|Movie|Named|JavaScript|*"
#: Keys of each record: key:kind, `!` required, `=` default; a list of names limits a name, `*` allows others as null.
FIELDS = {
    "Trailer": "Size:int! Prev:int Root:ref! Encrypt:ref Info:ref ID:strings",
    "Catalog": "Version:name Pages:ref! PageLabels:ref Names:ref Dests:ref ViewerPreferences:ref PageLayout:name Outlines:ref OpenAction:ref AcroForm:ref Metadata:ref StructTreeRoot:ref",
    "Info": "Title:string Author:string Subject:string Keywords:string Creator:string Producer:string CreationDate:string ModDate:string Trapped:name(True|False|Unknown)",
    "ViewerPreferences": "HideToolbar:bool HideMenubar:bool HideWindowUI:bool FitWindow:bool CenterWindow:bool DisplayDocTitle:bool NonFullScreenPageMode:name Direction:name ViewArea:name ViewClip:name PrintArea:name PrintClip:name PrintScaling:name Duplex:name PickTrayByPDFSize:bool PrintPageRange:numbers NumCopies:int",
    "NameDictionary": "Pages:ref Dests:ref AP:ref JavaScript:ref Templates:ref IDS:ref URLS:ref EmbeddedFiles:ref",
    "MarkInformation": "Marked:bool UserProperties:bool Suspects:bool",
    "Outlines": "Count:int=0 First:ref Last:ref",
    "OutlineItem": "Title:string Prev:ref Next:ref First:ref Last:ref Count:int=0 Dest:dest A:ref SE:ref C:numbers F:int",
    "InteractiveForm": "Fields:refs! NeedAppearances:bool=false SigFlags:int=0 CO:refs DR:ref DA:string Q:int XFA:text",
    "StructTreeRoot": "K:refs!",
    "StructElem": "S:name! P:ref! ID:string Pg:ref",
    "PagesNode": "Parent:ref Kids:refs! Count:int! Resources:ref MediaBox:rect CropBox:rect Rotate:int",
    "Page": "Parent:ref! Resources:ref MediaBox:rect CropBox:rect TrimBox:rect Contents:refs Rotate:int=0 Metadata:ref LGIDict:text VP:text Annots:refs AA:ref",
    "Resources": "ExtGState:keys ColorSpace:keys Pattern:keys XObject:keys Font:keys Properties:keys",
    "AdditionalPageActions": "O:text C:text", "AdditionalFormActions": "E:text X:text D:text U:text Fo:text Bl:text PO:text PC:text PV:text PI:text",
    "Annot": "Subtype:name! Rect:rect Contents:string P:ref NM:string M:string F:int=0 A:ref AP:ref MK:ref AS:name Border:numbers C:numbers InkList:text L:numbers Parent:ref H:name QuadPoints:numbers",
    "AppearanceStreams": "N:text R:text D:text", "AppearanceCharacteristic": "R:int=0 BC:numbers BG:numbers CA:string RC:string AC:string TP:int=0 I:ref",
    "Action": f"S:name({_ACTIONS})! D:dest URI:string JS:text",
    "FileSpec": "EF:keys F:bytes UF:bytes", "EmbeddedFile": "Subtype:name Params:text", "ParamDict": "Size:int CreationDate:string ModDate:string CheckSum:string",
    "PageLabel": "S:name(D|R|r|A|a) P:string St:int=1",
    "GraphicsState": "LW:number LC:int LJ:int ML:number D:text RI:name OP:bool op:bool OPM:int Font:text BM:text SMask:text CA:number ca:number AIS:bool TK:bool",
    "Pattern": "PaintType:int TilingType:int BBox:rect XStep:number YStep:number Resources:ref Matrix:numbers",
    "XObject": "Subtype:name(Image|Form|PS)!", "PostScript": "Level1:ref",
    "Image": "Width:int! Height:int! ColorSpace:text BitsPerComponent:int Intent:name(AbsoluteColorimetric|RelativeColorimetric|Saturation|Perceptual) ImageMask:bool=false Mask:text Decode:numbers Interpolate:bool=false StructParent:int ID:string SMask:ref",
    "Form": "FormType:int=1 Name:name LastModified:string BBox:rect! Matrix:numbers Resources:ref Group:text Ref:text Metadata:ref PieceInfo:text StructParent:int StructParents:int OPI:text",
    "Field": "FT:name(Btn|Tx|Ch|Sig|SigRef) Parent:ref Kids:refs T:string TU:string TM:string Ff:int=0 V:text DV:text DR:ref AA:ref Rect:rect MaxLen:int Subtype:name",
    "Signature": "Filter:name! SubFilter:name Contents:string ByteRange:numbers Name:string M:string Location:string Reason:string ContactInfo:string V:int", "SeedValue": "Ff:int=0 Filter:name SubFilter:names V:number Reasons:strings",
    "SignatureReference": "TransformMethod:name! DigestMethod:name TransformParams:text",
    "ObjectStream": "N:int! First:int! Extends:ref", "IndexStream": "Size:int! Index:numbers Prev:int W:numbers!", "StreamInfo": "Filter:names DecodeParms:text F:bytes FFilter:names Length:int",
    "Font": "Subtype:name(Type0|Type1|MMType1|Type3|TrueType|CIDFontType0|CIDFontType2)! BaseFont:name FirstChar:int LastChar:int Widths:numbers FontDescriptor:ref Encoding:text ToUnicode:ref DescendantFonts:refs",
    "FontDescriptor": "FontName:name! FontFamily:string FontStretch:name FontWeight:number Flags:int! FontBBox:rect ItalicAngle:number Ascent:number Descent:number Leading:number=0 CapHeight:number XHeight:number=0 StemV:number=0 StemH:number=0 AvgWidth:number=0 MaxWidth:number=0 MissingWidth:number=0 FontFile:ref FontFile2:ref FontFile3:ref CharSet:string",
}


@dataclass(frozen=True)
class Field:
    key: str
    kind: str
    choices: tuple[str, ...] = ()
    default: Any = None
    required: bool = False

    @classmethod
    def parse(cls, text: str) -> Field:
        key, rest = text.split(":", 1)
        rest, _, default = rest.partition("=")
        required, rest = rest.endswith("!"), rest.rstrip("!")
        kind, _, names = rest.partition("(")
        value = {"int": int, "number": float, "bool": lambda v: v == "true"}.get(kind, str)(default) if default else None
        return cls(key, kind, tuple(names.rstrip(")").split("|")) if names else (), value, required)


@cache
def _parsed(keys: str) -> tuple[Field, ...]:
    return tuple(Field.parse(x) for x in keys.split())


def fields(name: str) -> list[Field]:
    return list(_parsed(FIELDS[name]))


def columns(name: str) -> list[str]:
    """Column names: the keys, with a number where two differ in case alone."""
    keys = [f.key for f in fields(name)]
    return [k if k.lower() not in [x.lower() for x in keys[:i]] else f"{k}_{i}" for i, k in enumerate(keys)]


def register(name: str, source: str, keys: str, check: tuple[str, str] | None = None) -> None:
    """Adds a record of one's own; later views may use its name."""
    SOURCES[name], FIELDS[name] = source, keys
    if check:
        CHECKS[name] = check


# Values --------------------------------------------------------------------------------------------------------------


def once(f: File, v: Any) -> Any:
    return f.get(v.id) if isinstance(v, Ref) else v


def shown(v: Any) -> str:
    return f"{v.id} {v.gen} R" if isinstance(v, Ref) else "stream" if isinstance(v, Stream) else serialize(v).decode("latin-1")


def _wrong(v: Any) -> SyntaxIssue:
    return SyntaxIssue("UnexpectedPrimitive", kind_of(v))


def _number(v: Any) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise _wrong(v)
    return float(v)


def _list(f: File, v: Any) -> list:
    v = once(f, v)
    return v if isinstance(v, list) else [v]


def dest(f: File, v: Any, depth: int = 4) -> dict | None:
    """page, view, args of an explicit destination; name of a named one."""
    v = once(f, v)
    if isinstance(v, dict) and depth:
        return dest(f, v.get("D"), depth - 1)
    if isinstance(v, (bytes, Name)):
        return {"page": None, "view": None, "args": None, "name": v if isinstance(v, bytes) else v.encode()}
    if not isinstance(v, list) or not v:
        raise _wrong(v)
    view = once(f, v[1]) if len(v) > 1 else None
    if view not in ("XYZ", "Fit", "FitH", "FitV", "FitR", "FitB", "FitBH"):
        raise SyntaxIssue("UnknownVariant", str(view))
    return {"page": v[0].id if isinstance(v[0], Ref) else None, "view": str(view), "args": [None if (x := once(f, a)) is None else _number(x) for a in v[2:]], "name": None}


def read(f: File, kind: str, choices: tuple[str, ...], raw: Any) -> Any:
    """One value of a kind; a SyntaxIssue where it is another."""
    if kind == "ref":
        return raw.id if isinstance(raw, Ref) else None
    if kind == "refs":
        return [x.id for x in (raw if isinstance(raw, list) else [raw] if isinstance(raw, Ref) and not isinstance(once(f, raw), list) else _list(f, raw)) if isinstance(x, Ref)]
    if kind == "dest":
        return dest(f, raw)
    v = once(f, raw)
    if kind == "text":
        return shown(raw) if isinstance(v, Stream) else shown(v)
    if kind == "int" and isinstance(v, int) and not isinstance(v, bool):
        return v
    if kind == "number":
        return _number(v)
    if kind == "bool" and isinstance(v, bool) or kind == "string" and isinstance(v, bytes):
        return v
    if kind == "bytes" and isinstance(v, (bytes, Name)):
        return v if isinstance(v, bytes) else v.encode()
    if kind == "name" and isinstance(v, Name):
        if choices and v not in choices:
            if "*" in choices:
                return "Other"
            raise SyntaxIssue("UnknownVariant", str(v))
        return str(v)
    if kind == "rect" and isinstance(v, list) and len(v) == 4:
        a, b, c, d = (_number(once(f, x)) for x in v)
        return {"left": min(a, c), "bottom": min(b, d), "right": max(a, c), "top": max(b, d)}
    if kind == "numbers" and isinstance(v, list):
        return [_number(once(f, x)) for x in v]
    if kind == "names" and isinstance(v, (list, Name)):
        return [read(f, "name", (), x) for x in (v if isinstance(v, list) else [v])]
    if kind == "strings" and isinstance(v, list):
        return [read(f, "string", (), x) for x in v]
    if kind == "keys" and isinstance(v, dict):
        return {k: shown(x) for k, x in v.items()}
    raise _wrong(v)


def row_of(f: File, name: str, d: dict, parsed: list[Field]) -> list:
    out = []
    for x in parsed:
        raw = d.get(x.key)
        if raw is None or not x.kind.startswith("ref") and once(f, raw) is None:
            if x.required:
                raise SyntaxIssue("MissingEntry", f"{name}.{x.key}")
            out.append(x.default)
            continue
        try:
            out.append(read(f, x.kind, x.choices, raw))
        except SyntaxIssue:
            if x.required or not f.options.tolerant:
                raise
            out.append(x.default)
    return out


# Walks ---------------------------------------------------------------------------------------------------------------

Found = tuple[int | None, str | None, dict, Any]


def _at(f: File, v: Any, owner: int | None, label: str | None) -> Iterator[Found]:
    obj, v = (v.id, f.get(v.id)) if isinstance(v, Ref) else (owner, v)
    if isinstance(v, Stream):
        yield obj, label, v.info, v
    elif isinstance(v, dict):
        yield obj, label, v, None


def _pages(f: File, leaves: bool) -> Iterator[Found]:
    from folioforge.operators.navigation import _catalog

    todo, seen = [_catalog(f).get("Pages")], set()
    while todo:
        ref = todo.pop()
        if isinstance(ref, Ref):
            if ref.id in seen:
                continue
            seen.add(ref.id)
        for obj, _, d, _ in _at(f, ref, None, None):
            inner = f.resolve(d.get("Type")) == "Pages" or "Kids" in d
            if inner:
                kids = f.resolve(d.get("Kids"))
                todo += reversed(kids if isinstance(kids, list) else [])
            if inner != leaves:
                yield obj, None, d, None


def _chain(f: File, first: Any, down: str, along: str | None) -> Iterator[Found]:
    """Items in reading order: an item, its children below `down`, then its sibling (`along`, or the next of a list)."""
    todo, seen = list(reversed(first if isinstance(first, list) else [first])), set()
    while todo:
        ref = todo.pop()
        if isinstance(ref, Ref):
            if ref.id in seen:
                continue
            seen.add(ref.id)
        for obj, label, d, s in _at(f, ref, None, None):
            yield obj, label, d, s
            if along and d.get(along) is not None:
                todo.append(d[along])
            kids = f.resolve(d.get(down)) if along is None else d.get(down)
            todo += reversed(kids if isinstance(kids, list) else [kids] if kids is not None else [])


def found(f: File, name: str, known: tuple[dict, dict] | None = None) -> Iterator[Found]:
    """(object, key, dictionary, stream) of every dictionary of a record; known: the sources and checks to go by."""
    sources, checks = known or (SOURCES, CHECKS)
    from folioforge.operators.navigation import _catalog, _dict, tree_leaves

    check = checks.get(name)
    for source in sources[name].split():
        if source == "trailer":
            rows: Iterator[Found] = iter([(None, None, f.trailer, None)])
        elif source.startswith("type:"):
            rows = (x for x in _streams(f) if x[2].get("Type") == source[5:])
        elif source.startswith("walk:"):
            walk = source[5:]
            if walk in ("pages", "trees"):
                rows = _pages(f, walk == "pages")
            elif walk == "streams":
                rows = _streams(f)
            elif walk == "outline":
                rows = _chain(f, _dict(f, _catalog(f).get("Outlines")).get("First"), "First", "Next")
            elif walk == "fields":
                rows = _chain(f, f.resolve(_dict(f, _catalog(f).get("AcroForm")).get("Fields")) or [], "Kids", None)
            else:
                tree, key = (_dict(f, _catalog(f).get("Names")).get("EmbeddedFiles"), "Names") if walk == "attachments" else (_catalog(f).get("PageLabels"), "Nums")
                rows = (x for k, v in tree_leaves(f, tree, key) for x in _at(f, v, None, k.decode("utf-8", "replace") if isinstance(k, bytes) else str(k)))
        else:
            owner, key = source.rstrip("*").split(".")
            rows = _below(f, owner, key, source.endswith("*"), known)
        for row in rows:
            if check is None or f.resolve(row[2].get(check[0])) == check[1]:
                yield row


def _below(f: File, owner: str, key: str, each: bool, known: tuple[dict, dict] | None) -> Iterator[Found]:
    for obj, _, d, _ in found(f, owner, known):
        v = d.get(key)
        inner = f.resolve(v)
        if each:
            for k, x in inner.items() if isinstance(inner, dict) else ():
                yield from _at(f, x, obj, k)
        elif isinstance(inner, list):
            for x in inner:
                yield from _at(f, x, obj, None)
        else:
            yield from _at(f, v, obj, None)


def _streams(f: File) -> Iterator[Found]:
    for i, e in sorted(f.table.items()):
        if e.kind != "Free":
            try:
                v = f.get(i)
            except FAULTS:
                continue
            if isinstance(v, Stream):
                yield i, None, v.info, v


def view(files: DataFrame, name: str, options: Options | None = None) -> DataFrame:
    """(file_id, obj, at, one column a key, error_code, error_msg): every dictionary of the record.

    obj: the object that holds it; at: its key where it stands in a dictionary or tree. A dictionary that lacks a
    required key, or has a wrong value there, is an error row.
    """
    parsed, names, known = fields(name), columns(name), (dict(SOURCES), dict(CHECKS))  # executors know no record of one's own

    def rows(file_id, f):
        for obj, at, d, _ in found(f, name, known):
            try:
                yield file_id, obj, at, *row_of(f, name, d, parsed)
            except FAULTS as e:
                yield file_id, obj, at, *[None] * len(parsed), code_of(e), str(e)[:1000]

    return _flat(files, ", ".join(["file_id string", "obj bigint", "at string", *(f"`{c}` {KINDS[x.kind]}" for c, x in zip(names, parsed))]), rows, options or Options())
