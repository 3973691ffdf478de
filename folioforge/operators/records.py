"""Typed views: a record schema compiled to one pivot over the nodes table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a field reads its node, by type.
READS = {
    "int": "CASE WHEN kind = 'Integer' THEN i END", "number": "coalesce(CAST(i AS FLOAT), n)", "bool": "CASE WHEN kind = 'Boolean' THEN b END", "string": "CASE WHEN kind = 'String' THEN s END",
    "name": "CASE WHEN kind = 'Name' THEN name END", "ref": "CASE WHEN kind = 'Reference' THEN ref_id END", "bytes": "coalesce(encode(name, 'UTF-8'), s)",
}
CASTS = {"int": "int", "number": "float", "bool": "boolean", "string": "binary", "name": "string", "ref": "bigint", "bytes": "binary"}


@dataclass(frozen=True)
class Field:
    key: str
    type: str
    default: object = None
    required: bool = False


@dataclass(frozen=True)
class Record:
    """type: the /Type an object must have (with `?`: may lack); checks: other keys with fixed names."""

    name: str
    fields: tuple[Field, ...]
    type: str = ""
    checks: dict[str, str] = field(default_factory=dict)


def _fields(text: str) -> tuple[Field, ...]:
    return tuple(Field(*p.split(":")) for p in text.split())


#: The dictionary records with a view (README names the missing ones): name -> (type check, other checks, key:type ...). Nested values keep their reference.
RECORDS = {r.name: r for r in (
    Record("Catalog", _fields("Version:name Pages:ref PageLabels:ref Names:ref Dests:ref PageLayout:name Outlines:ref AcroForm:ref Metadata:ref StructTreeRoot:ref"), "Catalog?"),
    Record("Pages", _fields("Parent:ref Count:int Resources:ref Rotate:int"), "Pages"),
    Record("Page", _fields("Parent:ref Resources:ref Contents:ref Rotate:int Metadata:ref"), "Page"),
    Record("Info", _fields("Title:string Author:string Subject:string Keywords:string Creator:string Producer:string CreationDate:string ModDate:string Trapped:name")),
    Record("ViewerPreferences", _fields("HideToolbar:bool HideMenubar:bool HideWindowUI:bool FitWindow:bool CenterWindow:bool DisplayDocTitle:bool NonFullScreenPageMode:name Direction:name ViewArea:name ViewClip:name PrintArea:name PrintClip:name PrintScaling:name Duplex:name PickTrayByPDFSize:bool NumCopies:int")),
    Record("Outlines", _fields("Count:int First:ref Last:ref"), "Outlines?"),
    Record("OutlineItem", _fields("Title:string Prev:ref Next:ref First:ref Last:ref Count:int F:int")),
    Record("Action", _fields("S:name URI:string JS:string D:bytes")),
    Record("FileSpec", _fields("F:bytes UF:bytes EF:ref")),
    Record("EmbeddedFile", _fields("Subtype:name"), "EmbeddedFile?"),
    Record("MarkInformation", _fields("Marked:bool UserProperties:bool Suspects:bool")),
    Record("PageLabel", _fields("S:name P:string St:int")),
    Record("StructTreeRoot", _fields("K:ref"), "StructTreeRoot"),
    Record("StructElem", _fields("S:name P:ref ID:string Pg:ref"), "StructElem?"),
    Record("GraphicsState", _fields("LW:number LC:int LJ:int ML:number RI:name OP:bool op:bool OPM:int CA:number ca:number AIS:bool TK:bool"), "ExtGState?"),
    Record("Pattern", _fields("PaintType:int TilingType:int XStep:number YStep:number")),
    Record("Image", _fields("Width:int Height:int BitsPerComponent:int Intent:name ImageMask:bool Interpolate:bool StructParent:int ID:string SMask:ref"), "XObject?", {"Subtype": "Image"}),
    Record("Form", _fields("FormType:int Name:name LastModified:string Metadata:ref StructParent:int StructParents:int"), "XObject?", {"Subtype": "Form"}),
    Record("InteractiveForm", _fields("NeedAppearances:bool SigFlags:int DA:string Q:int")),
    Record("Field", _fields("FT:name Parent:ref T:string TU:string TM:string Ff:int V:bytes DV:bytes MaxLen:int")),
    Record("Annot", _fields("Subtype:name Contents:string P:ref NM:string M:string F:int AS:name"), "Annot?"),
    Record("Signature", _fields("Filter:name SubFilter:name Contents:string Name:string M:string Location:string Reason:string ContactInfo:string V:int"), "Sig?"),
    Record("SeedValue", _fields("Ff:int Filter:name V:number")),
    Record("SignatureReference", _fields("TransformMethod:name DigestMethod:name"), "SigRef?"),
    Record("Font", _fields("Subtype:name BaseFont:name FirstChar:int LastChar:int FontDescriptor:ref ToUnicode:ref"), "Font"),
    Record("FontDescriptor", _fields("FontName:name FontFamily:string FontStretch:name FontWeight:number Flags:int ItalicAngle:number Ascent:number Descent:number Leading:number CapHeight:number XHeight:number StemV:number StemH:number AvgWidth:number MaxWidth:number MissingWidth:number FontFile:ref FontFile2:ref FontFile3:ref"), "FontDescriptor"),
    Record("ObjectStream", _fields("N:int First:int Extends:ref"), "ObjStm"),
    Record("IndexStream", _fields("Size:int Prev:int"), "XRef"),
)}


def register(record: Record) -> Record:
    """Adds a record of one's own; later views may use its name."""
    RECORDS[record.name] = record
    return record


def value(f: Field, key: Column, top: Column) -> Column:
    return F.max(F.when(top & (key == f.key), F.expr(READS[f.type])))


def view(nodes: DataFrame, name: str, rest: bool = False) -> DataFrame:
    """(file_id, obj, one column a field[, _rest]) of the objects that pass the record's checks.

    One aggregation over nodes: keys become columns, a missing key its default; an object that lacks a required field
    drops out. rest: the kinds of all other keys as a map.
    """
    r = RECORDS[name]
    top, key = F.col("parent") == 0, F.col("key")
    found = nodes.where("error_code IS NULL").groupBy("file_id", "obj").agg(
        F.max(F.when(F.col("node") == 0, F.col("kind"))).alias("_kind"), value(Field("Type", "name"), key, top).alias("_type"),
        *[value(Field(k, "name"), key, top).alias(f"_check_{k}") for k in r.checks], *[value(f, key, top).alias(f"_f{i}") for i, f in enumerate(r.fields)],
        *([F.map_from_entries(F.collect_list(F.when(top & ~key.isin(*[f.key for f in r.fields], "Type", *r.checks), F.struct("key", "kind")))).alias("_rest")] if rest else []),
    )
    found = found.where(F.col("_kind").isin("Dictionary", "Stream"))
    if r.type:
        fits = F.col("_type") == r.type.rstrip("?")
        found = found.where(fits | F.col("_type").isNull() if r.type.endswith("?") else fits)
    for k, v in r.checks.items():
        found = found.where(F.col(f"_check_{k}") == v)
    for i, f in enumerate(r.fields):
        if f.required:
            found = found.where(F.col(f"_f{i}").isNotNull())
    return found.select("file_id", "obj", *[F.coalesce(F.col(f"_f{i}").cast(CASTS[f.type]), F.lit(f.default).cast(CASTS[f.type])).alias(f.key if f.key.lower() not in [g.key.lower() for g in r.fields[:i]] else f"{f.key}_{i}") for i, f in enumerate(r.fields)], *(["_rest"] if rest else []))
