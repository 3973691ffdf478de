"""A file for each supplier that holds every record, with values that follow from the row; a query for each record view."""

from __future__ import annotations

from functools import cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.operators import views
from folioforge.plans.registry import query, table
from folioforge.sources.files import Making, spread
from folioforge.sources.syntax import Name, Real, Stream
from folioforge.sources.writer import Builder, built, encoded


@cache
def _salt(record: str, key: str) -> int:
    return sum(map(ord, record + key)) % 7 + 1


#: A value of each kind for row (k, s), s as it stands in files, the salt m of its key, n = k * m and some object.
VALUES = {
    "int": lambda k, s, m, n, some: n % 100, "number": lambda k, s, m, n, some: Real(n % 100 / 4), "bool": lambda k, s, m, n, some: (k + m) % 2 == 0,
    "string": lambda k, s, m, n, some: s, "bytes": lambda k, s, m, n, some: s, "numbers": lambda k, s, m, n, some: [k % 7, m, k % 3],
    "rect": lambda k, s, m, n, some: [k % 50 + 20, m, 5, k % 30 + 50], "names": lambda k, s, m, n, some: [Name("A"), Name(f"B{k % 4}")], "strings": lambda k, s, m, n, some: [s, b"x"],
    "keys": lambda k, s, m, n, some: {"K1": k % 9}, "text": lambda k, s, m, n, some: n % 11, "refs": lambda k, s, m, n, some: [some] * (k % 3 + 1),
    "dest": lambda k, s, m, n, some: [some, Name("XYZ"), k % 100, None, m],
}


@cache
def _keys(record: str) -> tuple[tuple, ...]:
    """(key, salt, whether it is required, names that it chooses from, maker of its value, whether some stand behind a reference) of each field; a reference has no maker."""
    out = []
    for x in views.fields(record):
        m = _salt(record, x.key)
        names = tuple(Name(c) for c in x.choices if c != "*") or tuple(Name(f"N{i}") for i in range(5))
        out.append((x.key, m, x.required, names if x.kind == "name" else None, VALUES.get(x.kind), m % 3 == 0 and x.kind not in ("ref", "refs", "name", "dest")))
    return tuple(out)


def sql(record: str, x: views.Field, column: str) -> str:
    """What `shown` makes of the value, as SQL over supplier."""
    m = _salt(record, x.key)
    n = f"(s_suppkey * {m})"
    if x.kind == "ref":
        return f'true AS "{column}"'
    choices = [c for c in x.choices if c != "*"]
    got = {
        "int": f"({n} % 100)::BIGINT", "number": f"({n} % 100) / 4.0::DOUBLE", "bool": f"(s_suppkey + {m}) % 2 = 0", "string": "s_name", "bytes": "s_name", "name": f"([{', '.join(map(repr, choices))}])[{n} % {len(choices)} + 1]" if choices else f"'N' || {n} % 5",
        "numbers": f"(s_suppkey % 7) || ',{m},' || (s_suppkey % 3)", "rect": f"'5,{m},' || (s_suppkey % 50 + 20) || ',' || (s_suppkey % 30 + 50)", "names": "'A,B' || (s_suppkey % 4)", "strings": "s_name || ',x'", "keys": "'K1=' || (s_suppkey % 9)",
        "text": f"({n} % 11)::VARCHAR", "refs": "(s_suppkey % 3 + 1)::BIGINT", "dest": f"'XYZ,' || (s_suppkey % 100) || ',{m}'",
    }[x.kind]
    if x.required:
        return f'{got} AS "{column}"'
    default = {"int": f"{x.default}::BIGINT", "bool": str(x.default).lower(), "number": f"{x.default}::DOUBLE"}.get(x.kind, f"'{x.default}'") if x.default is not None else "NULL"
    return f'CASE WHEN (s_suppkey + {m}) % 6 = 0 THEN {default} ELSE {got} END AS "{column}"'


def shown(kind: str, c: Column) -> Column:
    whole = lambda a: F.array_join(F.transform(a, lambda v: v.cast("int").cast("string")), ",")
    return {
        "int": lambda: c.cast("long"), "string": lambda: F.decode(c, "UTF-8"), "bytes": lambda: F.decode(c, "UTF-8"), "ref": c.isNotNull, "refs": lambda: F.when(c.isNotNull(), F.size(c)).cast("long"), "numbers": lambda: whole(c),
        "names": lambda: F.array_join(c, ","), "strings": lambda: F.array_join(F.transform(c, lambda v: F.decode(v, "UTF-8")), ","), "keys": lambda: F.concat(F.lit("K1="), F.element_at(c, "K1")),
        "rect": lambda: F.when(c.isNotNull(), whole(F.array(c["left"], c["bottom"], c["right"], c["top"]))), "dest": lambda: F.when(c.isNotNull(), F.concat(c["view"], F.lit(","), whole(c["args"]))),
    }.get(kind, lambda: c)()


def made(b: Builder, record: str, k: int, s: bytes, some: Any, **more: Any) -> dict:
    """The keys of a record for row (k, s), without those that are left out; `sql` says the same of their values."""
    got = {}
    for key, m, required, names, make, apart in _keys(record):
        if not (make or names):
            got[key] = some
        elif not required and (k + m) % 6 == 0:
            if key in more:
                got[key] = None
        elif names:
            got[key] = names[k * m % len(names)]
        else:
            v = make(k, s, m, k * m, some)
            got[key] = b.create(v) if apart else v
    return got | more if more else got


def full_file(k: int, text: str) -> bytes:
    """A file with one dictionary of every record."""
    b, s = Builder(), encoded(text)
    some, tree, page, item = b.create({}), b.promise(), b.promise(), b.promise()
    make = lambda record, **more: made(b, record, k, s, some, **more)
    stream = lambda record, **more: b.create(Stream(make(record, **more), b"data"))
    font = b.create(make("Font", Type=Name("Font"), FontDescriptor=b.create(make("FontDescriptor", Type=Name("FontDescriptor")))))
    held = make("Resources")
    extra = {"ExtGState": ("G", b.create(make("GraphicsState"))), "Pattern": ("P", b.create(make("Pattern"))), "Font": ("F1", font)}
    objects = {"I": stream("Image", Subtype=Name("Image")), "O": stream("Form", Subtype=Name("Form")), "S": stream("PostScript", Subtype=Name("PS"))}
    for key, (at, ref) in extra.items():
        held[key] = (b.changes[held[key].id] if key in held and not isinstance(held[key], dict) else held.get(key, {})) | {at: ref}
    held["XObject"] = (b.changes[held["XObject"].id] if "XObject" in held and not isinstance(held["XObject"], dict) else held.get("XObject", {})) | objects
    note = b.create(make("Annot", AP=b.create(make("AppearanceStreams")), MK=b.create(make("AppearanceCharacteristic")), A=b.create(make("Action"))))
    b.fulfil(page, make("Page", Type=Name("Page"), Parent=tree, Resources=b.create(held), AA=b.create(make("AdditionalPageActions")), Annots=[note]))
    b.fulfil(tree, make("PagesNode", Type=Name("Pages"), Kids=[page]))
    b.fulfil(item, {a: v for a, v in make("OutlineItem").items() if a not in ("Prev", "Next", "First", "Last", "A", "SE")})
    body = b.create(Stream(make("EmbeddedFile", Params=b.create(make("ParamDict"))), b"body"))
    spec = make("FileSpec") | {"EF": {"F": body}}
    sign = b.create(make("Signature", Type=Name("Sig"), Reference=[make("SignatureReference")]))
    field = b.create(make("Field", V=sign, SV=b.create(make("SeedValue")), AA=b.create(make("AdditionalFormActions")), Kids=[]))
    names = make("NameDictionary", EmbeddedFiles=b.create({"Names": [b"a", spec]}))
    root = b.create(make(
        "Catalog", Type=Name("Catalog"), Pages=tree, Names=b.create(names), PageLabels=b.create({"Nums": [0, make("PageLabel")]}), ViewerPreferences=b.create(make("ViewerPreferences")), MarkInfo=b.create(make("MarkInformation")),
        Outlines=b.create(make("Outlines", First=item, Last=item)), AcroForm=b.create(make("InteractiveForm", Fields=[field])), StructTreeRoot=b.create({"K": [b.create(make("StructElem"))]}), OpenAction=some,
    ))
    return b.save({"Root": root, "Info": b.create(make("Info")), "ID": [s, b"x"]})


def full_files(spark, d) -> Making:
    return built(spread(table(spark, d, "supplier").select("s_suppkey", "s_name"), light=True), full_file)


#: Columns that the file above settles in another way than `value` does: what they hold in SQL.
OWN = {
    "OutlineItem": {k: "false" for k in ("Prev", "Next", "First", "Last", "A", "SE")}, "InteractiveForm": {"Fields": "1::BIGINT"}, "StructTreeRoot": {"K": "1::BIGINT"}, "PagesNode": {"Kids": "1::BIGINT"}, "Page": {"Annots": "1::BIGINT"},
    "Field": {"V": None, "Kids": "0::BIGINT"}, "EmbeddedFile": {"Params": None}, "FileSpec": {"EF": None}, "Resources": {}, "XObject": {"Subtype": None},
}
#: Records that other parts of the file, or tests, stand for.
SKIPPED = ("Trailer", "XObject", "ObjectStream", "IndexStream", "StreamInfo")


def _register(record: str) -> None:
    own, pairs = OWN.get(record, {}), list(zip(views.columns(record), views.fields(record)))
    kept = [(c, x) for c, x in pairs if own.get(x.key, "") is not None]
    selected = ", ".join(["s_suppkey::VARCHAR AS file_id", *(f'{own[x.key]} AS "{c}"' if x.key in own else sql(record, x, c) for c, x in kept)])

    def run(spark, d):
        got = views.view(full_files(spark, d), record).where("error_code IS NULL")
        return got.select("file_id", *[shown(x.kind, F.col(f"`{c}`")).alias(c) for c, x in kept])

    run.__name__ = f"view_{record.lower()}"
    query(f"SELECT {selected} FROM supplier")(run)


for _record in views.FIELDS:
    if _record not in SKIPPED:
        _register(_record)


@query("SELECT s_suppkey::VARCHAR AS file_id, 'Image' AS subtype, 'I' AS name FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 'Form', 'O' FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 'PS', 'S' FROM supplier")
def view_xobject(spark, d):
    got = views.view(full_files(spark, d), "XObject").where("at <> 'K1'")
    return got.select("file_id", F.col("Subtype").alias("subtype"), F.col("at").alias("name"))


@query("SELECT s_suppkey::VARCHAR AS file_id, s_name || ',x' AS ids, true AS root, true AS info FROM supplier")
def view_trailer(spark, d):
    got = views.view(full_files(spark, d), "Trailer")
    return got.select("file_id", shown("strings", F.col("ID")).alias("ids"), F.col("Root").isNotNull().alias("root"), F.col("Info").isNotNull().alias("info"))
