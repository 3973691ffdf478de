"""Objects across files: pages copied with what they use, structures compared, values updated by path; form data files."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame

from folioforge.operators.content import parse_ops
from folioforge.operators.navigation import _catalog, _dict, tree_leaves
from folioforge.operators.resources import CATEGORIES, inherited, page_content
from folioforge.operators.views import found
from folioforge.sources.files import FAULTS, File, Making, Options, _flat, _rows, code_of
from folioforge.sources.syntax import Name, Parser, Ref, Stream, SyntaxIssue, kind_of
from folioforge.sources.writer import Builder, imported, lossy_text

# Pages ---------------------------------------------------------------------------------------------------------------

#: What a page takes over from its ancestors when it is copied.
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


def standalone(f: File, page: dict) -> dict:
    """A page with its inherited values in place and without its parent."""
    own = {}
    for k in INHERITED:
        v = page[k] if k in page else inherited(f, page, k)
        if v != {}:
            own[k] = v
    return {k: v for k, v in page.items() if k != "Parent"} | own


def used_names(f: File, page: dict) -> dict[str, set[str]]:
    """The names that a page's instructions use, by resource category."""
    out: dict[str, set[str]] = {}
    for _, variant, _, name, _, _ in parse_ops(page_content(f, page)):
        if name is not None and variant in CATEGORIES:
            out.setdefault(CATEGORIES[variant], set()).add(name)
    return out


def cloned_page(f: File, page: dict, into: Builder, parent: Ref, used: tuple[str, ...] | None = None) -> Ref:
    """A copy of a page in another file: its inherited values, and all that it refers to.

    used: only these resource categories come along, and of them only what the page's instructions name.
    """
    whole = standalone(f, page)
    if used is not None:
        names = used_names(f, page)
        held = _dict(f, whole.get("Resources"))
        whole["Resources"] = {c: {k: v for k, v in _dict(f, held[c]).items() if k in names.get(c, ())} for c in used if c in held}
    known = imported(_WithPage(f, whole), [Ref(-1)], into)
    into.changes[known[-1].id] |= {"Parent": parent}
    return known[-1]


class _WithPage:
    """A file seen with one more object, number -1."""

    def __init__(self, f: File, page: dict):
        self.f, self.page = f, page

    def get(self, number: int) -> Any:
        return self.page if number == -1 else self.f.get(number)


def document_of(pages: list[tuple[File, dict]], used: tuple[str, ...] | None = None) -> bytes:
    """A new file of copied pages."""
    b = Builder()
    tree = b.promise()
    kids = [cloned_page(f, p, b, tree, used) for f, p in pages]
    b.fulfil(tree, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})
    return b.save({"Root": b.create({"Type": Name("Catalog"), "Version": Name("1.7"), "Pages": tree})})


# Comparison ----------------------------------------------------------------------------------------------------------


def same(f: File, a: Any, g: File, b: Any, skip: tuple[str, ...] = ()) -> bool:
    """Whether two values are equal up to the numbers of the objects they refer to.

    A reference in one file stands for one in the other throughout; integers and reals compare by value, a reference on
    one side alone is followed, streams compare their dictionaries and raw bytes. A list of work, so any depth is fine.
    """
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if isinstance(x, Ref) and isinstance(y, Ref):
            if x.id in there or y.id in back:
                if there.get(x.id) != y.id or back.get(y.id) != x.id:
                    return False
                continue
            there[x.id], back[y.id] = y.id, x.id
        x, y = f.resolve(x), g.resolve(y)
        if isinstance(x, Stream) and isinstance(y, Stream):
            if x.data != y.data:
                return False
            x, y = ({k: v for k, v in s.info.items() if k != "Length"} for s in (x, y))
        if isinstance(x, dict) and isinstance(y, dict):
            if (x.keys() ^ y.keys()) - set(skip):
                return False
            todo += [(v, y[k]) for k, v in x.items() if k not in skip]
        elif isinstance(x, list) and isinstance(y, list):
            if len(x) != len(y):
                return False
            todo += zip(x, y)
        elif isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool) and not isinstance(y, bool):
            if float(x) != float(y):
                return False
        elif kind_of(x) != kind_of(y) or x != y:
            return False
    return True


def compared(pairs: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, equal, error_code) of rows (file_id, content, other): whether both files hold the same catalog and all below."""
    o = options or Options()

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for a, b in zip(batch["content"], batch["other"]):
                try:
                    f, g = File.open(a, o), File.open(b, o)
                    out.append((same(f, f.trailer.get("Root"), g, g.trailer.get("Root")), None))
                except FAULTS as e:
                    out.append((None, code_of(e)))
            yield pd.DataFrame({"file_id": batch["file_id"], "equal": pd.Series([x[0] for x in out], dtype=object), "error_code": pd.Series([x[1] for x in out], dtype=object)})

    return pairs.select("file_id", "content", "other").mapInPandas(run, "file_id string, equal boolean, error_code string")


def kept(files: DataFrame | Making, change, options: Options | None = None) -> DataFrame:
    """(file_id, equal, error_code): whether `change(File) -> bytes` keeps the catalog of a file and all below; no join of
    files with their changed ones."""
    o = options or Options()

    def rows(file_id, f):
        g = File.open(change(f), o)
        yield file_id, same(f, f.trailer.get("Root"), g, g.trailer.get("Root"))

    return _flat(files, "file_id string, equal boolean", rows, o)


# Updates by path -----------------------------------------------------------------------------------------------------


def put(b: Builder, path: list[str | int], value: Any) -> Ref:
    """Replaces the value at a path from the catalog on; of what stands in between, only the last object on the way changes."""
    f, ref = b.base, b.base.trailer.get("Root")
    if not isinstance(ref, Ref):
        raise SyntaxIssue("MissingEntry", "Root")
    whole = b.changes.get(ref.id, f.get(ref.id))
    at, inside = whole, []
    for step in path[:-1]:
        below = at.info[step] if isinstance(at, Stream) else at[step]
        inside.append(step)
        if isinstance(below, Ref):
            ref, inside = below, []
            whole = below = b.changes.get(ref.id, f.get(ref.id))
        at = below
    return b.update(ref, _with(whole, [*inside, path[-1]], value))


def _with(v: Any, path: list, value: Any) -> Any:
    if not path:
        return value
    if isinstance(v, Stream):
        return Stream(_with(v.info, path, value), v.data)
    if isinstance(v, list):
        return [_with(x, path[1:], value) if i == path[0] else x for i, x in enumerate(v)]
    return v | {path[0]: _with(v.get(path[0]), path[1:], value)}


def updated_catalog(f: File, keys: dict[str, Any]) -> bytes:
    """The file with keys of its catalog replaced, in a revision of its own."""
    b = Builder(f)
    root = b.update(f.trailer["Root"], keys, merge=True)
    return b.save({k: v for k, v in f.trailer.items() if k in ("Info", "ID")} | {"Root": root})


# More walks ----------------------------------------------------------------------------------------------------------


def destinations(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, name, page, view): named destinations of the catalog's tree and dictionary, with the number of their page."""
    from folioforge.operators.views import dest

    def rows(file_id, f):
        numbers = {obj: i for i, (obj, *_) in enumerate(found(f, "Page"))}
        root = _catalog(f)
        named = [*tree_leaves(f, _dict(f, root.get("Names")).get("Dests"), "Names"), *((k.encode(), v) for k, v in _dict(f, root.get("Dests")).items())]
        for name, v in named:
            try:
                d = dest(f, v)
                yield file_id, name, numbers.get(d["page"]), d["view"]
            except FAULTS as e:
                yield file_id, name, None, None, code_of(e), str(e)[:1000]

    return _flat(files, "file_id string, name binary, page int, view string", rows, options or Options())


def appearances(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, annot, entry, state, obj): the streams below N, R and D of every annotation; state is null for a single one."""

    def rows(file_id, f):
        for annot, _, d, _ in found(f, "Annot"):
            look = _dict(f, d.get("AP"))
            for entry in ("N", "R", "D"):
                todo, seen = [(None, look.get(entry))], set()
                while todo:
                    state, v = todo.pop()
                    obj, got = (v.id if isinstance(v, Ref) else None), f.resolve(v)
                    if isinstance(got, Stream):
                        yield file_id, annot, entry, state, obj
                    elif isinstance(got, dict) and obj not in seen:
                        seen.add(obj if obj is not None else object())
                        todo += [(k if state is None else f"{state}/{k}", x) for k, x in reversed(got.items())]

    return _flat(files, "file_id string, annot bigint, entry string, state string, obj bigint", rows, options or Options())


def loads(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, obj, loads): how often each live object is asked for while every reference of the file is followed once."""

    def rows(file_id, f):
        counts: dict[int, int] = {}
        todo = [f.get(i) for i, e in sorted(f.table.items()) if e.kind != "Free"]
        while todo:
            v = todo.pop()
            if isinstance(v, Ref):
                counts[v.id] = counts.get(v.id, 0) + 1
            elif isinstance(v, (list, dict, Stream)):
                todo += v if isinstance(v, list) else (v.info if isinstance(v, Stream) else v).values()
        for i, n in sorted(counts.items()):
            yield file_id, i, n

    return _flat(files, "file_id string, obj bigint, loads bigint", rows, options or Options())


def fdf_fields(files: DataFrame | Making) -> DataFrame:
    """(file_id, ord, name, lines): the fields of form data files (file_id, content), values split at line ends.

    Such a file has no index that must hold: its objects are read one after another, and the last FDF dictionary counts.
    """

    return _rows(files, "file_id string, ord int, name string, lines array<string>", lambda file_id, data: ((file_id, *x) for x in _fdf(data)))


def _fdf(data: bytes) -> list[tuple[int, str | None, list[str]]]:
    head = data[:1024].find(b"%FDF-")
    if head < 0:
        raise SyntaxIssue("HeaderNotFound")
    p, objects = Parser(data, data.find(b"\n", head) + 1), {}
    while p.skip() < len(data) and p.peek() not in (b"trailer", b"xref", b"startxref"):
        ref, v = p.indirect(True)
        objects[ref.id] = v
    whole = lambda v: objects.get(v.id) if isinstance(v, Ref) else v
    tops = [v["FDF"] for v in objects.values() if isinstance(v, dict) and "FDF" in v]
    if not tops:
        raise SyntaxIssue("MissingEntry", "FDF")
    text = lambda v: lossy_text(v) if isinstance(v, bytes) else None if v is None else str(v)
    out = []
    for i, x in enumerate(whole((whole(tops[-1]) or {}).get("Fields")) or []):
        x = whole(x)
        out.append((i, text(whole(x.get("T"))), re.split(r"\r\n|\r|\n", text(whole(x.get("V"))) or "")))
    return out
