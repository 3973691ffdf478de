"""What hangs off a file's catalog: outline, name and number trees, form fields, annotations, attachments, as rows.

A walk stays inside one file and visits no object twice, so cycles end; it runs where the file's bytes are.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from folioforge.sources.files import File, Options, _flat
from folioforge.sources.syntax import Ref, Stream, SyntaxIssue


def _catalog(f: File) -> dict[str, Any]:
    root = f.resolve(f.trailer.get("Root"))
    if not isinstance(root, dict):
        raise SyntaxIssue("MissingEntry", "Root")
    return root


def _dict(f: File, v: Any) -> dict[str, Any]:
    v = f.resolve(v)
    return v.info if isinstance(v, Stream) else v if isinstance(v, dict) else {}


def tree_leaves(f: File, node: Any, key: str, seen: set | None = None):
    """(key, value) of a name (`Names`) or number (`Nums`) tree in order; Kids go before own entries, an odd tail is ignored."""
    seen = set() if seen is None else seen
    if isinstance(node, Ref):
        if node.id in seen:
            return
        seen.add(node.id)
    d = _dict(f, node)
    kids = f.resolve(d.get("Kids"))
    if isinstance(kids, list):
        for kid in kids:
            yield from tree_leaves(f, kid, key, seen)
        return
    flat = f.resolve(d.get(key)) or []
    for k, v in zip(flat[::2], flat[1::2]):
        yield f.resolve(k), v


def name_tree(files: DataFrame, tree: str, options: Options | None = None) -> DataFrame:
    """(file_id, ord, key, ref_id): entries of Names/<tree> of the catalog."""

    def rows(file_id, f):
        names = _dict(f, _catalog(f).get("Names")).get(tree)
        for i, (k, v) in enumerate(tree_leaves(f, names, "Names")):
            yield file_id, i, k, v.id if isinstance(v, Ref) else None

    return _flat(files, "file_id string, ord int, key binary, ref_id long", rows, options or Options())


def page_labels(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, first, style, prefix, start): the number tree of page labels."""

    def rows(file_id, f):
        for k, v in tree_leaves(f, _catalog(f).get("PageLabels"), "Nums"):
            d = _dict(f, v)
            prefix = f.resolve(d.get("P"))
            yield file_id, k, d.get("S"), prefix, d.get("St", 1)

    return _flat(files, "file_id string, first int, style string, prefix binary, start int", rows, options or Options())


def attachments(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, name, data): embedded files by name, decoded."""

    def rows(file_id, f):
        names = _dict(f, _catalog(f).get("Names")).get("EmbeddedFiles")
        for k, v in tree_leaves(f, names, "Names"):
            ef = _dict(f, _dict(f, v).get("EF"))
            s = f.resolve(next((ef[x] for x in ("UF", "F", "DOS", "Mac", "Unix") if x in ef), None))
            yield file_id, k, f.decoded(s) if isinstance(s, Stream) else None

    return _flat(files, "file_id string, name binary, data binary", rows, options or Options())


def outline(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, ord, depth, title, dest): outline items in reading order: an item, its children, its next one."""

    def rows(file_id, f):
        todo, seen, at = [(_dict(f, _catalog(f).get("Outlines")).get("First"), 0)], set(), 0
        while todo:
            ref, depth = todo.pop()
            if ref is None or isinstance(ref, Ref) and ref.id in seen:
                continue
            if isinstance(ref, Ref):
                seen.add(ref.id)
            d = _dict(f, ref)
            action = _dict(f, d.get("A"))
            dest = f.resolve(d.get("Dest", action.get("D") if action.get("S") == "GoTo" else None))
            page = dest[0].id if isinstance(dest, list) and dest and isinstance(dest[0], Ref) else None
            yield file_id, at, depth, f.resolve(d.get("Title")), page
            at += 1
            todo += [(d.get("Next"), depth), (d.get("First"), depth + 1)]

    return _flat(files, "file_id string, ord int, depth int, title binary, dest long", rows, options or Options())


def fields(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, ord, depth, name, type, flags, value): form fields, parents before children; nothing is inherited."""

    def rows(file_id, f):
        form = _dict(f, _catalog(f).get("AcroForm"))
        todo, seen, at = [(k, 0) for k in reversed(f.resolve(form.get("Fields")) or [])], set(), 0
        while todo:
            ref, depth = todo.pop()
            if isinstance(ref, Ref):
                if ref.id in seen:
                    continue
                seen.add(ref.id)
            d = _dict(f, ref)
            value = f.resolve(d.get("V"))
            yield file_id, at, depth, f.resolve(d.get("T")), d.get("FT"), d.get("Ff", 0), value if isinstance(value, bytes) else str(value).encode() if value is not None else None
            at += 1
            todo += [(k, depth + 1) for k in reversed(f.resolve(d.get("Kids")) or [])]

    return _flat(files, "file_id string, ord int, depth int, name binary, type string, flags int, value binary", rows, options or Options())


def annotations(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, page, ord, subtype, contents, quads): annotations of every page; quads counts QuadPoints in eights."""

    def rows(file_id, f):
        todo, seen, page = [_catalog(f).get("Pages")], set(), 0
        while todo:
            ref = todo.pop()
            if isinstance(ref, Ref):
                if ref.id in seen:
                    continue
                seen.add(ref.id)
            d = _dict(f, ref)
            if d.get("Type") == "Pages" or "Kids" in d:
                todo += reversed(f.resolve(d.get("Kids")) or [])
                continue
            for i, a in enumerate(f.resolve(d.get("Annots")) or []):
                x = _dict(f, a)
                quads = f.resolve(x.get("QuadPoints")) or []
                yield file_id, page, i, x.get("Subtype"), f.resolve(x.get("Contents")), len(quads) // 8 if len(quads) % 8 == 0 else None
            page += 1

    return _flat(files, "file_id string, page int, ord int, subtype string, contents binary, quads int", rows, options or Options())
