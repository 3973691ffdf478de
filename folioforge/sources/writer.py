"""Writing files: new ones, appended revisions, and compact rewrites; per-file assembly as a pandas function."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import codecs
from folioforge.sources.files import FAULTS, File, Making, Options, code_of, taken
from folioforge.sources.syntax import Name, Ref, Stream, SyntaxIssue, serialize


def encoded(text: str) -> bytes:
    """Printable ASCII as it is, anything else as UTF-16 with a mark."""
    return text.encode() if text.isascii() and text.isprintable() else b"\xfe\xff" + text.encode("utf-16-be", "surrogatepass")


def lossy_text(data: bytes) -> str:
    """UTF-16 after its mark, else UTF-8; what is malformed becomes U+FFFD, an odd last byte is dropped."""
    if data[:2] == b"\xfe\xff":
        body = data[2 : len(data) // 2 * 2]
        return body.decode("utf-16-be", "replace")
    return data.decode("utf-8", "replace")


def strict_text(data: bytes) -> str:
    try:
        return data[2 : len(data) // 2 * 2].decode("utf-16-be") if data[:2] == b"\xfe\xff" else data.decode()
    except UnicodeDecodeError as e:
        raise SyntaxIssue("Utf16Decode" if data[:2] == b"\xfe\xff" else "Utf8", str(e)) from None


def runs(ids: list[int]) -> list[int]:
    """First number and length of each run of numbers that follow one another."""
    out: list[int] = []
    for i in ids:
        if out and out[-2] + out[-1] == i:
            out[-1] += 1
        else:
            out += (i, 1)
    return out


class Builder:
    """Objects of one file: create, promise and fulfil, update, merge; saved as a new file or appended to an old one."""

    def __init__(self, base: File | None = None):
        self.base, self.changes, self.open = base, {}, set()
        self.next = (max(base.table, default=0) + 1) if base else 1

    def create(self, value: Any) -> Ref:
        ref = Ref(self.next)
        self.next += 1
        self.changes[ref.id] = value
        return ref

    def promise(self) -> Ref:
        ref = Ref(self.next)
        self.next += 1
        self.open.add(ref.id)
        return ref

    def fulfil(self, ref: Ref, value: Any) -> Ref:
        self.open.discard(ref.id)
        self.changes[ref.id] = value
        return ref

    def update(self, ref: Ref, value: Any, merge: bool = False) -> Ref:
        """Replaces an object; one that lives in an object stream gets a new number. merge: keys on top of the old ones."""
        e = self.base.table.get(ref.id) if self.base else None
        if merge:
            old = self.changes.get(ref.id, self.base.get(ref.id) if e else None)
            if not isinstance(old, dict) or not isinstance(value, dict):
                raise SyntaxIssue("UnexpectedPrimitive", "only dictionaries merge")
            value = old | value
        if e is not None and e.kind == "Stream" and ref.id not in self.changes:
            return self.create(value)
        if e is not None and e.kind == "Free":
            raise SyntaxIssue("FreeObject", str(ref.id))
        self.changes[ref.id] = value
        return ref

    def save(self, trailer: dict[str, Any]) -> bytes:
        """The file's bytes: changed objects by number, one index stream over them, then the place of the index."""
        if self.open:
            raise SyntaxIssue("UnfulfilledPromise", str(sorted(self.open)))
        out = bytearray(self.base.data if self.base else b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
        start = self.base.start if self.base else 0
        if self.base:
            out += b"\n"
        places = {}
        for i in sorted(self.changes):
            places[i] = len(out) - start
            out += b"%d 0 obj\n%s\nendobj\n" % (i, serialize(self.changes[i]))
        own = self.next
        places[own] = len(out) - start
        ids = sorted(places)
        width = max(1, (max(places.values()).bit_length() + 7) // 8)
        info = trailer | {"Type": Name("XRef"), "Size": own + 1, "W": [1, width, 1], "Index": runs(ids)}
        if self.base:
            info["Prev"] = self.base.index_offset()
        rows = b"".join(b"\x01" + places[i].to_bytes(width) + b"\x00" for i in ids)
        out += b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF\n" % (own, serialize(Stream(info, rows)), places[own])
        return bytes(out)


def name_tree(b: Builder, entries: dict[bytes, Any], fan: int = 16) -> Ref:
    """A name tree over the entries in byte order: leaves of `fan` names, nodes of `fan` kids, limits on all but the root."""
    keys = sorted(entries)
    if len(keys) <= fan:
        return b.create({"Names": [x for k in keys for x in (k, entries[k])]})
    groups = [keys[i : i + fan] for i in range(0, len(keys), fan)]
    level = [(g[0], g[-1], b.create({"Limits": [g[0], g[-1]], "Names": [x for k in g for x in (k, entries[k])]})) for g in groups]
    while len(level) > fan:
        parts = [level[i : i + fan] for i in range(0, len(level), fan)]
        level = [(p[0][0], p[-1][1], b.create({"Limits": [p[0][0], p[-1][1]], "Kids": [r for *_, r in p]})) for p in parts]
    return b.create({"Kids": [r for *_, r in level]})


def page_tree(b: Builder, pages: list[dict], fan: int = 16, **values: Any) -> Ref:
    """A page tree of nodes with `fan` kids; `values` stand in the root and are inherited from there."""
    root = b.promise()

    def node(part: list[dict], parent: Ref, ref: Ref, extra: dict[str, Any]) -> None:
        if len(part) <= fan:
            kids = [b.create({"Type": Name("Page")} | p | {"Parent": ref}) for p in part]
        else:
            size = fan
            while size * fan < len(part):
                size *= fan
            kids = []
            for i in range(0, len(part), size):
                kids.append(b.promise())
                node(part[i : i + size], ref, kids[-1], {"Parent": ref})
        b.fulfil(ref, {"Type": Name("Pages"), "Kids": kids, "Count": len(part)} | extra)

    node(pages, root, root, values)
    return root


def rebuilt(f: File) -> bytes:
    """Every live object written anew, numbers kept, those of object streams too; indirect lengths become direct."""
    b = Builder()
    for i, e in sorted(f.table.items()):
        if e.kind == "Free" or not i:
            continue
        v = f.get(i)
        if isinstance(v, Stream):
            if v.info.get("Type") in ("XRef", "ObjStm"):
                continue
            v = Stream({k: x for k, x in v.info.items() if k != "Length"}, v.data)
        b.changes[i] = v
    b.next = max(f.table, default=0) + 1
    return b.save({k: v for k, v in f.trailer.items() if k in ("Root", "Info", "ID")})


def imported(source: File, refs: list[Ref], into: Builder) -> dict[int, Ref]:
    """Copies what `refs` reach into another file, each object once; old numbers to new references."""
    known: dict[int, Ref] = {}
    todo: list[int] = []

    def copy(v: Any) -> Any:
        if isinstance(v, Ref):
            if v.id not in known:
                known[v.id] = into.promise()
                todo.append(v.id)
            return known[v.id]
        if isinstance(v, list):
            return [copy(x) for x in v]
        if isinstance(v, dict):
            return {k: copy(x) for k, x in v.items()}
        if isinstance(v, Stream):
            return Stream(copy(v.info), v.data)
        return v

    for r in refs:
        copy(r)
    while todo:  # a list of work, not recursion: chains of references may be of any length
        old = todo.pop()
        into.fulfil(known[old], copy(source.get(old)))
    return known


def flat_document(pages: list[bytes], info: dict[str, str] | None = None, extra: dict[str, Any] | None = None, box: tuple[float, ...] = (0, 0, 595, 842), packed: bool = False) -> bytes:
    """A file with one page for each content stream. packed: page objects live in an object stream."""
    b = Builder()
    tree = b.promise()
    kids, held = [], []
    for content in pages:
        body = b.create(Stream({"Filter": Name("FlateDecode")}, codecs.flate_encode(content)))
        page = {"Type": Name("Page"), "Parent": tree, "Contents": body, "Resources": {"Font": {"F1": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}}}}
        if packed:
            kids.append(b.promise())
            b.open.discard(kids[-1].id)
            held.append((kids[-1].id, serialize(page)))
        else:
            kids.append(b.create(page))
    b.fulfil(tree, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": list(map(int, box)), "Rotate": 0})
    root = b.create({"Type": Name("Catalog"), "Pages": tree} | (extra or {}))
    trailer: dict[str, Any] = {"Root": root, "ID": [b"folio", b"forge"]}
    if info:
        trailer["Info"] = b.create({k: encoded(v) for k, v in info.items()})
    if not held:
        return b.save(trailer)
    at, head, body = 0, [], []
    for i, text in held:
        head.append(b"%d %d" % (i, at))
        body.append(text)
        at += len(text) + 1
    first = b" ".join(head) + b" "
    store = b.create(Stream({"Type": Name("ObjStm"), "N": len(held), "First": len(first), "Filter": Name("FlateDecode")}, codecs.flate_encode(first + b" ".join(body))))
    return packed_save(b, trailer, store, [i for i, _ in held])


def packed_save(b: Builder, trailer: dict[str, Any], store: Ref, members: list[int]) -> bytes:
    """Like Builder.save, with index entries of the second kind for the members of one object stream."""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for i in sorted(b.changes):
        places[i] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (i, serialize(b.changes[i]))
    for k, i in enumerate(members):
        places[i] = (2, store.id, k)
    own = b.next
    places[own] = (1, len(out), 0)
    rows = b"".join(bytes([a]) + p.to_bytes(4) + k.to_bytes(3) for _, (a, p, k) in sorted(places.items()))
    info = trailer | {"Type": Name("XRef"), "Size": own + 1, "W": [1, 4, 3], "Index": runs(sorted(places))}
    at = places[own][1]
    out += b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF\n" % (own, serialize(Stream(info, rows)), at)
    return bytes(out)


def text_content(lines: list[str], size: int = 10) -> bytes:
    """A content stream that shows the lines, each as one string operand."""
    ops = [b"BT /F1 %d Tf 12 TL 50 800 Td" % size]
    ops += [serialize(encoded(line)) + b" Tj T*" for line in lines]
    return b"\n".join([*ops, b"ET"])


def built(rows: DataFrame, make) -> Making:
    """Files of `make(*row)` for each row, whose first column is their id."""
    return Making(rows, lambda batch: ((None if row[0] is None else str(row[0]), make(*row), None) for row in taken(batch)))


def documents_to_files(docs: DataFrame, key: str = "doc_id", text: str = "text", packed: bool = False) -> Making:
    """files(file_id, content): one file for each row, its lines the lines of the text, its key and length in Info."""

    def make(k, t):
        return flat_document([text_content((t or "").split("\n"))], {"Title": str(k), "Keywords": str(len(t or ""))}, packed=packed)

    return built(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), make)


def revised(files: DataFrame | Making, change, options: Options | None = None) -> Making:
    """files with `change(File) -> bytes` applied to each; a file that fails keeps its bytes and gets an error."""
    o, made = options or Options(), Making.of(files)
    make = made.make

    def changed(batch):
        for file_id, content, _ in make(batch):
            try:
                yield file_id, change(File.open(content, o)), None
            except FAULTS as e:
                yield file_id, content, code_of(e)

    return Making(made.rows, changed, True)
