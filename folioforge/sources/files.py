"""Reading whole files: index sections, objects, object streams, scans; one row of errors instead of a failed job."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice, repeat
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioforge.functions import codecs, crypt
from folioforge.sources.syntax import Parser, Ref, Stream, SyntaxIssue, kind_of

MAX_ID = 1_000_000
#: Rows and bytes that a reader task holds before it passes them on.
SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20


@dataclass
class Options:
    """tolerant: forgive what readers commonly forgive (missing endobj, short index streams, wrong optional values)."""

    tolerant: bool = True
    password: bytes = b""
    limit: int = 10 << 20


@dataclass(slots=True)
class Entry:
    kind: str
    pos: int = 0
    gen: int = 0
    stream: int = 0
    index: int = 0


@dataclass
class File:
    data: bytes
    options: Options = field(default_factory=Options)
    start: int = 0
    sections: list[list[tuple[int, Entry]]] = field(default_factory=list)
    table: dict[int, Entry] = field(default_factory=dict)
    trailer: dict[str, Any] = field(default_factory=dict)
    decoder: Any = None
    cache: dict[int, Any] = field(default_factory=dict)
    packed: dict[int, list] = field(default_factory=dict)

    @classmethod
    def open(cls, data: bytes, options: Options | None = None) -> File:
        f = cls(bytes(data), options or Options())
        head = f.data[:1024].find(b"%PDF-")
        if head < 0:
            raise SyntaxIssue("HeaderNotFound")
        f.start = head
        f.read_index()
        if f.trailer.get("Encrypt") is not None:
            ref = f.trailer["Encrypt"]
            settings = f.resolve(ref)
            ids = f.resolve(f.trailer.get("ID"))
            if not isinstance(settings, dict):
                raise SyntaxIssue("UnexpectedPrimitive", kind_of(settings))
            if not isinstance(ids, list) or not ids:
                raise SyntaxIssue("MissingEntry", "ID")
            f.decoder = crypt.Decoder.open({k: f.resolve(v) for k, v in settings.items()}, f.resolve(ids[0]), f.options.password)
            f.decoder.skip = ref.id if isinstance(ref, Ref) else -1
            f.cache.clear()
        return f

    @property
    def version(self) -> str:
        return self.data[self.start + 1 : self.start + 8].decode("latin-1")

    @property
    def root(self) -> dict[str, Any]:
        v = self.resolve(self.trailer.get("Root"))
        if not isinstance(v, dict):
            raise SyntaxIssue("MissingEntry", "Root")
        return v

    @property
    def page_count(self) -> int:
        """What the page tree states of itself."""
        tree = self.resolve(self.root.get("Pages"))
        count = self.resolve(tree.get("Count")) if isinstance(tree, dict) else None
        if not isinstance(count, int):
            raise SyntaxIssue("MissingEntry", "Count")
        return count

    def index_offset(self) -> int:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise SyntaxIssue("XrefNotFound")
        return Parser(self.data, at + 9).integer()

    def read_index(self) -> None:
        """The newest section and its trailer, then the chain of Prev; newer entries win, ids past Size drop out."""
        at, seen, size = self.index_offset(), set(), None
        while at is not None and at not in seen:
            seen.add(at)
            entries, trailer = self.section(self.start + at)
            if not isinstance(trailer, dict):
                raise SyntaxIssue("UnexpectedPrimitive", kind_of(trailer))
            if not self.trailer:
                self.trailer = trailer
                size = trailer.get("Size")
                if not isinstance(size, int) or size > MAX_ID:
                    raise SyntaxIssue("BadSize", str(size))
            self.sections.append(entries)
            for i, e in entries:
                if i < size:
                    self.table.setdefault(i, e)
            at = trailer.get("Prev")
            if at is not None and (not isinstance(at, int) or at < 0):
                raise SyntaxIssue("BadPrev")

    def section(self, at: int) -> tuple[list[tuple[int, Entry]], dict]:
        if not 0 <= at < len(self.data):
            raise SyntaxIssue("ContentReadPastBoundary", str(at))
        p = Parser(self.data, at)
        if p.peek() == b"xref":
            p.next()
            out = []
            while p.peek() != b"trailer":
                first, n = p.integer(), p.integer()
                for i in range(first, first + n):
                    a, b, kind = p.integer(), p.integer(), p.next()
                    if kind not in (b"n", b"f"):
                        raise SyntaxIssue("UnexpectedLexeme", repr(kind))
                    out.append((i, Entry("Raw", a, b) if kind == b"n" else Entry("Free", a, b)))
            p.next()
            return out, p.value()
        _, stream = Parser(self.data, at, length_of=self.length).indirect(self.options.tolerant)
        if not isinstance(stream, Stream):
            raise SyntaxIssue("UnexpectedPrimitive", kind_of(stream))
        return self.packed_section(stream), stream.info

    def packed_section(self, stream: Stream) -> list[tuple[int, Entry]]:
        info, data = stream.info, self.decoded(stream)
        widths, index = info.get("W", []), info.get("Index") or [0, info.get("Size", 0)]
        if not isinstance(widths, list) or not isinstance(index, list) or any(not isinstance(v, int) or v < 0 for v in [*widths, *index]):
            raise SyntaxIssue("BadXrefStream")
        if len(index) % 2 or len(widths) != 3 or max(widths) > 8 or sum(index[1::2]) > MAX_ID:
            raise SyntaxIssue("BadXrefStream")
        step, total, out = sum(widths), sum(index[1::2]), []
        have = min(total, len(data) // step) if step else total
        end = have * step

        def column(at: int, width: int, missing: int) -> Iterable[int]:
            return repeat(missing) if not width else data[at:end:step] if width == 1 else [int.from_bytes(data[i : i + width]) for i in range(at, end, step)]

        one, two = widths[0], widths[0] + widths[1]
        ids = islice(chain.from_iterable(range(i, i + n) for i, n in zip(index[::2], index[1::2])), have)
        for i, kind, b, c in zip(ids, column(0, one, 1), column(one, widths[1], 0), column(two, widths[2], 0)):
            if kind > 2:
                raise SyntaxIssue("XRefStreamType", str(kind))
            out.append((i, Entry("Stream", 0, 0, b, c) if kind == 2 else Entry("Raw" if kind else "Free", b, c)))
        if have < total and not self.options.tolerant:
            raise SyntaxIssue("EOF", "index stream")
        return out

    def length(self, ref: Ref) -> int | None:
        got = self.get(ref.id)
        return got if isinstance(got, int) else None

    def get(self, number: int) -> Any:
        """The object of this number: from its place, or from its object stream; free and unknown ones are errors."""
        if number in self.cache:
            return self.cache[number]
        e = self.table.get(number)
        if e is None:
            raise SyntaxIssue("UnspecifiedXRefEntry", str(number))
        if e.kind == "Free":
            raise SyntaxIssue("FreeObject", str(number))
        if e.kind == "Raw":
            keyed = None if self.decoder is None else lambda s: self.decoder.decrypt(number, e.gen, s)
            self.cache[number] = None  # a length that leads back here finds nothing
            try:
                _, v = Parser(self.data, self.start + e.pos, decrypt=keyed, length_of=self.length).indirect(self.options.tolerant)
                plain = isinstance(v, Stream) and (v.info.get("Type") == "XRef" or v.info.get("Type") == "Metadata" and self.decoder is not None and not self.decoder.encrypt_metadata)
                if isinstance(v, Stream) and self.decoder is not None and not plain:
                    v = Stream(v.info, self.decoder.decrypt(number, e.gen, v.data), v.start)
            finally:
                del self.cache[number]
        else:
            rows = self.unpacked(e.stream)
            if e.index >= len(rows):
                raise SyntaxIssue("ObjStmOutOfBounds", f"{e.index} of {len(rows)}")
            v = Parser(rows[e.index][1]).value()
        self.cache[number] = v
        return v

    def unpacked(self, number: int) -> list[tuple[int, bytes]]:
        """(object number, bytes) of an object stream: the offsets are the starts, each slice ends at the next."""
        if number not in self.packed:
            s = self.get(number)
            if not isinstance(s, Stream):
                raise SyntaxIssue("UnexpectedPrimitive", kind_of(s))
            data = self.decoded(s)
            n, first = (self.resolve(s.info.get(k)) for k in ("N", "First"))
            if not isinstance(n, int) or not isinstance(first, int) or not 0 <= n <= MAX_ID:
                raise SyntaxIssue("MissingEntry", "N, First")
            p = Parser(data, 0, first)
            pairs = [(p.integer(), p.integer()) for _ in range(n)]
            ends = [first + b for _, b in pairs[1:]] + [len(data)]
            self.packed[number] = [(i, data[first + b : e]) for (i, b), e in zip(pairs, ends)]
        return self.packed[number]

    def resolve(self, v: Any, depth: int = 16) -> Any:
        while isinstance(v, Ref) and depth:
            v, depth = self.get(v.id), depth - 1
        return v

    def filters(self, info: dict[str, Any]) -> list[tuple[str, dict]]:
        names, params = (self.resolve(info.get(k)) for k in ("Filter", "DecodeParms"))
        names = [] if names is None else names if isinstance(names, list) else [names]
        params = [] if params is None else params if isinstance(params, list) else [params]
        return [(str(self.resolve(n)), {k: self.resolve(v) for k, v in (self.resolve(params[i]) or {}).items()} if i < len(params) else {}) for i, n in enumerate(names)]

    def decoded(self, s: Stream) -> bytes:
        return codecs.decode_chain(s.data, self.filters(s.info), self.options.limit)

    def scan(self):
        """(ref or None, value, error): every object and trailer between the header and the index, in file order."""
        p, end = Parser(self.data, self.start, length_of=self.length), self.start + self.index_offset()
        p.pos = max(p.pos, self.data.find(b"\n", p.pos) + 1)
        while p.skip() < min(end, len(self.data)):
            at = p.pos
            try:
                word = p.peek()
                if word == b"xref" or word == b"startxref":
                    p.next()
                    while re.fullmatch(rb"[0-9]+|[nf]", p.peek()):
                        p.next()
                elif word == b"trailer":
                    p.next()
                    yield None, p.value(), None
                else:
                    yield *p.indirect(self.options.tolerant), None
            except SyntaxIssue as e:
                yield None, None, e.code
                after = self.data.find(b"endobj", at + 1)
                if after < 0:
                    return
                p.pos = after + 6


# Rows ----------------------------------------------------------------------------------------------------------------

NODES = "file_id string, obj long, gen long, node int, parent int, depth int, ord int, key string, kind string, i int, n float, b boolean, s binary, name string, ref_id long, ref_gen long, stream_start long, stream_len long"
XREF = "file_id string, rev int, obj long, kind string, pos long, gen long, stream_id long, idx int"
ERROR = "error_code string, error_msg string"


def node_rows(file_id: str, obj: int, gen: int, value: Any):
    """The value as rows, a row for each node in pre-order."""
    count = 0

    def walk(v, parent, depth, ord_, key):
        nonlocal count
        node, count = count, count + 1
        k = kind_of(v)
        yield (
            file_id, obj, gen, node, parent, depth, ord_, key, k, v if k == "Integer" else None, float(v) if k == "Number" else None, v if k == "Boolean" else None,
            v if k == "String" else None, str(v) if k == "Name" else None, v.id if k == "Reference" else None, v.gen if k == "Reference" else None,
            v.start if k == "Stream" else None, len(v.data) if k == "Stream" else None,
        )
        inside = v.info if k == "Stream" else v
        if k in ("Dictionary", "Stream"):
            for at, (name, x) in enumerate(inside.items()):
                yield from walk(x, node, depth + 1, at, name)
        elif k == "Array":
            for at, x in enumerate(v):
                yield from walk(x, node, depth + 1, at, None)

    yield from walk(value, None, 0, 0, None)


def from_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """files(file_id, content): whole files below a path."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return got.select(F.col("path").alias("file_id"), "content")


#: What reading a damaged file can raise; anything without a code of its own is malformed.
FAULTS = (SyntaxIssue, codecs.CodecError, crypt.CryptError, AttributeError, TypeError, KeyError, IndexError, ValueError, OverflowError, RecursionError, ArithmeticError, struct.error, zlib.error)


def code_of(e: Exception) -> str:
    return getattr(e, "code", "Malformed")


def _table(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    """Rows as Arrow; a row with a value that its column can't hold becomes an error row."""
    bad = (pa.ArrowInvalid, pa.ArrowTypeError, TypeError, ValueError, OverflowError)
    try:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)
    except bad:
        if len(rows) > 1:
            half = len(rows) // 2
            return pa.concat_batches([_table(rows[:half], kinds), _table(rows[half:], kinds)])
        return _table([(rows[0][0], *[None] * (len(kinds) - 3), "Malformed", "value out of range")], kinds)


#: Tasks for each core where a table has fewer files than the session has cores.
TASKS_PER_CORE = 3
#: Rows of a batch that a worker holds as Python values at once.
TAKEN = 64

Content = tuple[str, bytes | None, str | None]


def spread(rows: DataFrame, light: bool = False) -> DataFrame:
    """A table's rows over all cores: a table in few files may be one part, however much work its rows are.

    Small files are read several to a part, so more files than cores are no sign of as many parts, nor many parts of
    even ones. light: the rows are small beside the work that they make, so they are dealt out evenly in any case.
    """
    if rows.isStreaming:
        return rows
    cores, parts = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return rows if not light and parts >= cores and len(rows.inputFiles()) >= cores else rows.repartition(max(cores * TASKS_PER_CORE, parts))


def taken(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch as tuples, few of them held at once."""
    for at in range(0, batch.num_rows, TAKEN):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, TAKEN).columns))


@dataclass
class Making:
    """Files that are made from rows by the worker that reads them, one after another, so none is sent or held.

    make: (file_id, content, error_code) of each file of a batch of rows. Whatever a DataFrame can do goes to the files
    as one: (file_id, content), with error_code if `errors`.
    """

    rows: DataFrame
    make: Callable[[pa.RecordBatch], Iterator[Content]]
    errors: bool = False

    @classmethod
    def of(cls, files: DataFrame | Making) -> Making:
        """Files that are there already, as they are."""
        if isinstance(files, Making):
            return files
        return cls(files.select("file_id", "content"), lambda batch: ((*row, None) for row in taken(batch)))

    def drop(self, *names: str) -> Making | DataFrame:
        return Making(self.rows, self.make) if names == ("error_code",) else self.files.drop(*names)

    @property
    def files(self) -> DataFrame:
        make, width = self.make, 2 + self.errors
        full = StructType.fromDDL("file_id string, content binary" + ", error_code string" * self.errors)
        kinds = to_arrow_schema(full)

        def run(batches):
            out, size = [], 0
            for batch in batches:
                for row in make(batch):
                    out.append(row)
                    size += len(row[1] or b"")
                    if len(out) >= SLICE_ROWS or size >= SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i].type) for i in range(width)], schema=kinds)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i].type) for i in range(width)], schema=kinds)

        return self.rows.mapInArrow(run, full)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.files, name)


def _weight(v: Any) -> int:
    return len(v) if isinstance(v, (bytes, str)) else sum(map(_weight, v)) if isinstance(v, list) else 0


def _flat(files: DataFrame | Making, schema: str, rows, options: Options) -> DataFrame:
    """rows(file_id, File) of each file of (file_id, content), and one error row where a file or an object fails."""
    return _rows(files, schema, lambda file_id, content: rows(file_id, File.open(content, options)))


def _rows(files: DataFrame | Making, schema: str, rows) -> DataFrame:
    """rows(file_id, bytes) of each file of (file_id, content), and one error row where that fails.

    Rows leave in slices of SLICE_ROWS or SLICE_BYTES, however large a file or a batch of files is.
    """
    full = StructType.fromDDL(f"{schema}, {ERROR}")
    kinds, width = to_arrow_schema(full), len(full) - 2
    made = Making.of(files)
    make = made.make

    def run(batches):
        out, size = [], 0
        for batch in batches:
            for file_id, content, _ in make(batch):
                try:
                    for row in rows(file_id, content or b""):
                        out.append(row if len(row) == width + 2 else (*row, None, None))
                        size += sum(map(_weight, row))
                        if len(out) >= SLICE_ROWS or size >= SLICE_BYTES:
                            yield _table(out, kinds)
                            out, size = [], 0
                except FAULTS as e:
                    out.append((file_id, *[None] * (width - 1), code_of(e), str(e)[:1000]))
        if out:
            yield _table(out, kinds)

    return made.rows.mapInArrow(run, full)


def xref_raw(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Every entry of every index section; rev 0 is the newest."""

    def rows(file_id, f):
        for rev, section in enumerate(f.sections):
            for i, e in section:
                yield file_id, rev, i, e.kind, e.pos, e.gen, e.stream, e.index

    return _flat(files, XREF, rows, options or Options())


def facts(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, version, bytes, revisions, live, root, pages, encrypted): a row for each file that opens."""

    def rows(file_id, f):
        root = f.trailer.get("Root")
        yield file_id, f.version, len(f.data), len(f.sections), sum(e.kind != "Free" for e in f.table.values()), root.id if isinstance(root, Ref) else None, f.page_count, f.decoder is not None

    return _flat(files, "file_id string, version string, bytes long, revisions int, live long, root long, pages int, encrypted boolean", rows, options or Options())


def nodes(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Every live object as rows of nodes; an object that fails is one error row."""

    def rows(file_id, f):
        for i, e in sorted(f.table.items()):
            if e.kind == "Free":
                continue
            try:
                yield from node_rows(file_id, i, e.gen, f.get(i))
            except FAULTS as issue:
                yield (file_id, i, e.gen, *[None] * 15, code_of(issue), str(issue)[:1000])

    return _flat(files, NODES, rows, options or Options())


def scanned(files: DataFrame, options: Options | None = None) -> DataFrame:
    """Objects in file order by a scan that does not look at the index; ord counts the items found."""

    def rows(file_id, f):
        for at, (ref, v, error) in enumerate(f.scan()):
            yield file_id, at, ref.id if ref else None, ref.gen if ref else None, kind_of(v) if error is None else None, error, error

    return _flat(files, "file_id string, ord int, obj long, gen long, kind string", rows, options or Options())


def streams(files: DataFrame, options: Options | None = None, want: tuple[str, ...] = ("raw", "decoded"), kind: str | None = "") -> DataFrame:
    """streams(file_id, obj, gen, type, filters, and of raw and decoded those in `want`).

    A stream that can't be decoded is an error row that keeps its raw bytes. kind: only streams of this type (None: of
    none); others are not decoded.
    """

    def rows(file_id, f):
        for i, e in sorted(f.table.items()):
            if e.kind == "Free":
                continue
            try:
                v = f.get(i)
            except FAULTS:
                continue
            if isinstance(v, Stream) and (kind == "" or v.info.get("Type") == kind):
                raw = (v.data,) if "raw" in want else ()
                try:
                    names = [k for k, _ in f.filters(v.info)]
                    yield file_id, i, e.gen, f.resolve(v.info.get("Type")), names, *raw, *((f.decoded(v),) if "decoded" in want else ())
                except FAULTS as issue:
                    yield file_id, i, e.gen, None, None, *raw, *((None,) if "decoded" in want else ()), code_of(issue), str(issue)[:1000]

    return _flat(files, "file_id string, obj long, gen long, type string, filters array<string>" + "".join(f", {c} binary" for c in ("raw", "decoded") if c in want), rows, options or Options())
