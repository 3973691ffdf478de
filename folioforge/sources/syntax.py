"""Tokens and values of document-object files, as pure functions over bytes.

Values: None, bool, int, Real (single precision), bytes (strings), Name, list, dict (by key, in order, the last of equal
keys wins), Ref and Stream. Every failure is a SyntaxIssue with a short code, which readers turn into error rows.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

MAX_DEPTH = 20
#: Names of which a worker keeps the other form.
KEPT = 1024
WHITE = b"\x00 \r\n\t"
DELIMITERS = b"()<>[]{}/%"
_SKIP = re.compile(rb"(?:[\x00 \r\n\t]+|%[^\n]*\n?)*")
_SKIPPED = WHITE + b"%"
#: White space and comments, then one token.
_TOKEN = re.compile(rb"(?:[\x00 \r\n\t]++|%[^\n]*+\n?)*+(<<|>>|[()<>\[\]{}]|/?[^\x00 \r\n\t()<>\[\]{}/%]++|/)")
INTEGER = re.compile(rb"-?[0-9]+\Z")
#: The rest of a reference after its number.
_REF = re.compile(rb"(?:[\x00 \r\n\t]++|%[^\n]*+\n?)++(-?[0-9]++)(?:[\x00 \r\n\t]++|%[^\n]*+\n?)++R(?![^\x00 \r\n\t()<>\[\]{}/%])")
_W, _R = rb"[\x00 \r\n\t]", rb"[^\x00 \r\n\t()<>\[\]{}/%]"
#: A plain name, number with the rest of a reference, or string, without comments or escapes: what most values are.
_PLAIN_VALUE = rb"(?:/([^\x00 \r\n\t()<>\[\]{}/%#]{1,64}+)(?!" + _R + rb")|(-?[0-9]{1,9}+)(?!" + _R + rb")(?:" + _W + rb"++(-?[0-9]{1,9}+)" + _W + rb"++R(?!" + _R + rb"))?+|\(([^()\\]*+)\))" + _W + rb"*+"
#: A key with such a value, before the next key or the end; whatever else stands there is read token by token.
_PAIR = re.compile(_W + rb"*+/(" + _R + rb"{1,64}+)(?!" + _R + rb")" + _W + rb"*+" + _PLAIN_VALUE + rb"(?=/|>>)")
#: Such a value of a list, where what follows cannot make it a reference.
_ITEM = re.compile(_W + rb"*+" + _PLAIN_VALUE + rb"(?=[/(\]]|-?[0-9]++(?!" + _R + rb"|" + _W + rb"*+(?:%|R)))")
#: What an object begins with, and its end.
_HEAD = re.compile(_W + rb"*+(-?[0-9]{1,9}+)" + _W + rb"++(-?[0-9]{1,9}+)" + _W + rb"++obj(?!" + _R + rb")")
_END = re.compile(_W + rb"*+endobj(?!" + _R + rb")")
_RUN = re.compile(rb"[^()\\]+")
REAL = re.compile(rb"-?[0-9]*(?:\.[0-9]*)?")
#: Kinds a parse may be limited to, as bits of a mask.
KINDS = {k: 1 << i for i, k in enumerate(("Null", "Integer", "Number", "Boolean", "String", "Stream", "Dictionary", "Array", "Reference", "Name"))}
ANY = (1 << len(KINDS)) - 1


class SyntaxIssue(ValueError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.message = code, message


class Name(str):
    __slots__ = ()


class Real(float):
    """A number in single precision."""

    __slots__ = ()

    def __new__(cls, value: float):
        return super().__new__(cls, struct.unpack("f", struct.pack("f", value))[0] if abs(value) < 3.4e38 else float("inf") * (1 if value > 0 else -1))


@dataclass(frozen=True)
class Ref:
    id: int
    gen: int = 0


@dataclass
class Stream:
    info: dict[str, Any]
    data: bytes
    start: int = -1


_TYPES = {type(None): "Null", bool: "Boolean", Real: "Number", int: "Integer", float: "Number", bytes: "String", Name: "Name", list: "Array", dict: "Dictionary", Ref: "Reference", Stream: "Stream"}


def kind_of(v: Any) -> str:
    k = _TYPES.get(type(v))
    if k:
        return k
    for t, k in _TYPES.items():
        if isinstance(v, t):
            return k
    raise TypeError(type(v))


def span(size: int, start: int | None = None, end: int | None = None) -> tuple[int, int]:
    """A range of places in `size` bytes, open on either side; one that is turned round or runs past the end is an error."""
    start, end = 0 if start is None else start, size if end is None else end
    if not 0 <= start <= end <= size:
        raise SyntaxIssue("ContentReadPastBoundary", f"{start}..{end} of {size}")
    return start, end


class Lexer:
    """A cursor over bytes that yields one token at a time; <<, >> and /name are single tokens."""

    def __init__(self, data: bytes, pos: int = 0, end: int | None = None):
        self.data, self.pos, self.end = data, pos, len(data) if end is None else end

    def skip(self) -> int:
        at = self.pos
        if at < self.end and self.data[at] in _SKIPPED or at > self.end:
            self.pos = min(_SKIP.match(self.data, at, self.end).end(), self.end)
        return self.pos

    def next(self, issue: str = "") -> bytes:
        m = _TOKEN.match(self.data, self.pos, self.end)
        if m is None:
            self.skip()
            raise SyntaxIssue("EOF", issue)
        self.pos = m.end()
        return m[1]

    def peek(self) -> bytes:
        m = _TOKEN.match(self.data, self.pos, self.end)
        return m[1] if m else b""

    def back(self) -> bytes:
        """The word before the cursor, up to white space on either side; the cursor moves to its start."""
        end = self.pos
        while end > 0 and self.data[end - 1] in WHITE:
            end -= 1
        start = self.boundary_back(end)
        if start == end:
            raise SyntaxIssue("EOF")
        self.pos = start
        return self.data[start:end]

    def boundary(self, at: int) -> int:
        """The first white space from a place on, or the end."""
        while at < self.end and self.data[at] not in WHITE:
            at += 1
        return at

    def boundary_back(self, at: int) -> int:
        """The place after the last white space before a place, or the beginning."""
        while at > 0 and self.data[at - 1] not in WHITE:
            at -= 1
        return at

    def expect(self, token: bytes) -> None:
        at = self.pos
        got = self.next()
        if got != token:
            self.pos = at
            raise SyntaxIssue("UnexpectedLexeme", f"{got!r} for {token!r}")

    def integer(self) -> int:
        got = self.next()
        if not INTEGER.match(got):
            raise SyntaxIssue("Parse", f"{got!r} is no integer")
        return int(got)

    def tokens(self):
        while True:
            self.skip()
            at = self.pos
            try:
                yield at, self.next()
            except SyntaxIssue:
                return


def unescape_name(raw: bytes) -> Name:
    """#xx pairs decoded; a bad pair is an error, and so is what isn't UTF-8."""

    def pair(m: re.Match) -> bytes:
        if not re.fullmatch(rb"[0-9A-Fa-f]{2}", m[1]):
            raise SyntaxIssue("HexDecode", repr(m[0]))
        return bytes([int(m[1], 16)])

    try:
        return Name((re.sub(rb"#(.{0,2})", pair, raw, flags=re.S) if b"#" in raw else raw).decode())
    except UnicodeDecodeError as e:
        raise SyntaxIssue("Utf8", str(e)) from None


_PLAIN = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12, ord("("): 40, ord(")"): 41, ord("\\"): 92}


def literal_string(data: bytes, pos: int, end: int | None = None) -> tuple[bytes, int]:
    """The string that begins after `(`, and the place after its `)`.

    Octal codes wrap to a byte, a backslash before an end of line drops both, and an unknown escape gives NUL and the
    character itself.
    """
    out, depth, end = bytearray(), 1, len(data) if end is None else end
    while pos < end:
        run = _RUN.match(data, pos, end)
        if run:
            out += run[0]
            pos = run.end()
            continue
        c = data[pos]
        pos += 1
        if c == 40:
            depth += 1
        elif c == 41:
            depth -= 1
            if not depth:
                return bytes(out), pos
        elif c == 92:
            if pos >= end:
                break
            e = data[pos]
            pos += 1
            if e in _PLAIN:
                out.append(_PLAIN[e])
            elif 48 <= e <= 55:
                m = re.compile(rb"[0-7]{1,3}").match(data, pos - 1, end)
                out.append(int(m[0], 8) & 255)
                pos = m.end()
            elif e == 13:
                pos += data[pos : pos + 1] == b"\n"
            elif e != 10:
                out += bytes((0, e))
            continue
        out.append(c)
    raise SyntaxIssue("EOF", "string without an end")


def hex_string(data: bytes, pos: int, end: int | None = None) -> tuple[bytes, int]:
    """The string that begins after `<`; white space, form feeds too, is skipped and an odd digit padded with 0."""
    at = data.find(b">", pos, len(data) if end is None else end)
    if at < 0:
        raise SyntaxIssue("EOF", "string without an end")
    digits = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data[pos:at])
    if not re.fullmatch(rb"[0-9A-Fa-f]*", digits):
        raise SyntaxIssue("HexDecode", repr(digits[:20]))
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at + 1


@lru_cache(KEPT)
def _name(raw: bytes) -> Name:
    return unescape_name(raw)


@lru_cache(KEPT)
def _read_key(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


_WORDS = {b"true": True, b"false": False, b"null": None}


class Parser(Lexer):
    """Recursive descent over tokens. `decrypt` maps string bytes; `length_of` resolves an indirect stream length."""

    def __init__(self, data: bytes, pos: int = 0, end: int | None = None, decrypt=None, length_of=None):
        super().__init__(data, pos, end)
        self.decrypt, self.length_of = decrypt, length_of

    def value(self, mask: int = ANY, depth: int = MAX_DEPTH) -> Any:
        at = self.pos
        try:
            got = self._value(self.next(), depth)
            if mask != ANY and not KINDS[kind_of(got)] & mask:
                raise SyntaxIssue("PrimitiveNotAllowed", kind_of(got))
            return got
        except SyntaxIssue:
            self.pos = at
            raise

    def _value(self, token: bytes, depth: int) -> Any:
        """The value that begins with a token; values inside it are read without a place to go back to."""
        if token == b"<<":
            if not depth:
                raise SyntaxIssue("MaxDepth")
            info = self.dictionary(depth)
            if self.peek() == b"stream":
                return self.stream(info)
            return info
        if token == b"[":
            if not depth:
                raise SyntaxIssue("MaxDepth")
            out, match = [], _ITEM.match
            while True:
                while m := match(self.data, self.pos, self.end):
                    self.pos = m.end()
                    out.append(self._plain(m, m.lastindex, 0))
                if (token := self.next("array without an end")) == b"]":
                    return out
                out.append(self._value(token, depth - 1))
        if token == b"(":
            got, self.pos = literal_string(self.data, self.pos, self.end)
            return self.decrypt(got) if self.decrypt else got
        if token == b"<":
            got, self.pos = hex_string(self.data, self.pos, self.end)
            return self.decrypt(got) if self.decrypt else got
        if token[:1] == b"/":
            return unescape_name(token[1:])
        if INTEGER.match(token):
            rest = _REF.match(self.data, self.pos, self.end)
            if rest:
                self.pos = rest.end()
                return Ref(int(token), int(rest[1]))
            v = int(token)
            if not -(2**31) <= v < 2**31:
                raise SyntaxIssue("Parse", f"{v} is no 32-bit integer")
            return v
        if token in _WORDS:
            return _WORDS[token]
        number = REAL.match(token)[0]
        if re.search(rb"[0-9]", number):
            return Real(float(number))
        raise SyntaxIssue("UnknownType", repr(token[:20]))

    def _plain(self, m: re.Match, last: int, at: int) -> Any:
        """The value of a match of _PLAIN_VALUE whose groups follow group `at`."""
        if last == at + 2:
            return int(m[last])
        if last == at + 1:
            return _name(m[last])
        if last == at + 3:
            return Ref(int(m[last - 1]), int(m[last]))
        return self.decrypt(m[last]) if self.decrypt else m[last]

    def dictionary(self, depth: int) -> dict[str, Any]:
        out: dict[str, Any] = {}
        match = _PAIR.match
        while True:
            while m := match(self.data, self.pos, self.end):
                self.pos = m.end()
                key = _read_key(m[1])
                out[key] = self._plain(m, m.lastindex, 1)
            token = self.next()
            if token == b">>":
                return out
            if token[:1] != b"/":
                raise SyntaxIssue("UnexpectedLexeme", repr(token[:20]))
            key = token[1:].decode("utf-8", "replace")
            out[key] = self._value(self.next(), depth - 1)

    def stream(self, info: dict[str, Any]) -> Stream:
        self.next()
        line = self.data[self.pos : self.pos + 2]
        if line != b"\r\n" and line[:1] != b"\n":
            raise SyntaxIssue("UnexpectedLexeme", "stream without a line feed")
        start = self.pos + (2 if line == b"\r\n" else 1)
        size = info.get("Length")
        if isinstance(size, Ref):
            size = self.length_of(size) if self.length_of else None
        if not isinstance(size, int) or isinstance(size, bool) or size < 0:
            raise SyntaxIssue("MissingEntry", "Length")
        if start + size > self.end:
            raise SyntaxIssue("EOF", "stream past the end")
        self.pos = start + size
        self.expect(b"endstream")
        return Stream(info, self.data[start : start + size], start)

    def indirect(self, tolerant: bool = True) -> tuple[Ref, Any]:
        if m := _HEAD.match(self.data, self.pos, self.end):
            self.pos, ref = m.end(), Ref(int(m[1]), int(m[2]))
        else:
            ref = Ref(self.integer(), self.integer())
            self.expect(b"obj")
        v = self.value()
        if m := _END.match(self.data, self.pos, self.end):
            self.pos = m.end()
            return ref, v
        try:
            self.expect(b"endobj")
        except SyntaxIssue:
            if not tolerant:
                raise
        return ref, v


# Writing -------------------------------------------------------------------------------------------------------------


_BINARY = re.compile(rb"[^\x20-\x7f]")
#: A string that is written as it is.
_BARE = re.compile(rb"[\x20-\x27\x2a-\x5b\x5d-\x7f]*+\Z")
_ESCAPED = re.compile(rb"[\\()]")


def _real(v: float) -> bytes:
    text = f"{float(v):.9g}"
    return (f"{float(v):.10f}".rstrip("0").rstrip(".") if "e" in text else text).encode()


def _string(v: bytes) -> bytes:
    if _BARE.match(v):
        return b"(" + v + b")"
    return b"<" + v.hex().encode() + b">" if _BINARY.search(v) else b"(" + _ESCAPED.sub(rb"\\\g<0>", v) + b")"


@lru_cache(KEPT)
def _key(key: str) -> bytes:
    return b"/" + key.encode() + b" "


def _dictionary(v: dict) -> bytes:
    return b"<<" + b" ".join([_key(key) + (_WRITER.get(type(x)) or serialize)(x) for key, x in v.items() if x is not None and (x or not isinstance(x, dict))]) + b">>"


def _array(v: list) -> bytes:
    return b"[" + b" ".join([(_WRITER.get(type(x)) or serialize)(x) for x in v]) + b"]"


@lru_cache(KEPT)
def serialize_name(name: str) -> bytes:
    if not name.isascii() or "\x7f" in name:
        raise SyntaxIssue("Name", "a name is written in ASCII")
    return b"/" + _ESCAPED.sub(rb"\\\g<0>", name.encode())


_WRITERS = {
    "Null": lambda v: b"null", "Boolean": lambda v: b"true" if v else b"false", "Integer": b"%d".__mod__, "Number": _real, "String": _string, "Name": serialize_name, "Array": _array,
    "Dictionary": _dictionary, "Reference": lambda v: b"%d %d R" % (v.id, v.gen), "Stream": lambda v: serialize(v.info | {"Length": len(v.data)}) + b"\nstream\n" + v.data + b"\nendstream",
}
_WRITER = {t: _WRITERS[k] for t, k in _TYPES.items()}


def serialize(v: Any) -> bytes:
    """The textual form; null values and empty dictionaries of a dictionary are left out."""
    return (_WRITER.get(type(v)) or _WRITERS[kind_of(v)])(v)
