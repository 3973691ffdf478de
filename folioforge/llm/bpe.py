"""BPE encoding and decoding with a streaming transducer of bounded lookahead.

A merge can only be prevented by a merge of higher priority that straddles its right end, and that one in turn by a
merge of still higher priority. Following these chains through the merge list, highest priority first, bounds how many
symbols to the right can have a say in a token boundary: the sufficient lookahead. The transducer holds one window of
symbols, emits the tokens that end at least that far before the window's end, and drops their symbols, so its memory
does not grow with the input. Texts come in pieces, every word of them goes through the transducer, and a word that is
longer than a piece stays open in it. Decoding runs ids through a machine that holds at most three bytes of an
unfinished character.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Symbols that are merged at a time in addition to the lookahead.
WINDOW = 4096
#: Entries of a worker's memo of what the transducer made of whole words, both halves together.
MEMO = 150_000
#: Characters of a text that are split into words at a time.
PIECE = 1 << 16


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes, by the rule of byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols to the right of a boundary that decide it, over all merges; `merges` from highest to lowest priority.

    reach[p] is the farthest end, seen from the start of the prefix p, of a merge that begins with p as a proper prefix
    together with all that can influence it.
    """
    reach: dict[tuple[str, ...], int] = {}
    most = 0
    for left, right in merges:
        whole = (*length(left), *length(right))
        n = len(whole)
        beyond = max((reach[s] - (n - k) for k in range(n) if (s := whole[k:]) in reach), default=0)
        beyond = max(0, beyond)
        most = max(most, n - 1 + beyond)
        for k in range(1, n):
            if reach.get(whole[:k], 0) < n + beyond:
                reach[whole[:k]] = n + beyond
    return most


class Vocabulary:
    """A byte-level BPE vocabulary file with word ends, lower case and white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = {self.ids[a] << 20 | self.ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        self.lookahead = sufficient_lookahead(merges, self.symbols_of)
        alphabet = byte_alphabet()
        self.single = [self.ids[alphabet[b]] for b in range(256)]
        self.final = [self.ids[alphabet[b] + self.end] for b in range(256)]
        back = {c: b for b, c in alphabet.items()}
        self.bytes_of = {}
        for i, t in self.names.items():
            if t in self.added:
                self.bytes_of[i] = t.encode()
            else:
                stem = t.removesuffix(self.end)
                self.bytes_of[i] = bytes(back[c] for c in stem) + (b" " if t != stem else b"")
        self.marks = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def symbols_of(self, token: str) -> tuple[str, ...]:
        stem = token.removesuffix(self.end) if len(token) > len(self.end) else token
        return (*stem[:-1], token[len(stem) - 1 :])

    def merged(self, symbols: list[int]) -> list[int]:
        """Merges in priority order, the leftmost first among equals, until none applies."""
        if len(symbols) > 100:
            return self.merged_long(symbols)
        out, rank_of, made, none = list(symbols), self.pairs.get, self.made, len(self.made)
        ranks = [rank_of(a << 20 | b, none) for a, b in zip(out, out[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            out[i] = made[best]
            del out[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(out[i - 1] << 20 | out[i], none)
            if i < len(ranks):
                ranks[i] = rank_of(out[i] << 20 | out[i + 1], none)
        return out


    def merged_long(self, symbols: list[int]) -> list[int]:
        """The same by a heap over a linked list, in n log n."""
        out, n, rank_of, made = list(symbols), len(symbols), self.pairs.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(out[i] << 20 | out[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if out[i] < 0 or j >= n or rank_of(out[i] << 20 | out[j]) != rank:
                continue
            out[i], out[j], k = made[rank], -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank_of(out[i] << 20 | out[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of(out[h] << 20 | out[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in out if x >= 0]


class Encoder:
    """The transducer for one word: push bytes, take the tokens that can no longer change, finish at the word's end."""

    def __init__(self, vocabulary: Vocabulary, window: int = WINDOW):
        self.v, self.window, self.held = vocabulary, window, []

    def push(self, data: bytes) -> Iterator[int]:
        v = self.v
        for lo in range(0, len(data), self.window):
            self.held += [v.single[b] for b in data[lo : lo + self.window]]
            # one symbol stays: the last byte of a word has a symbol of its own
            while len(self.held) > self.window + v.lookahead + 1:
                fixed = len(self.held) - v.lookahead - 1
                done = 0
                for token in v.merged(self.held[:-1]):
                    size = len(v.bytes_of[token])
                    if done + size > fixed:
                        break
                    done += size
                    yield token
                if not done:
                    break
                del self.held[:done]

    def finish(self) -> list[int]:
        v, held = self.v, self.held
        self.held = []
        if not held:
            return []
        return v.merged([*held[:-1], v.final[v.bytes_of[held[-1]][0]]])

    def word(self, data: bytes) -> list[int]:
        if 0 < len(data) <= self.window and not self.held:  # no token leaves before the word's end
            return self.v.merged([*map(self.v.single.__getitem__, data[:-1]), self.v.final[data[-1]]])
        return [*self.push(data), *self.finish()]


class Decoder:
    """Ids to text, as they come: bytes of an unfinished character wait in the state; malformed ones become U+FFFD.

    `table` has the bytes of each id, `between` those between two ids.
    """

    def __init__(self, table: dict[int, bytes], between: bytes = b""):
        import codecs

        self.table, self.between, self.machine, self.begun = table, between, codecs.getincrementaldecoder("utf-8")("replace"), False

    def push(self, ids: Iterable[int]) -> str:
        data = self.between.join(map(self.table.__getitem__, ids))
        if self.begun:
            data = self.between + data
        self.begun = True
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def _ranges(kind: str, top: int = 0x250) -> str:
    """The characters below `top` of a Unicode class, as the inside of a character set."""
    hits = [c for c in range(top) if regex.fullmatch(kind, chr(c))]
    out, i = "", 0
    while i < len(hits):
        j = i
        while j + 1 < len(hits) and hits[j + 1] == hits[j] + 1:
            j += 1
        out += f"\\u{hits[i]:04x}-\\u{hits[j]:04x}"
        i = j + 1
    return out


class Memo(dict):
    """Words to what the transducer makes of them, without long words; when half of MEMO is full, these words become the
    older half, from which a word that comes again is taken over."""

    def __init__(self, vocabulary: Vocabulary):
        self.encoder, self.older = Encoder(vocabulary), {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = self.older.get(word)
        if got is None:
            data = word.encode()
            got = tuple(self.encoder.word(data))
            if len(data) > 64:
                return got
        if len(self) >= MEMO // 2:
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got


class Tokenizer:
    """Whole texts to ids and back, with a bounded memo of words; words are split as the vocabulary file states."""

    #: The endings that the vocabulary's pre-tokeniser splits off (fixed values of the format).
    ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        letter, number, space = _ranges(r"\p{L}"), _ranges(r"\p{N}"), _ranges(r"\p{White_Space}")
        self.near = re.compile(f"{self.ENDINGS}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+").findall
        self.far = regex.compile(rf"{self.ENDINGS}|\p{{L}}+|\p{{N}}|[^\p{{White_Space}}\p{{L}}\p{{N}}]+").findall
        self.other = re.compile("[^\\u0000-\\u024f]").search
        #: What continues an open word: letters after letters, marks after marks; a number never goes on.
        self.runs = [regex.compile(rf"\p{{L}}+"), regex.compile(rf"[^\p{{White_Space}}\p{{L}}\p{{N}}]+")]
        self.memo = Memo(self.v)
        self.bytes_of = self.v.bytes_of
        self.printed = {i: t.encode() for i, t in self.v.names.items()}

    def normal(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # characters are lowered one by one, without a final sigma

    def words(self, text: str) -> list[str]:
        return self.far(text) if self.other(text) else self.near(text)

    def settled(self, held: str) -> tuple[int, bool]:
        """Up to where `held` can be split whatever follows, and whether that place may be inside a word; 0: nowhere yet."""
        for space in " \n\t\r":
            if (at := held.rfind(space)) >= 0:
                return at + 1, False
        for at in range(len(held) - 1, max(len(held) - 4096, 20), -1):
            a, b = held[at - 1], held[at]
            whole = not (unicodedata.combining(a) or unicodedata.combining(b)) and unicodedata.is_normalized("NFC", a + b)
            if whole and "<" not in held[at - 20 : at] and "'" not in held[at - 3 : at]:
                return at, True
        return 0, False

    def stream(self, pieces: Iterable[str]) -> Iterator[Iterable[int]]:
        """The ids of the text that the pieces make up, as soon as they are stable. A piece, its overhang and one open word's
        window are all that is held."""
        held, open_word = "", None  # (run that goes on, its transducer)

        def split(text: str, cut: bool):
            nonlocal open_word
            parts = self.v.marks.split(text) if self.v.marks and "<|" in text else [text]
            for k, part in enumerate(parts):
                inside = cut and k + 1 == len(parts)
                if part in self.v.added:
                    if open_word:
                        yield open_word[1].finish()
                        open_word = None
                    yield (self.v.added[part],)
                    continue
                part = self.normal(part)
                if open_word:
                    more = open_word[0].match(part)
                    if more:
                        yield open_word[1].push(more[0].encode())
                        part = part[more.end() :]
                    if not part and inside:
                        return
                    yield open_word[1].finish()
                    open_word = None
                words = self.words(part)
                if inside and words and part.endswith(words[-1]):
                    last = words.pop()
                    yield chain.from_iterable(map(self.memo.__getitem__, words))
                    run = next((r for r in self.runs if r.fullmatch(last)), None)
                    if run is None:
                        yield self.memo[last]
                    else:
                        open_word = (run, Encoder(self.v))
                        yield open_word[1].push(last.encode())
                else:
                    yield chain.from_iterable(map(self.memo.__getitem__, words))

        for piece in pieces:
            held += piece
            if len(held) >= PIECE:
                at, inside = self.settled(held)
                if at:
                    yield from split(held[:at], inside)
                    held = held[at:]
        yield from split(held, False)

    def encode(self, text: str) -> list[int]:
        if len(text) < PIECE:
            return list(chain.from_iterable(self.stream((text,))))
        return list(chain.from_iterable(self.stream(text[i : i + PIECE] for i in range(0, len(text), PIECE))))

    def decoded(self, ids: list[int], table: dict[int, bytes], between: bytes, step: int = 4096) -> str:
        machine = Decoder(table, between)
        return "".join([*(machine.push(ids[i : i + step]) for i in range(0, len(ids), step)), machine.finish()])

    def joined(self, ids: list[int]) -> str:
        """The vocabulary's strings with a blank between: what a file without a decoder states."""
        return self.decoded(ids, self.printed, b" ")

    def text(self, ids: list[int]) -> str:
        """The bytes that the ids stand for, a word's end as a blank."""
        return self.decoded(ids, self.bytes_of, b"")


_held: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _held:
        _held[path] = Tokenizer(path)
    return _held[path]


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", rows: int = 64) -> DataFrame:
    """key, ids array<int>, decoded string for every row.

    A null text reads as empty: no ids, an empty decoded string. Repeated and null keys stay as they are; other columns
    of `docs` are not read, and an empty table gives no rows. Whole texts, no shuffle; a task holds `rows` texts, their
    ids and their decoded strings at a time.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                ids = [t.encode(x or "") for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(list(map(t.joined, ids)), pa.string())], ["key", "ids", "decoded"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)
