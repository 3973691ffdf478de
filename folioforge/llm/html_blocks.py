"""HTML extraction with a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block has two vectors: its tag path (tags, classes, ids and roles
on the way down, hashed) and its words (hashed). A bidirectional LSTM in numpy reads the sequence in both directions,
so the label of every block rests on the whole page. The labeller is trained here, on pages that a seeded generator
writes in many layouts with known article blocks, and on a bounded sample of the given pages whose blocks stand below
telling containers.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH, WORDS, HIDDEN = 96, 64, 16
#: Generated pages, and pages of the input at most, that the labeller is trained on; rounds over them.
GENERATED, SAMPLE, ROUNDS = 360, 200, 14

#: Fixed values of HTML: elements that end a block, that have no content, and whose content is no text.
BLOCKS = frozenset("address article aside blockquote body br canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav noscript ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset("script style template noscript textarea title select option button svg math iframe object head datalist".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
#: An open element of the first kind ends where an element of the second begins.
ENDS = {"p": BLOCKS - {"br", "link", "meta", "col", "option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_TAG = re.compile(r"<(?:!--(?:.*?)(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


@lru_cache(4096)
def labels_of(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to the path: its tag and the words of its class, id and role; `!hidden` if it isn't shown."""
    out = [tag]
    for name, a, b, c in _ATTR.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "hidden" or name.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.append("!hidden")
        elif name.lower() != "style":
            out += [f".{w}" for w in _NAME.findall(value)]
    return tuple(out)


class Path:
    """The elements around a block: the hashed cells of their labels as bits, and which telling labels are among them.

    Each element adds to what its parent has, so a block costs the same at any depth.
    """

    __slots__ = ("bits", "yes", "no")

    def __init__(self, labels: tuple[str, ...] = (), parent: Path | None = None):
        bits, self.yes, self.no = 0, not _TELLS_YES.isdisjoint(labels), not _TELLS_NO.isdisjoint(labels)
        for w in labels:
            if parent is not None or w not in ("html", "body"):
                bits |= 1 << zlib.crc32(w.encode()) % PATH
        if parent is not None:
            bits, self.yes, self.no = bits | parent.bits, self.yes or parent.yes, self.no or parent.no
        self.bits = bits


#: Path labels that tell a block apart in the sample of real pages.
_TELLS_NO = frozenset("nav footer aside form header .ad .ads .advert .advertisement .sidebar .menu .cookie .comments .comment .newsletter .related .share .social .promo".split())
_TELLS_YES = frozenset("article main .content .article .post .entry".split())
_ENDED_BY = {tag: tuple(e for e in ENDS if tag in ENDS[e]) for tag in BLOCKS}


def blocks(page: str) -> list[tuple[Path, str]]:
    """(path, text) of the leaf blocks in page order: references decoded, white space made one blank, trimmed.

    Time grows with the page alone, however deep elements are nested: open elements are found by tag.
    """
    out, stack, words, quiet, pos = [], [], [], 0, 0
    open_at: dict[str, list[int]] = {}
    open_blocks: list[int] = []
    n, root = len(page), Path()

    def flush():
        if words:
            text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
            words.clear()
            if text:
                out.append((stack[-1][2] if stack else root, text))

    def pop():
        nonlocal quiet
        tag, labels, _ = stack.pop()
        open_at[tag].pop()
        if tag in BLOCKS:
            open_blocks.pop()
        quiet -= tag in HIDDEN_TEXT or "!hidden" in labels

    def last(tag: str) -> int:
        at = open_at.get(tag)
        return at[-1] if at else -1

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos and not quiet:
            words.append(page[pos:at])
        if at >= n:
            break
        m = _TAG.match(page, at)
        if not m:
            if not quiet:
                words.append("<")
            pos = at + 1
            continue
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCKS:
            flush()
        if m[1]:
            depth = last(tag)
            if depth >= 0 and (tag in BLOCKS or not open_blocks or open_blocks[-1] <= depth):
                while len(stack) > depth:
                    pop()
            continue
        if tag in BLOCKS:
            ends = max(map(last, _ENDED_BY[tag]), default=-1)
            if ends >= 0 and ends > max(map(last, STOPS.get(tag, ())), default=-1):
                while len(stack) > ends:
                    pop()
        if tag in VOID:
            continue
        labels = labels_of(tag, m[3]) if m[3] else (tag,)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            open_blocks.append(len(stack))
        stack.append((tag, labels, Path(labels, stack[-1][2] if stack else None)))
        quiet += tag in HIDDEN_TEXT or "!hidden" in labels
        if tag in RAW:
            end = _RAW_END[tag].search(page, pos)
            pos = end.start() if end else n
    flush()
    return out


@lru_cache(65_536)
def path_vector(bits: int) -> np.ndarray:
    """A one in each cell of the path."""
    v = np.unpackbits(np.frombuffer(bits.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
    v.flags.writeable = False
    return v


class Cells(dict):
    """Words to their hashed cells."""

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[w] = zlib.crc32(w.encode()) % WORDS
        return got


_cells = Cells()


def word_vector(text: str) -> np.ndarray:
    words = text.lower().split()
    counts = np.bincount([_cells[w] for w in words], minlength=WORDS).astype(np.float32)
    return np.append(counts / max(len(words), 1), [np.log1p(len(words)) / 6, text.count(".") / (1 + len(words)), len(text) / 60 / (1 + len(words))]).astype(np.float32)


INPUT = PATH + WORDS + 3


def features(found: list) -> np.ndarray:
    return np.array([np.concatenate([path_vector(p.bits), word_vector(t)]) for p, t in found], np.float32).reshape(-1, INPUT)


# The labeller --------------------------------------------------------------------------------------------------------


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic output, trained by Adam on padded batches."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = (r.standard_normal((INPUT, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.p[f"u{d}"] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            self.p[f"c{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.p["o"] = (r.standard_normal((2 * HIDDEN + INPUT, 1)) * 0.1).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def pass_one(self, x, mask, d, keep=False):
        """Hidden states of one direction over (time, batch, INPUT); masked steps hold the state."""
        w, u, c0 = self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        t, b, _ = x.shape
        z_in = x @ w + c0
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        states, memo = np.zeros((t, b, HIDDEN), np.float32), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = z_in[s] + h @ u
            i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[s][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                memo.append((s, i, f, o, g, c, h, tc, m))
            c, h = m * new + (1 - m) * c, m * (o * tc) + (1 - m) * h
            states[s] = h
        return states, memo

    def logits(self, x, mask):
        f, _ = self.pass_one(x, mask, "f")
        b, _ = self.pass_one(x, mask, "b")
        return (np.concatenate([f, b, x], 2) @ self.p["o"])[..., 0] + self.p["ob"]

    def gradients(self, x, y, mask):
        f, mf = self.pass_one(x, mask, "f", True)
        b, mb = self.pass_one(x, mask, "b", True)
        both = np.concatenate([f, b, x], 2)
        e = (sigmoid((both @ self.p["o"])[..., 0] + self.p["ob"]) - y) * mask / max(mask.sum(), 1)
        out = {"o": np.einsum("tbk,tb->k", both, e)[:, None], "ob": np.array([e.sum()])}
        for d, memo, part in (("f", mf, slice(0, HIDDEN)), ("b", mb, slice(HIDDEN, 2 * HIDDEN))):
            u, down = self.p[f"u{d}"], e[..., None] * self.p["o"][part, 0]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            du, dh, dc = np.zeros_like(u), np.zeros(x.shape[1:2] + (HIDDEN,), np.float32), np.zeros(x.shape[1:2] + (HIDDEN,), np.float32)
            for s, i, fg, o, g, c, h, tc, m in reversed(memo):
                dh = dh + down[s]
                dnew = m * (dc + dh * o * (1 - tc * tc))
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * fg * (1 - fg), m * dh * tc * o * (1 - o), dnew * i * (1 - g * g)], 1)
                dz_all[s] = dz
                du += h.T @ dz
                dh, dc = (1 - m) * dh + dz @ u.T, (1 - m) * dc + dnew * fg
            out[f"u{d}"], out[f"w{d}"], out[f"c{d}"] = du, np.einsum("tbi,tbk->ik", x, dz_all, optimize=True), dz_all.sum((0, 1))
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, rate: float = 0.01, batch: int = 24, seed: int = 1):
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(rounds):
            order = r.permutation(len(pages))
            order = order[np.argsort([len(pages[i][1]) for i in order], kind="stable")]
            cuts = [order[i : i + batch] for i in range(0, len(order), batch)]
            for k in r.permutation(len(cuts)):
                x, mask = padded([pages[i][0] for i in cuts[k]])
                y, _ = padded([pages[i][1][:, None] for i in cuts[k]])
                step += 1
                for name, g in self.gradients(x, y[..., 0], mask).items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.99 * s[name] + 0.01 * g * g
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is article text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and len(pages[order[hi]]) * (hi - lo + 1) <= 20_000:
                hi += 1
            x, mask = padded([pages[i] for i in order[lo:hi]])
            z = self.logits(x, mask)
            for k, i in enumerate(order[lo:hi]):
                out[i] = z[: len(pages[i]), k] > 0
            lo = hi
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, rows))
    x, mask = np.zeros((t, len(rows), rows[0].shape[1]), np.float32), np.zeros((t, len(rows)), np.float32)
    for k, v in enumerate(rows):
        x[: len(v), k], mask[: len(v), k] = v, 1
    return x, mask


# Training pages ------------------------------------------------------------------------------------------------------

_OUTSIDE = {
    "nav": ("<nav>", "<div class=\"menu\">", "<ul id=\"main-menu\">", "<div id=\"navbar\" role=\"navigation\">", "<nav class=\"breadcrumb\">", "<ul class=\"nav\">"),
    "header": ("<header>", "<div id=\"header\">", "<div class=\"site-header\">", "<header class=\"top banner\">"),
    "footer": ("<footer>", "<div id=\"footer\">", "<div class=\"site-footer copyright\">", "<footer class=\"page-footer\">"),
    "side": ("<aside>", "<div class=\"sidebar\">", "<div id=\"sidebar-right\">", "<aside class=\"related\">", "<div class=\"widget\">", "<section class=\"related-posts\">"),
    "ad": ("<div class=\"ad\">", "<div class=\"advert\">", "<div id=\"ads-top\">", "<div class=\"sponsored promo\">", "<aside class=\"ad banner\">", "<div class=\"advertisement\">"),
    "notice": ("<div class=\"cookie\">", "<div id=\"cookie-notice\">", "<div class=\"notice consent\">", "<div role=\"alert\" class=\"popup\">", "<div class=\"newsletter\">", "<div class=\"subscribe\">"),
    "form": ("<form>", "<form class=\"search\">", "<form id=\"login\">", "<form action=\"/s\">"),
    "talk": ("<section class=\"comments\">", "<div id=\"comments\">", "<div class=\"comment-list\">", "<ol class=\"comment\">", "<section id=\"discussion\" class=\"responses\">"),
    "share": ("<div class=\"share\">", "<div class=\"social\">", "<ul class=\"tags share\">"),
}
_INSIDE = ("<article>", "<main>", "<div class=\"content\">", "<div id=\"content\">", "<article class=\"post\">", "<main id=\"main\"><article>", "<div class=\"entry-content\">", "<div class=\"article-body\">", "<section class=\"story\">", "<div class=\"post-content\">")


def _close(opened: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z0-9]+)", opened)))


def generated(r: random.Random) -> tuple[str, set[str]]:
    """A page, and the texts of its blocks that are the article."""
    word = lambda: "".join(r.choices("aeioulnrsthdm", k=r.randint(2, 9)))
    line = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice(["", ".", ".", "."])
    good: set[str] = set()

    def inner(kind: str) -> str:
        if kind in ("nav", "share") or kind == "footer" and r.random() < 0.5:
            items = "".join(f"<li><a href=\"/{word()}\">{word()}</a></li>" for _ in range(r.randint(2, 7)))
            return items if r.random() < 0.3 else f"<ul>{items}</ul>"
        if kind == "form":
            return f"<label>{word()}</label><input name=\"q\"><p>{line(1, 5)}</p><button>{word()}</button>"
        if kind == "talk":
            return "".join(r.choice(["<div class=\"comment\"><p>{}</p></div>", "<li><b>{}</b><p>{}</p></li>", "<p>{}</p>", "<blockquote>{}</blockquote>"]).format(line(1, 20), line(3, 40)) for _ in range(r.randint(1, 5)))
        text = r.choice(["<p>{}</p>", "{}", "<h3>{}</h3><p>{}</p>", "<p>{}<br>{}</p>", "<div>{}</div>"])
        return text.format(line(1, 30), line(2, 30))

    def outside(kinds: str) -> str:
        out = ""
        for kind in kinds.split():
            if r.random() < 0.5:
                o = r.choice(_OUTSIDE[kind])
                out += o + inner(kind) + _close(o)
        return out

    def told(a: int, b: int) -> str:
        t = line(a, b)
        good.add(t)
        return t

    body = f"<h1>{told(1, 9)}</h1>" if r.random() < 0.85 else ""
    for _ in range(r.randint(1, 14)):
        body += r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}<p>{}", "<h2>{}</h2><p>{}</p>", "<p><b>{}<br><p>{}</p>", "<ul><li>{}</li><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<table><tr><td>{}</td><td>{}</td></tr></table>", "<pre>{}</pre>", "<p>{}<br>{}</p>", "<figure><figcaption>{}</figcaption></figure>"]).format(told(1, 60), told(1, 60))
        if r.random() < 0.12:
            body += outside("ad share side notice form")
    if r.random() < 0.3:
        body += outside("share talk")
    shell = r.choice(_INSIDE)
    page = outside("notice header nav ad") + (outside("side ad") if r.random() < 0.4 else "") + shell + body + _close(shell) + outside("talk side form ad share notice") + outside("footer")
    if r.random() < 0.3:
        page = f"<div class=\"{r.choice(['wrapper', 'container', 'page', 'row'])}\">{page}</div>"
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>", good


def train(pages: list[str], seed: int = 11) -> Labeller:
    r, seen = random.Random(seed), []
    for _ in range(GENERATED):
        page, good = generated(r)
        found = blocks(page)
        if found:
            seen.append((features(found), np.array([t in good for _, t in found], np.float32)))
    for page in pages:
        found = blocks(page)
        no = [p.no for p, _ in found]
        yes = [p.yes and not p.no for p, _ in found]
        if found and any(yes) and all(a or b for a, b in zip(yes, no)):
            seen.append((features(found), np.array(yes, np.float32)))
    return Labeller().fit(seen)


def extract(pages: DataFrame, key: str = "page_id", column: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns `keep`, and `text`: the article's blocks in page order, joined by line feeds; empty if none.

    A null page reads as empty; null keys and repeated rows stay as they are, and an empty table gives no rows. The
    labeller is trained on the driver from GENERATED generated pages and at most SAMPLE
    pages of the input; every page is then labelled where it is read, block by block, as a whole.
    """
    some = pages.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("h")).where(F.length("h") < 50_000)
    chosen = some.select("k", F.xxhash64("h").alias("_o")).orderBy("_o", "k").limit(SAMPLE)
    got = some.join(F.broadcast(chosen.distinct()), (some.k == chosen.k) & (F.xxhash64(some.h) == F.col("_o")), "left_semi").select("h").limit(SAMPLE).toPandas()["h"]
    model = train(sorted(got))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = [key, *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema) + ", text string"

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                found = [blocks(x or "") for x in part.column(len(names)).to_pylist()]
                labels = m.label([features(f) for f in found])
                texts = ["\n".join(t for (_, t), good in zip(f, y) if good) for f, y in zip(found, labels)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*names, "text"])

    return pages.select(*names, F.col(column).alias("_html")).mapInArrow(run, schema)
