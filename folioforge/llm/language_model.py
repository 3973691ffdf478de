"""Gated recurrent language model for whole documents, in numpy.

The commonest words of the corpus are the head: classes of HEAD_CLASS words by rank. All other words fall into TAILS
classes by their ending. The network predicts the class of the next word (class-factored softmax) and, in a head class,
the word; in a tail class the word has its smoothed share of the class's counts, so every text has a probability. Counts
cover the whole corpus. The network starts from a bounded sample; then it learns from every training document, in turns:
in each, the documents of that turn are dealt by hash into parts of about COPY words, a copy trains on each part, and the
next turn starts from the mean of the copies: scores depend on the rows alone, not on how they lie in files. Gradients
are truncated after WINDOW words while the state runs on; in scoring it runs through the whole document.

Only what a document's rare words add depends on counts that are too many for a task: it is a sum over words, and comes
from a join.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import LOWER, discard, mix, range_hash, stored, text_slices, word_bounds
from folioforge.llm.jaccard import by_group, lists

HEAD, HEAD_CLASS, TAILS = 768, 32, 64
HIDDEN, WINDOW, LANES = 24, 20, 256
#: Words that scoring takes at a time in each lane.
STRIDE = 16
#: Rows of the output layer at a time: their logits stay in a core's cache.
BLOCK = 1024
#: Words of a text that training runs through before the state starts anew; scoring runs through the whole text.
PIECE = 2000
#: Documents of the first training, at most, and its rounds.
SAMPLE, ROUNDS = 1200, 3
#: The training documents are dealt into TURNS turns by hash; each turn trains on from the mean of the turn before.
TURNS, RATE = 4, 0.001
#: Words that one copy learns from in a turn, about; copies that are added up at a time.
COPY, FAN = 2_000_000, 32
#: Words whose counts every task holds, at most: the commonest.
COMMON = 300_000
END = HEAD
SYMBOLS = HEAD + 1 + TAILS
CLASSES = HEAD // HEAD_CLASS + 1 + TAILS

_PUNCT = np.zeros(256, np.uint8)
_PUNCT[[*b".,;:?"]] = 1
_PUNCT[[*b"!\"'#$%&()*+-/<=>@[]^_`{|}~\\"]] = 2


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, tail class, row) of every word, A-Z in lower case."""
    low = LOWER[data]
    starts, ends, rows = word_bounds(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), rows
    last, kind = ends - 1, np.zeros(len(starts), np.uint64)
    for _ in range(3):
        p = _PUNCT[low[last]]
        kind = np.maximum(kind, p)
        last = np.where((p > 0) & (last > starts), last - 1, last)
    a, b = low[last].astype(np.uint64), low[np.maximum(last - 1, starts)].astype(np.uint64)
    tail = (mix(a * np.uint64(256) + b + kind * np.uint64(65536)) >> np.uint64(40)) % np.uint64(TAILS)
    return range_hash(low, starts, ends), tail.astype(np.int64), rows


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, c, tail): occurrences of every word in `docs`; a task sends its own sums, at most about a million at a time."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed():
            h, c, t = (np.concatenate(x) for x in zip(*held))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, np.bincount(back, c, len(u)).astype(np.int64), t[first]

        def batch_of(h, c, t):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(t)], ["h", "c", "tail"])

        size = 0
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                h, t, _ = words_of(data, offs)
                if len(h):
                    held.append((h, np.ones(len(h), np.int64), t))
                    size += len(h)
                if size > 1_500_000:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*summed())

    return docs.select(text).mapInArrow(run, "h long, c long, tail long").groupBy("h").agg(F.sum("c").alias("c"), F.min("tail").alias("tail"))


def commonest(counts: DataFrame, most: int | None = None) -> pd.DataFrame:
    """About the `most` commonest words (all, if fewer; never more), by count, then hash.

    Two histograms of at most 65,536 rows find the cut, without a global sort: counts to ten binary digits tell which
    words are in for certain; of those at the cut, the ones whose mixed hash is below a bound.
    """
    most = most or COMMON
    rows = counts.withColumns({"_b": F.expr("CAST(floor(log2(c)) AS BIGINT)") * 4096 + F.expr("c >> greatest(CAST(floor(log2(c)) AS INT) - 10, 0)"), "_p": F.shiftrightunsigned(F.xxhash64("h"), 48)})
    sizes = rows.groupBy("_b").count().toPandas().sort_values("_b", ascending=False)
    total = sizes["count"].cumsum()
    over = sizes["_b"][total > most]
    if len(over):
        edge, room = int(over.iloc[0]), most - int(total[total <= most].max() if (total <= most).any() else 0)
        places = rows.where(F.col("_b") == edge).groupBy("_p").count().toPandas().sort_values("_p")
        fits = places["_p"][places["count"].cumsum() <= room]
        rows = rows.where((F.col("_b") > edge) | ((F.col("_b") == edge) & (F.col("_p") <= (int(fits.max()) if len(fits) else -1))))
    return rows.select("h", "c", "tail").toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)


# The network ---------------------------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def shifted(z: np.ndarray) -> np.ndarray:
    """Logits, in place, less what keeps their exponents within a float: one number, or one a row if they lie far apart."""
    if z.size:
        top = z.max()
        z -= top if top - z.min() < 60 else z.max(1, keepdims=True)
    return z


class Network:
    """Gated recurrent units over symbols with a class-factored output; parameters are one flat vector of float32."""

    SHAPES = {"x": (SYMBOLS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "w": (HEAD, HIDDEN), "wb": (HEAD,)}

    def __init__(self, flat_values: np.ndarray | None = None, shares: np.ndarray | None = None, seed: int = 4):
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        if flat_values is None:
            flat_values = (np.random.default_rng(seed).standard_normal(sum(sizes)) * 0.08).astype(np.float32)
        self.flat = np.array(flat_values, np.float32)
        self.p, at = {}, 0
        for (name, shape), n in zip(self.SHAPES.items(), sizes):
            self.p[name] = self.flat[at : at + n].reshape(shape)
            at += n
        if shares is not None:
            self.p["cb"][:] = np.log(np.maximum(shares, 1e-7))

    def states(self, inputs: np.ndarray, keep: np.ndarray, h: np.ndarray, memo: list | None = None) -> np.ndarray:
        """Hidden states after each of (time, lanes) inputs; keep is 0 where a document begins.

        memo takes what the way back needs: the states before each step, the gates, the candidates and their inner part.
        """
        u = np.ascontiguousarray(self.p["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))
        rzn = self.p["x"].reshape(-1, HIDDEN)[inputs[:, None, :] * 3 + np.arange(3)[:, None]]  # (time, 3, lanes, HIDDEN)
        out = np.empty((*inputs.shape, HIDDEN), np.float32)
        before, inner = (np.empty_like(out) for _ in range(2)) if memo is not None else (None, None)
        begins, g = keep.min(1) < 1, np.empty(rzn.shape[1:], np.float32)
        for t in range(len(inputs)):
            if begins[t]:
                h = h * keep[t][:, None]
            np.matmul(h, u, out=g)
            gates, n = rzn[t, :2], rzn[t, 2]
            gates += g[:2]
            sigmoid(gates)
            if memo is not None:
                before[t], inner[t] = h, g[2]
            g[2] *= gates[0]
            n += g[2]
            np.tanh(n, out=n)
            after = out[t]
            np.subtract(h, n, out=after)
            after *= gates[1]
            after += n
            h = after
        if memo is not None:
            memo += [before, rzn[:, 0], rzn[:, 1], rzn[:, 2], inner, begins]
        return out

    def in_class(self, h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, cuts, logits): the rows whose target is a head word, sorted by class, and the logits of their class's words."""
        rows = np.flatnonzero(y < HEAD)
        rows = rows[np.argsort(y[rows] // HEAD_CLASS, kind="stable")]
        cuts = np.searchsorted(y[rows] // HEAD_CLASS, np.arange(HEAD // HEAD_CLASS + 1)).tolist()
        z, own = np.empty((len(rows), HEAD_CLASS), h.dtype), h[rows]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                z[a:b] = own[a:b] @ self.p["w"][k * HEAD_CLASS : (k + 1) * HEAD_CLASS].T
        z += self.p["wb"].reshape(-1, HEAD_CLASS)[y[rows] // HEAD_CLASS]
        return rows, cuts, shifted(z)

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target symbol: its class and, in the head, the word in it."""
        out, classes, one = np.empty(len(h), h.dtype), class_of(target), np.ones(CLASSES, np.float32)
        for lo in range(0, len(h), BLOCK):
            at = slice(lo, lo + BLOCK)
            z = h[at] @ self.p["c"]
            z += self.p["cb"]
            shifted(z)
            out[at] = z[np.arange(len(z)), classes[at]]
            out[at] -= np.log(np.exp(z, out=z) @ one)
        rows, _, y = self.in_class(h, target)
        own = y[np.arange(len(rows)), target[rows] % HEAD_CLASS]
        out[rows] += own - np.log(np.exp(y, out=y) @ one[:HEAD_CLASS])
        return out

    def train(self, symbols: list[np.ndarray], rounds: int, rate: float, lanes: int = 48, seed: int = 0) -> int:
        """Truncated backpropagation through time over documents laid out in lanes; the number of words seen."""
        inputs, targets, keep, _ = laid_out([s[i : i + PIECE] for s in symbols for i in range(0, len(s), PIECE)], lanes)
        sizes = (targets >= 0).sum(0)
        square, first = np.full_like(self.flat, 1e-6), np.zeros_like(self.flat)
        step = 0
        for k in range(rounds):
            h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
            for lo in range(0, len(inputs), WINDOW):
                live = np.searchsorted(-sizes, -lo)  # the lanes that still have words: the first ones
                i, y, m = (np.ascontiguousarray(x[lo : lo + WINDOW, :live]) for x in (inputs, targets, keep))
                g, h = self.gradients(i, y, m, h[:live])
                step += 1
                first = 0.9 * first + 0.1 * g
                square = 0.995 * square + 0.005 * g * g
                pace = rate * (1 - 0.8 * (k * len(inputs) + lo) / (rounds * len(inputs)))
                self.flat -= (pace * first / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.995**step)) + 1e-6)
        return int((targets >= 0).sum())

    def gradients(self, inputs, targets, keep, h0):
        memo: list = []
        states = self.states(inputs, keep, h0, memo)
        rows = np.flatnonzero(targets.ravel() >= 0)
        h, y = states.reshape(-1, HIDDEN)[rows], targets.ravel()[rows]
        grads = Network(np.zeros_like(self.flat))
        share, one = np.float32(1 / max(len(rows), 1)), np.ones(max(CLASSES, BLOCK), np.float32)
        down, classes, out = np.empty_like(h), class_of(y), np.ascontiguousarray(self.p["c"].T)
        for lo in range(0, len(h), BLOCK):
            own = h[lo : lo + BLOCK]
            e = own @ self.p["c"]
            e += self.p["cb"]
            np.exp(shifted(e), out=e)
            e *= (share / (e @ one[:CLASSES]))[:, None]
            e[np.arange(len(e)), classes[lo : lo + BLOCK]] -= share
            grads.p["c"] += own.T @ e
            grads.p["cb"] += one[: len(e)] @ e
            np.matmul(e, out, out=down[lo : lo + BLOCK])
        at, cuts, f = self.in_class(h, y)
        np.exp(f, out=f)
        f *= (share / (f @ one[:HEAD_CLASS]))[:, None]
        f[np.arange(len(at)), y[at] % HEAD_CLASS] -= share
        own, more = h[at], np.empty((len(at), HIDDEN), f.dtype)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                words = slice(k * HEAD_CLASS, (k + 1) * HEAD_CLASS)
                grads.p["w"][words], grads.p["wb"][words] = f[a:b].T @ own[a:b], f[a:b].sum(0)
                more[a:b] = f[a:b] @ self.p["w"][words]
        down[at] += more
        d_states = down
        if len(rows) < inputs.size:
            d_states = np.zeros((inputs.size, HIDDEN), np.float32)
            d_states[rows] = down
        d_states = d_states.reshape(states.shape)
        before, r, z, n, inner, begins = memo
        rest = 1 - z
        to_n, to_z, to_r = rest * (1 - n * n), (before - n) * (z * rest), inner * (r * (1 - r))
        back, dh = np.ascontiguousarray(self.p["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0)), np.zeros_like(h0)
        d_r, d_z, d_n, d_inner = (np.empty_like(states) for _ in range(4))
        for t in range(len(inputs) - 1, -1, -1):
            dh += d_states[t]
            np.multiply(dh, to_n[t], out=d_n[t])
            np.multiply(d_n[t], to_r[t], out=d_r[t])
            np.multiply(dh, to_z[t], out=d_z[t])
            np.multiply(d_n[t], r[t], out=d_inner[t])
            dh *= z[t]
            for d, u in zip((d_r, d_z, d_inner), back):
                dh += d[t] @ u
            if begins[t]:
                dh *= keep[t][:, None]
        order = np.argsort(inputs.ravel().astype(np.uint16), kind="stable")
        used, first = np.unique(inputs.ravel()[order], return_index=True)
        for k, (d, i) in enumerate(zip((d_r, d_z, d_n), (d_r, d_z, d_inner))):
            part = slice(k * HIDDEN, (k + 1) * HIDDEN)
            grads.p["u"][:, part] = before.reshape(-1, HIDDEN).T @ i.reshape(-1, HIDDEN)
            grads.p["x"][used, part] = np.add.reduceat(d.reshape(-1, HIDDEN)[order], first, axis=0)
        return np.clip(grads.flat, -0.5, 0.5), states[-1]

    def document_scores(self, symbols: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of the class-and-head part of each document, with the state carried to its end."""
        inputs, targets, keep, doc = laid_out(symbols, LANES)
        h, out, sizes = np.zeros((inputs.shape[1], HIDDEN), np.float32), np.zeros(len(symbols)), (targets >= 0).sum(0)
        for lo in range(0, len(inputs), STRIDE):
            live = np.searchsorted(-sizes, -lo)
            i, y, m, d = (np.ascontiguousarray(x[lo : lo + STRIDE, :live]) for x in (inputs, targets, keep, doc))
            states = self.states(i, m, h[:live])
            h = states[-1]
            rows = np.flatnonzero(y.ravel() >= 0)
            got = self.log_probability(states.reshape(-1, HIDDEN)[rows], y.ravel()[rows])
            out += np.bincount(d.ravel()[rows], got.astype(np.float64), len(symbols))
        return out


def class_of(symbol: np.ndarray) -> np.ndarray:
    return np.where(symbol < HEAD, symbol // HEAD_CLASS, symbol - HEAD + HEAD // HEAD_CLASS)


def laid_out(symbols: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, keep, document) as (time, lanes): whole documents one after another, the longest first, each in
    the lane with the least, lanes with more words first. A document's input is its own text, one word late, after an END;
    targets past the last are -1."""
    lanes = max(1, min(lanes, len(symbols)))
    heap, rows = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for d in sorted(range(len(symbols)), key=lambda d: (-len(symbols[d]), d)):
        size, k = heap[0]
        rows[k].append(d)
        heapq.heapreplace(heap, (size + len(symbols[d]), k))
    rows = [rows[k] for _, k in sorted(heap, key=lambda x: (-x[0], x[1]))]
    steps = max((s for s, _ in heap), default=0)
    targets, doc = np.full((lanes, steps), -1, np.int32), np.zeros((lanes, steps), np.int32)
    keep = np.ones((lanes, steps), np.float32)
    for k, ds in enumerate(rows):
        at = 0
        for d in ds:
            n = len(symbols[d])
            targets[k, at : at + n], doc[k, at : at + n] = symbols[d], d
            keep[k, at] = 0
            at += n
    inputs = np.full_like(targets, END)
    inputs[:, 1:] = np.where(targets[:, :-1] >= 0, targets[:, :-1], END)
    return tuple(np.ascontiguousarray(x.T) for x in (inputs, targets, keep, doc))


class Lookup:
    """Places of hashes in an ascending array of distinct ones; their first 20 bits lead to a few neighbours at most."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.starts = np.searchsorted(known, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        ends = np.append(self.starts[1:], len(known))
        self.longest = int((ends - self.starts).max(initial=0))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each hash; a place that is not there is any."""
        if not len(self.known):
            return np.zeros(len(h), np.int32), np.zeros(len(h), bool)
        last = np.int32(len(self.known) - 1)
        at = np.minimum(self.starts[(h >> np.uint64(44)).astype(np.int32)], last)
        there = self.known[at] == h
        left = np.flatnonzero(~there)
        for k in range(1, self.longest):
            place = np.minimum(at[left] + np.int32(k), last)
            hit = self.known[place] == h[left]
            at[left[hit]], there[left[hit]] = place[hit], True
            left = left[(self.known[place] < h[left])]
            if not len(left):
                break
        return at, there


class Vocabulary:
    """The head words by rank, as hashes, and the class counts."""

    def __init__(self, head: np.ndarray):
        self.order = np.argsort(head)
        self.sorted = head[self.order]

    def symbols(self, h: np.ndarray, tail: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
        """The symbols of each of n rows, END last."""
        out = (HEAD + 1 + tail).astype(np.int32)
        if len(self.sorted) and len(h):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            out = np.where(self.sorted[at] == h, self.order[at].astype(np.int32), out)
        return self.by_row(out, rows, n)

    @staticmethod
    def by_row(symbols: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
        cuts = np.searchsorted(rows, np.arange(n + 1))
        return [np.append(symbols[cuts[i] : cuts[i + 1]], np.int32(END)) for i in range(n)]


def added(rows: DataFrame, size: int) -> DataFrame:
    """(part, n, w): the sums of n and w over each FAN parts in a row, always in the order of the parts."""

    def body(t: pa.Table):
        total = np.zeros(size)
        for w in t["w"].to_pylist():
            total += np.frombuffer(w)
        yield pa.RecordBatch.from_arrays([t["part"][:1].combine_chunks(), pa.array([sum(t["n"].to_pylist())]), pa.array([total.tobytes()])], ["part", "n", "w"])

    dealt = rows.select(F.expr(f"part DIV {FAN}").alias("part"), F.col("part").alias("_at"), "n", "w")
    return dealt.repartition("part").sortWithinPartitions("part", "_at").select("part", "n", "w").mapInArrow(by_group([], body), "part long, n long, w binary")


def symbol_rows(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """(part, o, sym): the symbols of each text of rows (part, o, text), two bytes each."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch.column(2)):
                got = [x.astype(np.uint16).tobytes() for x in shared.value.symbols(*words_of(data, offs), hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(got, pa.binary())], ["part", "o", "sym"])

    return rows.select("part", "o", "text").mapInArrow(run, "part long, o long, sym binary")


def averaged(parts: DataFrame, copies: int, start: np.ndarray, rate: float) -> np.ndarray:
    """The mean, by words, of copies of the network: one trains on each part of rows (part, o, sym), in the order of o.

    What a copy sees is settled by the parts alone, not by files or tasks. The copies are added up FAN at a time, so no
    task and not the driver holds more than FAN of them.
    """
    shared = parts.sparkSession.sparkContext.broadcast(start)

    def body(t: pa.Table):
        net = Network(shared.value)
        seen = net.train([np.frombuffer(x, np.uint16).astype(np.int32) for x in t["sym"].to_pylist()], 1, rate, LANES)
        yield pa.RecordBatch.from_arrays([t["part"][:1].combine_chunks(), pa.array([seen]), pa.array([(net.flat * np.float64(seen)).tobytes()])], ["part", "n", "w"])

    got = parts.repartition(max(copies, 1), "part").sortWithinPartitions("part", "o").select("part", "sym").mapInArrow(by_group([], body), "part long, n long, w binary")
    while copies > FAN:
        got, copies = added(got, len(start)), -(-copies // FAN)
    rows = sorted(got.collect(), key=lambda r: r.part)  # FAN rows at most
    n = sum(r.n for r in rows)
    return start if not n else (sum(np.frombuffer(r.w) for r in rows) / n).astype(np.float32)


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; logs to base 10.

    Learns from the rows whose `held_out` is false. Words are runs without \\x20 and \\x09-\\x0D, A-Z in lower case; each
    text ends with one more token. base_score: the sum of log10((c + 1) / (N + V + 1)) over the tokens. score: the
    network's log10 probability of the whole text. A null text is the end token alone. Without any training row both
    have the value of an untrained model; repeated rows and keys are scored one by one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), held_out.alias("held"), F.col(text).alias("text"))
    learn = rows.where(~F.col("held"))
    counts = stored(word_counts(learn))
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = learn.count()
    total, kinds = facts.n + ends, facts.v + (ends > 0)
    common = commonest(counts)
    head = common["h"].to_numpy()[:HEAD].astype(np.int64).view(np.uint64)
    words = Vocabulary(head)
    sums = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas().set_index("tail").reindex(range(TAILS), fill_value=0)
    of_head = common[:HEAD].groupby("tail")["c"].agg(["sum", "count"]).reindex(range(TAILS), fill_value=0)
    tail_words, tail_kinds = (sums["c"] - of_head["sum"]).to_numpy(float), (sums["v"] - of_head["count"]).to_numpy(float)
    shares = np.concatenate([np.add.reduceat(np.append(common["c"].to_numpy(float)[:HEAD], np.zeros(HEAD - len(head))), np.arange(0, HEAD, HEAD_CLASS)), [ends], tail_words]) + 1.0

    copies = max(1, -(-total // (TURNS * COPY)))
    part = F.pmod(F.xxhash64("key", "text", F.lit(31)), F.lit(TURNS * copies))
    dealt = stored(symbol_rows(learn.select(part.alias("part"), F.xxhash64("text", "key").alias("o"), "text"), words))
    net = Network(shares=shares / shares.sum())
    sample = [np.frombuffer(r.sym, np.uint16).astype(np.int32) for r in dealt.orderBy("o", "sym").limit(SAMPLE).select("sym").collect()]
    if sample:
        net.train(sample, ROUNDS, 0.01)
    weights = net.flat.copy()
    for k in range(TURNS if sample else 0):
        weights = averaged(dealt.where(F.expr(f"part % {TURNS} = {k}")).withColumn("part", F.expr(f"part DIV {TURNS}")), copies, weights, RATE)
    discard(dealt)

    order = np.argsort(common["h"].to_numpy().astype(np.int64).view(np.uint64)) if len(common) else np.zeros(0, int)
    held_h = common["h"].to_numpy().astype(np.int64).view(np.uint64)[order]
    held_c = common["c"].to_numpy().astype(np.int64)[order]
    held_symbol = np.where(order < HEAD, order, -1).astype(np.int32)  # -1: a word of its tail class
    tail_log = np.log10(tail_words + tail_kinds + 1)
    shared = spark.sparkContext.broadcast((weights, held_h, np.log10(held_c + 1.0), held_symbol, tail_log, float(np.log10(ends + 1.0))))
    all_common = facts.v <= COMMON

    def run(batches):
        w, hs, logs, symbol, tails, end_log = shared.value
        net, common_words = Network(w), Lookup(hs)
        for batch in batches:
            done, far = [], []  # texts of more than PIECE words run side by side, once for the batch
            for lo, hi, data, offs in text_slices(batch.column(2), 8_000_000):
                n = hi - lo
                parts = [words_of(data[a:b], o) for a, b, o in cut(data, offs)]
                firsts = np.cumsum([0, *(len(o) - 1 for _, _, o in cut(data, offs))])
                h, tail = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                of = np.concatenate([p[2] + f for p, f in zip(parts, firsts)])
                at, found = common_words.find(h)
                log = np.where(found, logs[at] if len(hs) else 0.0, 0.0)
                in_tail = ~found | (symbol[at] < 0) if len(hs) else ~found
                flat_symbols = np.where(in_tail, HEAD + 1 + tail, symbol[at] if len(hs) else 0).astype(np.int32)
                symbols = Vocabulary.by_row(flat_symbols, of, n)
                size = np.bincount(of, minlength=n)
                near = np.flatnonzero(size <= PIECE)
                model = np.bincount(of, np.where(in_tail, log - tails[tail], 0.0), n)
                model[near] += net.document_scores([symbols[i] for i in near]) / np.log(10)
                far += [(len(done), i, symbols[i]) for i in np.flatnonzero(size > PIECE)]
                rare = ~found & (not all_common)
                rare_lists = lists(h[rare].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(of[rare], minlength=n))]))
                done.append((lo, model, pa.array(size + 1), pa.array(np.bincount(of, found, n).astype(np.int64)), pa.array(np.bincount(of, log, n) + end_log), rare_lists))
            for (k, i, _), x in zip(far, net.document_scores([x for _, _, x in far]) / np.log(10)):
                done[k][1][i] += x
            for lo, model, tokens, known, base, rare_lists in done:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(model)), batch.column(1).slice(lo, len(model)), tokens, known, base, pa.array(model), rare_lists], ["key", "held", "n_tokens", "n_known", "base", "model", "rare"])

    kind = rows.schema["key"].dataType.simpleString()
    done = rows.mapInArrow(run, f"key {kind}, held boolean, n_tokens long, n_known long, base double, model double, rare array<long>")
    if not all_common:
        done = stored(done.withColumn("id", F.monotonically_increasing_id()))
        rare = done.select("id", F.explode("rare").alias("h")).groupBy("id", "h").count()
        more = rare.join(counts.select("h", "c"), "h").groupBy("id").agg(F.sum("count").alias("_k"), F.sum(F.col("count") * F.log10(F.col("c") + 1.0)).alias("_l"))
        done = done.join(more, "id", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("_k", F.lit(0)), "base": F.col("base") + F.coalesce("_l", F.lit(0.0)), "model": F.col("model") + F.coalesce("_l", F.lit(0.0))})
    space = float(np.log10(total + kinds + 1.0))
    return done.select(F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(space)).alias("base_score"), F.col("model").alias("score"))


def cut(data: np.ndarray, offs: np.ndarray, limit: int = 1 << 20):
    """(from, to, offsets) of runs of whole rows of about `limit` bytes."""
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield offs[lo], offs[hi], offs[lo : hi + 1] - offs[lo]
        lo = hi
