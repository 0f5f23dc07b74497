"""A gated recurrent language model in numpy, and the unigram base score over the whole corpus.

Counting goes in two steps. Tasks count their own training words and hand the partial counts on by word bucket, so a word
that stands in every document costs one entry a task. The ``LISTED`` most frequent words (those above the count that a histogram
over all words gives) then travel to every task; only words outside that list, each with less than one in ``LISTED`` of all
tokens, go to their bucket once more to fetch their counts. No bucket is hot, and nothing of the vocabulary's size reaches one
machine.

Model: the network's own words are the most frequent ones, ``size * size`` with ``size = 2 ** floor(log2(tokens) / 5)``, 32 at
least, so the list grows with the training text. All other words are one class member, spelled by their share among the rest of
the training words, so the model is a distribution over all words and one unseen word. Output is class-factored: P(class)
times P(word in class). A first model learns ``WARM_ROWS`` training documents; then the training documents are dealt to groups by
a hash of their contents, sorted by it, and each group's model goes on from the first by truncated backpropagation with a
gradient for every window and every token; the groups' models are averaged by their tokens. Groups and their order depend on the
documents alone, so the model does not depend on partitions but for the rounding of sums. Scoring carries the state through
whole documents.

Training documents are those whose crc32 of doc_id modulo 5 is not 1. Defined results: a null text is empty and has the end
token only; a null doc_id is held out; repeated rows count and are scored each, with equal scores up to rounding; words of equal
count are listed in the order of their hashes; texts of any length are learned and scored whole; an empty table gives no rows; other
columns, whatever their names, are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, buckets, drop, materialize
from .words import Words, mix, slices

LISTED = 1 << 16
HIDDEN = 16
WINDOW = 24
STREAMS = 512
STREAM_LENGTH = 1008
GROUP_TOKENS = 4_000_000  # tokens of a training group, more if there would be more than MOST_GROUPS
MOST_GROUPS = 4096
WARM_ROWS = 300
WARM_EPOCHS = 3
RATE = 0.08
PART_ROWS = 20_000  # documents whose sums are added up together
COUNT_TOKENS = 3_000_000  # tokens that a task counts together
SHORT, SCORE_TOKENS = 1024, 3_000_000  # tokens of a short document, tokens scored side by side

END, OTHER = 0, 1
END_HASH = np.uint64(0xA5A5_0F0F_1234_5678)


def learns(column: str = "doc_id") -> Column:
    """Whether a row is one of the training documents."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) != 1, F.lit(False))


class Tokens:
    """Word hashes of a slice with one end token behind each row; ``first``: where each row begins."""

    def __init__(self, column: pa.Array):
        w = Words(column, lower=True)
        n = len(column)
        self.first = w.first + np.arange(n + 1)
        self.hashes = np.empty(len(w.starts) + n, np.uint64)
        ends = self.first[1:] - 1
        inside = np.ones(len(self.hashes), bool)
        inside[ends] = False
        self.hashes[inside] = w.hashes()
        self.hashes[ends] = END_HASH

    def sequence_ids(self) -> np.ndarray:
        """A 64-bit hash of each row's token sequence, signed."""
        place = np.arange(len(self.hashes)) - np.repeat(self.first[:-1], np.diff(self.first))
        x = mix(self.hashes + mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return mix(np.add.reduceat(x, self.first[:-1])).view(np.int64) if len(self.first) > 1 else np.zeros(0, np.int64)


# --- Counting ------------------------------------------------------------------------------------------------------

COUNTED = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("ends", pa.int64()), ("histogram", pa.binary())])
COUNTED_DDL = "bucket int, words binary, counts binary, n long, v long, ends long, histogram binary"
EXACT, BINS = 1024, 1024 + 16 * 54


def _cuts(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where the buckets begin in sorted hashes; buckets are equal ranges of the hashes' upper 16 bits."""
    return np.searchsorted((hashes >> np.uint64(48)) * np.uint64(n_buckets) >> np.uint64(16), np.arange(n_buckets + 1, dtype=np.uint64))


def _bin(count: np.ndarray) -> np.ndarray:
    """Histogram place of a count: itself below ``EXACT``, then 16 places for each doubling."""
    return np.where(count < EXACT, count, EXACT + np.floor(16 * np.log2(np.maximum(count, EXACT) / EXACT)).astype(np.int64))


def word_counts(docs: DataFrame, n_buckets: int) -> DataFrame:
    """One row a bucket: its training words in order of their hashes and their counts, both packed, and totals."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            c = c.astype(np.uint32)
            cut = _cuts(h, n_buckets)
            some = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([h[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()), pa.array([c[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary())], ["bucket", "words", "counts"])

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                held.append(Tokens(part.column(0)).hashes)
                size += len(held[-1])
                if size >= COUNT_TOKENS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def total(key, table):
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()])
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        h, c = h[at], np.add.reduceat(c, at)
        values = (key[0].as_py(), h.tobytes(), c.tobytes(), int(c.sum()), len(c), int(c[h == END_HASH].sum()), zlib.compress(np.bincount(_bin(c), minlength=BINS).tobytes(), 1))
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, COUNTED, strict=True)], schema=COUNTED)

    texts = docs.filter(learns()).select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(partial, "bucket int, words binary, counts binary").groupBy("bucket").applyInArrow(total, COUNTED_DDL)


def frequent_words(counted: DataFrame, limit: int = LISTED) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """(tokens, distinct words, end tokens, hashes, counts): all words above the count that leaves at most ``limit`` of them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = v = ends = 0
        histogram = np.zeros(BINS, np.int64)
        for batch in batches:
            for a, b, c, h in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                n, v, ends, histogram = n + a, v + b, ends + c, histogram + np.frombuffer(zlib.decompress(h), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([v], pa.int64()), pa.array([ends], pa.int64()), pa.array([zlib.compress(histogram.tobytes(), 1)], pa.binary())], ["n", "v", "ends", "histogram"])

    parts = counted.select("n", "v", "ends", "histogram").repartition(8).mapInArrow(add, "n long, v long, ends long, histogram binary").collect()
    histogram = sum((np.frombuffer(zlib.decompress(bytes(r.histogram)), np.int64) for r in parts), np.zeros(BINS, np.int64))
    above = np.cumsum(histogram[::-1])[::-1]  # words in this place or a higher one
    least = int(np.argmax(above <= limit)) if (above <= limit).any() else BINS

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count = np.frombuffer(c, np.int64)
                use = _bin(count) >= max(least, 1)
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(w, np.uint64)[use].tobytes()], pa.binary()), pa.array([count[use].tobytes()], pa.binary())], ["words", "counts"])

    got = counted.select("words", "counts").mapInArrow(pick, "words binary, counts binary").collect()  # at most ``limit`` words
    h = np.frombuffer(b"".join(bytes(r.words) for r in got), np.uint64)
    c = np.frombuffer(b"".join(bytes(r.counts) for r in got), np.int64)
    ends = sum(r.ends for r in parts)
    if ends:  # the end token is listed in any case
        h, c = np.append(h[h != END_HASH], END_HASH), np.append(c[h != END_HASH], ends)
    order = np.argsort(h)
    return sum(r.n for r in parts), sum(r.v for r in parts), ends, h[order], c[order]


def list_size(tokens: int) -> int:
    """Classes of the network and words of a class."""
    return max(32, 2 ** int(np.log2(max(tokens, 1)) / 5))


class ShortList:
    """The listed words by hash, with their counts and the network's ids: 0 the end token, 1 all words outside the network."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int, ends: int, size: int | None = None):
        self.size = size or list_size(n)
        self.n, self.v = n, v
        self.sorted = np.append(hashes, np.uint64(2**64 - 1))
        self.first = np.searchsorted(hashes, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
        self.probes = int(np.diff(np.append(self.first, len(hashes))).max()) if len(hashes) else 0
        ends_at = hashes == END_HASH
        order = np.lexsort((hashes, -counts))
        own = order[~ends_at[order]][: self.size**2 - 2]
        self.net = np.full(len(hashes) + 1, OTHER, np.int64)
        self.net[own] = np.arange(2, 2 + len(own))
        self.net[:-1][ends_at] = END
        self.logs = np.append(np.log10(counts + 0.5), 0.0)
        self.counts = np.zeros(self.size**2)
        self.counts[2 : 2 + len(own)] = counts[own]
        self.counts[END] = ends
        self.counts[OTHER] = max(0, n - self.counts.sum())
        # Words outside the network and the one unseen word share what the network's words leave.
        self.rest = np.log10(self.counts[OTHER] + 0.5 * (max(0, v - len(own) - (ends > 0)) + 1))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the list, its length if it is not there."""
        out = np.full(len(hashes), len(self.sorted) - 1, np.int64)
        at = self.first[hashes >> np.uint64(46)].astype(np.int64)
        for _ in range(self.probes):
            here = np.minimum(at, len(self.sorted) - 1)
            hit = self.sorted[here] == hashes
            out[hit] = here[hit]
            at += 1
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The network's id of each hash; the end token has its own even if nothing was learned."""
        out = self.net[self.places(hashes)]
        out[hashes == END_HASH] = END
        return out


# --- Model ---------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax_parts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(numerators, their sums, what was taken off the exponents) of each row; rows are shifted only if they must be."""
    shift = a.max(1) if len(a) and (a.max() > 60 or a.min() < -60) else 0.0
    e = np.exp(a - shift[:, None] if isinstance(shift, np.ndarray) else a)
    return e, e @ np.ones(e.shape[1], e.dtype), shift


class GatedModel:
    """Parameters by name: gates by token (3H), recurrence (H x 3H), classes (H x C), words (C x H x S) and their offsets."""

    def __init__(self, values: dict[str, np.ndarray], trust: float = 1e-6):
        self.p = values
        self.size = values["class_bias"].shape[0]
        self.squares = {k: np.full(v.shape, trust, np.float32) for k, v in values.items()}

    @staticmethod
    def shapes(size: int) -> dict[str, tuple[int, ...]]:
        return {"gates": (size * size, 3 * HIDDEN), "recur": (HIDDEN, 3 * HIDDEN), "classes": (HIDDEN, size), "class_bias": (size,), "words": (size, HIDDEN, size), "word_bias": (size, size)}

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 3) -> GatedModel:
        """Small random weights; offsets give the training frequencies of the network's words."""
        r = np.random.default_rng(seed)
        size = int(round(len(counts) ** 0.5))
        p = {k: (r.standard_normal(s) * (0.1 if k != "recur" else 0.25)).astype(np.float32) for k, s in cls.shapes(size).items()}
        share = (np.asarray(counts, np.float64) + 0.5).reshape(-1, size)
        p["class_bias"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
        p["word_bias"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shapes(self.size)]).astype(np.float32)

    @classmethod
    def from_flat(cls, data: np.ndarray, size: int, trust: float = 1e-6) -> GatedModel:
        p, at = {}, 0
        for k, s in cls.shapes(size).items():
            n = int(np.prod(s))
            p[k] = data[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(p, trust)

    def step(self, h: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, ...]:
        """(state after reading ``token``, and what the gradient needs). Reading an end token forgets what was before."""
        h = h * (token != END)[:, None]
        g, u = self.p["gates"][token], h @ self.p["recur"]
        zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        return n + z * (h - n), h, z, r, n, u[:, 2 * HIDDEN :]

    def _by_class(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        return order, np.searchsorted(cls[order], np.arange(self.size + 1))

    def log_probabilities(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log P(target | state), classes first, then words class by class."""
        cls, word = target // self.size, target % self.size
        a = h @ self.p["classes"] + self.p["class_bias"]
        e, total, shift = _softmax_parts(a)
        out = (a[np.arange(len(h)), cls] - shift - np.log(total)).astype(np.float64)
        order, cut = self._by_class(cls)
        state, word, more = h[order], word[order], np.empty(len(h))
        for c in np.flatnonzero(np.diff(cut)):
            i = slice(cut[c], cut[c + 1])
            b = state[i] @ self.p["words"][c] + self.p["word_bias"][c]
            e, total, shift = _softmax_parts(b)
            more[i] = b[np.arange(len(b)), word[i]] - shift - np.log(total)
        out[order] += more
        return out

    def gradient(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, int]:
        """Gradients of the summed loss through one window (stream, time), the state after it, and the targets that count (those from 0)."""
        steps, tape = inputs.shape[1], []
        states = np.empty((steps, *h.shape), h.dtype)
        for t in range(steps):
            h, *rest = self.step(h, inputs[:, t])
            tape.append(rest)
            states[t] = h
        flat, target = states.reshape(-1, HIDDEN), targets.T.ravel()
        real = np.flatnonzero(target >= 0)
        d = {"recur": np.zeros_like(self.p["recur"]), "words": np.zeros_like(self.p["words"]), "word_bias": np.zeros_like(self.p["word_bias"])}
        state, target = flat[real], target[real]
        cls, word = target // self.size, target % self.size
        e, total, _ = _softmax_parts(state @ self.p["classes"] + self.p["class_bias"])
        e /= total[:, None]
        e[np.arange(len(real)), cls] -= 1
        d["classes"], d["class_bias"] = state.T @ e, np.ones(len(e), e.dtype) @ e
        part = e @ self.p["classes"].T
        order, cut = self._by_class(cls)
        state, word, more = state[order], word[order], np.empty_like(part)
        for c in np.flatnonzero(np.diff(cut)):
            i = slice(cut[c], cut[c + 1])
            e, total, _ = _softmax_parts(state[i] @ self.p["words"][c] + self.p["word_bias"][c])
            e /= total[:, None]
            e[np.arange(len(e)), word[i]] -= 1
            d["words"][c], d["word_bias"][c] = state[i].T @ e, np.ones(len(e), e.dtype) @ e
            more[i] = e @ self.p["words"][c].T
        part[order] += more
        back = np.zeros_like(flat)
        back[real] = part
        back = back.reshape(states.shape)
        carry = np.zeros_like(h)
        gates = np.empty((steps, len(h), 3 * HIDDEN), h.dtype)
        du = np.empty((len(h), 3 * HIDDEN), h.dtype)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, u = tape[t]
            g = carry + back[t]
            dn = g * (1 - z) * (1 - new * new)
            gates[t, :, :HIDDEN] = du[:, :HIDDEN] = g * (before - new) * z * (1 - z)
            gates[t, :, HIDDEN : 2 * HIDDEN] = du[:, HIDDEN : 2 * HIDDEN] = dn * u * r * (1 - r)
            gates[t, :, 2 * HIDDEN :] = dn
            du[:, 2 * HIDDEN :] = dn * r
            d["recur"] += before.T @ du
            carry = (g * z + du @ self.p["recur"].T) * (inputs[:, t] != END)[:, None]
        read = inputs.T.ravel().astype(np.uint16 if self.size <= 256 else np.uint32)
        order = np.argsort(read, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], read[order][1:] != read[order][:-1])))
        d["gates"] = np.zeros_like(self.p["gates"])
        d["gates"][read[order][at]] = np.add.reduceat(gates.reshape(-1, 3 * HIDDEN)[order], at, axis=0)
        return d, h, len(real)

    def learn(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, rate: float) -> np.ndarray:
        """One update by backpropagation through one window; the state after it. Targets below 0 are padding."""
        d, h, n = self.gradient(h, inputs, targets)
        for k, x in d.items():
            x /= n
            norm = float(np.sqrt(np.vdot(x, x)))
            if norm > 1:
                x /= norm
            self.squares[k] += x * x
            self.p[k] -= rate * x / np.sqrt(self.squares[k])
        return h

    def read(self, tokens: np.ndarray, rate: float) -> None:
        """Learn a run of whole documents in parallel streams, every token once; the last streams are padded."""
        if not len(tokens):
            return
        streams = int(max(1, min(STREAMS, len(tokens) // (4 * WINDOW))))
        length = -(-len(tokens) // streams)
        pad = streams * length - len(tokens)
        x = np.concatenate(([END], tokens[:-1], np.full(pad, END))).reshape(streams, length)
        y = np.concatenate((tokens, np.full(pad, -1))).reshape(streams, length)
        h = np.zeros((streams, HIDDEN), np.float32)
        for a in range(0, length, WINDOW):
            h = self.learn(h, x[:, a : a + WINDOW], y[:, a : a + WINDOW], rate)

    def score(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each row's whole token sequence; all rows run side by side, longest first."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        start, size = first[:-1][order], size[order]
        out = np.zeros(len(order))
        h = np.zeros((len(order), HIDDEN), np.float32)
        now = np.zeros(len(order), np.int64)
        states, targets, rows, held = [], [], [], 0
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))
            h = self.step(h[:n], now[:n])[0]
            now = tokens[start[:n] + t].astype(np.int64)
            states.append(h)
            targets.append(now)
            rows.append(n)
            held += n
            if held > 40_000 or t + 1 == size[0]:
                p = self.log_probabilities(np.concatenate(states), np.concatenate(targets))
                row = np.concatenate([np.arange(k) for k in rows])
                out += np.bincount(row, weights=p, minlength=len(out))
                states, targets, rows, held = [], [], [], 0
        back = np.empty_like(out)
        back[order] = out
        return back


# --- Queries -------------------------------------------------------------------------------------------------------


def _flat(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), learns().alias("use"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, words: ShortList, rows: int) -> GatedModel:
    """A first model from a bounded sample, then one pass over all training documents in groups, averaged by tokens."""
    flat = _flat(docs).filter("use")
    share = min(1.0, 2 * WARM_ROWS / max(rows, 1))
    draw = F.xxhash64("doc_id", F.lit("warm"))
    sample = flat.filter(F.pmod(draw, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(draw, "doc_id", F.xxhash64("text")).limit(WARM_ROWS).coalesce(1)
    chunk = STREAMS * STREAM_LENGTH
    kind = np.uint16 if words.size <= 256 else np.uint32

    def warm_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [words.ids(Tokens(part.column(2)).hashes).astype(kind) for batch in batches for part in slices(batch, "text", 4 << 20)]
        tokens = np.concatenate(got) if got else np.zeros(0, kind)
        model = GatedModel.fresh(words.counts)
        for _ in range(WARM_EPOCHS):
            for a in range(0, len(tokens), chunk):
                model.read(tokens[a : a + chunk].astype(np.int64), RATE)
        yield _weighted(model.flat(), 1)

    first = sample.mapInArrow(warm_up, "weights binary, n long").collect()
    warm = np.frombuffer(bytes(first[0].weights), np.float32) if first else GatedModel.fresh(words.counts).flat()
    n_groups = int(max(1, min(MOST_GROUPS, round(words.n / GROUP_TOKENS))))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                t = Tokens(part.column(2))
                ids = words.ids(t.hashes).astype(kind)
                doc = np.asarray(part.column(0).fill_null(0)).astype(np.int64).view(np.uint64)
                key = mix(t.sequence_ids().view(np.uint64) ^ mix(doc))
                group = (key >> np.uint64(32)) * np.uint64(n_groups) >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(key.view(np.int64)), pa.array([ids[a:b].tobytes() for a, b in zip(t.first[:-1], t.first[1:], strict=True)], pa.binary())], ["g", "key", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, seen, group = None, [], 0, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if own is not None:
                own.read(np.concatenate([np.zeros(0, np.int64), *held]), RATE / 2)
                yield _weighted(own.flat().astype(np.float64) * (seen + size), seen + size)

        for batch in batches:
            for g, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != group:
                    yield from done()
                    own, held, size, seen, group = GatedModel.from_flat(warm, words.size, 1e-3), [], 0, 0, g
                held.append(np.frombuffer(x, kind).astype(np.int64))
                size += len(held[-1])
                if size >= chunk:
                    own.read(np.concatenate(held), RATE / 2)
                    seen, held, size = seen + size, [], 0
        yield from done()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(warm)), 0
        for batch in batches:
            for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, n = total + np.frombuffer(w, np.float64), n + k
        yield _weighted(total, n)

    dealt = flat.mapInArrow(coded, "g int, key long, ids binary").repartition(n_groups, "g").sortWithinPartitions("g", "key", "ids")
    models = materialize(dealt.mapInArrow(run, "weights binary, n long"), "models")
    parts = models.repartition(8).mapInArrow(add, "weights binary, n long").collect()
    drop(models)
    n = sum(r.n for r in parts)
    return GatedModel.from_flat(sum(np.frombuffer(bytes(r.weights), np.float64) for r in parts) / n if n else warm, words.size)


def _weighted(w: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["weights", "n"])


ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_listed", pa.int64()), ("listed", pa.float64()), ("model", pa.float64()), ("bucket", pa.int32()), ("rows", pa.binary()), ("words", pa.binary())])
ROWS_DDL = "row long, doc_id long, held_out boolean, n_tokens long, n_listed long, listed double, model double, bucket int, rows binary, words binary"


def _scores(docs: DataFrame, words: ShortList, model: GatedModel, n_buckets: int) -> DataFrame:
    """Rows of documents (row, sums over listed words, the network's score) and rows of unlisted words by bucket (rows, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_row = TaskContext.get().partitionId() << 40
        pools: dict[bool, list[tuple]] = {True: [], False: []}
        sizes = {True: 0, False: 0}
        blank = {f.name: f.type for f in ROWS}

        def out(n: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[k] if k in cols else pa.nulls(n, t) for k, t in blank.items()], schema=ROWS)

        def flush(short: bool) -> pa.RecordBatch:
            held = pools[short]
            size = np.concatenate([np.diff(h[6]) for h in held])
            ids = np.concatenate([h[5] for h in held])
            net = model.score(ids, np.concatenate(([0], np.cumsum(size)))) / np.log(10)
            row, doc_id, use, n_listed, sums = (np.concatenate([h[k] for h in held], axis=-1) for k in range(5))
            null = doc_id == np.iinfo(np.int64).min
            held.clear()
            sizes[short] = 0
            # ``model``: the network's score, with the listed words outside the network spelled; unlisted ones get theirs by the join.
            return out(len(row), row=pa.array(row), doc_id=pa.array(doc_id, mask=null), held_out=pa.array(~use), n_tokens=pa.array(size), n_listed=pa.array(n_listed), listed=pa.array(sums[0]), model=pa.array(net + sums[1]))

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                t = Tokens(part.column(2))
                n = part.num_rows
                place = words.places(t.hashes)
                ids = words.net[place]
                ids[t.hashes == END_HASH] = END
                size = np.diff(t.first)
                of_row = np.repeat(np.arange(n), size)
                inside = place < len(words.sorted) - 1
                outside_net = ids == OTHER
                listed = np.bincount(of_row, weights=words.logs[place] + np.where((t.hashes == END_HASH) & ~inside, np.log10(0.5), 0.0), minlength=n)
                spelled = np.bincount(of_row, weights=np.where(outside_net, words.logs[place] - words.rest, 0.0), minlength=n)
                n_listed = np.bincount(of_row, weights=inside, minlength=n).astype(np.int64)
                rest = np.flatnonzero(~inside & (t.hashes != END_HASH))
                if len(rest):
                    h, r = t.hashes[rest], of_row[rest].astype(np.int64) + next_row
                    order = np.argsort(h, kind="stable")
                    h, r = h[order], r[order]
                    cut = _cuts(h, n_buckets)
                    some = np.flatnonzero(np.diff(cut))
                    yield out(len(some), bucket=pa.array(some, pa.int32()), rows=pa.array([r[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()), words=pa.array([h[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()))
                doc_id = np.asarray(part.column(0).fill_null(np.iinfo(np.int64).min)).astype(np.int64)
                use = np.asarray(part.column(1).cast(pa.uint8())).astype(bool)
                row = next_row + np.arange(n)
                next_row += n
                for short in (True, False):
                    k = np.flatnonzero((size <= SHORT) == short)
                    if len(k):
                        mine = np.repeat((size <= SHORT) == short, size)
                        pools[short].append((row[k], doc_id[k], use[k], n_listed[k], np.stack((listed[k], spelled[k])), ids[mine].astype(np.uint32), np.concatenate(([0], np.cumsum(size[k])))))
                        sizes[short] += int(size[k].sum())
                        if sizes[short] >= SCORE_TOKENS:
                            yield flush(short)
        for short in (True, False):
            if pools[short]:
                yield flush(short)

    return _flat(docs).mapInArrow(run, ROWS_DDL)


SUMS_DDL = "part int, rows binary, sums binary, known binary"


def _unlisted(blocks: DataFrame, counted: DataFrame, n_parts: int) -> DataFrame:
    """(row, more, n_more): for each document row the sum of log10(count + 0.5) over its unlisted words and how many of them are known."""

    def look_up(key, entries, counts):
        names = ["part", "rows", "sums", "known"]
        if not entries.num_rows:
            return pa.table({n: pa.array([], pa.int32() if n == "part" else pa.binary()) for n in names})
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in entries.column("words").to_pylist()])
        row = np.concatenate([np.frombuffer(x, np.int64) for x in entries.column("rows").to_pylist()])
        count = np.zeros(len(h), np.int64)
        if counts.num_rows:
            known = np.frombuffer(counts.column("words")[0].as_py(), np.uint64)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            count[hit] = np.frombuffer(counts.column("counts")[0].as_py(), np.int64)[at[hit]]
        order = np.argsort(row, kind="stable")
        row, count = row[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        rows, sums, seen = row[first], np.add.reduceat(np.log10(count + 0.5), first), np.add.reduceat((count > 0).astype(np.int64), first)
        part = (mix(rows.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(n_parts + 1))
        some = np.flatnonzero(np.diff(cut))
        pick = [order[cut[p] : cut[p + 1]] for p in some]
        return pa.table({"part": pa.array(some, pa.int32()), "rows": pa.array([rows[i].tobytes() for i in pick], pa.binary()), "sums": pa.array([sums[i].tobytes() for i in pick], pa.binary()), "known": pa.array([seen[i].astype(np.uint32).tobytes() for i in pick], pa.binary())})

    def add(key, table):
        row, sums, known = (np.concatenate([np.frombuffer(x, kind) for x in table.column(n).to_pylist()]) for n, kind in (("rows", np.int64), ("sums", np.float64), ("known", np.uint32)))
        order = np.argsort(row, kind="stable")
        row = row[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        return pa.table({"row": pa.array(row[first]), "more": pa.array(np.add.reduceat(sums[order], first)), "n_more": pa.array(np.add.reduceat(known[order].astype(np.int64), first))})

    found = blocks.select("bucket", "rows", "words").groupBy("bucket").cogroup(counted.select("bucket", "words", "counts").groupBy("bucket")).applyInArrow(look_up, SUMS_DDL)
    return found.groupBy("part").applyInArrow(add, "row long, more double, n_more long")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n_buckets = 4 * buckets(spark)
    counted = materialize(word_counts(docs, n_buckets), "counts")
    n, v, ends, hashes, counts = frequent_words(counted)
    words = ShortList(hashes, counts, n, v, ends)
    scored = materialize(_scores(docs, words, train(docs, words, ends), n_buckets), "scored")
    n_rows = scored.filter("row is not null").count()
    more = _unlisted(scored.filter("bucket is not null"), counted, 1 + n_rows // PART_ROWS)
    constant = float(np.log10(n + 0.5 * (v + 1)))
    of_words = F.coalesce(F.col("more"), F.lit(0.0))
    return scored.filter("row is not null").join(more.hint("merge"), "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_listed") + F.coalesce("n_more", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("listed") + of_words - F.col("n_tokens") * constant).alias("base_score"), (F.col("model") + of_words).alias("score"),
    )
