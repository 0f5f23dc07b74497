"""Personal data: exact patterns, and a linear-chain conditional random field over word-shape features.

The four base kinds are found by their patterns. The field labels the words of each line: secrets (keys, tokens and
passwords) and names (of people behind an honorific or an introducing word). It is trained on the driver by gradient descent
on the exact likelihood of a small labelled table that is generated below from templates, so labels are right by construction.

Whole lines are decoded by Viterbi in numpy batches, whatever their length. A word whose margin for "nothing" exceeds all that
the transitions on its two sides can make up has that label in every best path, so the path falls apart there exactly; only the
stretches of other words between such places are decoded, side by side. Scores of a word come from a table of distinct words.
Spans that the field adds never replace a base span: an added span that touches one is dropped.

Defined results: a null text is empty and has no spans; digits are ASCII digits; positions count code points; ties of paths go
to the smaller label; repeated rows are searched each; texts and words of any length are read whole; an empty table gives no
rows; other columns, whatever their names, are ignored (``find``) or kept (``redact``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, give_back
from .words import slices

KINDS = ["email", "ip", "card", "phone", "secret", "name"]
BASE_KINDS = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each @; linear in the text, where the plain pattern is not."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# --- The field -----------------------------------------------------------------------------------------------------

LABELS = ["O", "secret", "name"]
FEATURES = 1 << 12
CELLS = 1 << 20  # words decoded side by side, padding included

CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "key", "bearer", "authorization")  # left-hand sides of templates
HONORIFICS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
INTRODUCING = ("name:", "named", "signed", "signed:", "author:", "contact:", "sincerely,", "regards,", "attn:")
GIVEN = ("Anna", "John", "Maria", "Peter", "Laura", "Karl", "Sofia", "Jean", "Lucía", "Omar", "Ivy", "Noah")
FAMILY = ("Smith", "Müller", "García", "Dubois", "Brown", "Schmidt", "López", "Martin", "Okafor", "Novak", "Lee", "Rossi")


def shape(word: str) -> str:
    """Runs of upper, lower, digit and other characters, each kept once with its length class; long shapes as the set of their runs."""
    out, last, run = [], "", 0
    for c in word:
        k = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c if c in "=:_\"'.,-/@+#" else "o"
        if k == last:
            run += 1
        else:
            if last:
                out.append(last + ("+" if run > 3 else ""))
            last, run = k, 1
    out.append(last + ("+" if run > 3 else ""))
    return "".join(out) if len(out) <= 12 else "many:" + "".join(sorted(set(out)))


def word_features(word: str) -> tuple[str, ...]:
    """Names of the features of one word; none of them is the word itself unless it is a cue, an honorific or an introducing word."""
    body = word.strip("\"'.,;:()[]")
    low = body.lower()
    digits = sum(map(str.isdigit, body))
    hexa = len(body) >= 16 and not low.strip("0123456789abcdef")
    turns = sum(a.isdigit() != b.isdigit() for a, b in pairwise(body)) if digits else 0
    head, eq, tail = low.partition("=")
    return (
        "shape=" + shape(word), f"len={min(len(body) // 4, 8)}", f"digits={min(digits, 6)}", f"turns={min(turns, 6)}", f"hex={hexa}",
        f"cue={low in CUES or low.rstrip('=:') in CUES}", f"pair={bool(eq and tail and head in CUES)}", f"eq={word in ('=', ':', ':=')}",
        f"hon={word in HONORIFICS}", f"intro={word.lower() in INTRODUCING}", f"cap={word[:1].isupper() and word[1:2].islower()}", f"upper={body.isupper() and len(body) > 12 and digits > 0}",
        f"quoted={word[:1] in '\"' + chr(39) and len(word) > 2}", f"stop={word[-1:] in '.!?' and word not in HONORIFICS}", f"mixed={digits >= 3 and turns >= 3 and len(body) >= 12}",
    )


@lru_cache(1 << 16)
def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


def slots(features: tuple[str, ...]) -> list[list[int]]:
    """Feature places of a word in three roles: itself, the word before, the word after."""
    return [[_slot(f"{role}:{f}") for f in features] for role in ("w", "p", "n")]


def canonical(word: str) -> str | None:
    """A word with the same features for plain words of letters and at most one stop; None for all others."""
    body, tail = (word[:-1], word[-1]) if word[-1] in ".,!?" else (word, "")
    if not body.isalpha() or body in HONORIFICS or word in HONORIFICS:
        return None
    low = body.lower()
    if low in CUES or (low + tail) in INTRODUCING or (len(body) >= 16 and not low.strip("abcdef")):
        return None
    size = min(len(body), 32)
    if body.islower():
        return "x" * size + tail
    if body.isupper():
        return "Z" * size + tail
    return "Z" + "x" * (size - 1) + tail if body[0].isupper() and body[1:].islower() else None


def labelled_table(n: int = 900, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """The small training table: generated lines of invented words with secrets and names put in, and their labels."""
    r = np.random.default_rng(seed)
    syllables = "an er th in on re en de la ou st ti es nd le que ge ver ción mo sa ru pi ka lo".split()
    hexs, upper, lower = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789"

    def pick(seq):
        return seq[int(r.integers(len(seq)))]

    def text(chars: str, k: int) -> str:
        return "".join(pick(chars) for _ in range(k))

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(int(r.integers(1, 5))))
        w = w.capitalize() if r.random() < 0.35 else w.upper() if r.random() < 0.05 else w
        return w + (pick([".", ",", "!", "?"]) if r.random() < 0.15 else "")

    def plain() -> list[str]:
        x = r.random()
        if x < 0.80:
            return [word()]
        if x < 0.84:
            return [str(int(r.integers(1, 100000))) + pick(["", ".", ",", "%"])]
        if x < 0.86:
            return [f"{text(lower[:26], 5)}.{int(r.integers(99))}@mail{int(r.integers(9))}.example.com"]
        if x < 0.88:
            return ["+1", f"({int(r.integers(200, 999))})", f"555-{int(r.integers(1000, 9999))}"]
        if x < 0.90:
            return [".".join(str(int(r.integers(256))) for _ in range(4))]
        if x < 0.92:
            return [text("0123456789", 16)]
        if x < 0.94:
            return [pick(["|", "###", "$$$", "=", ":", "-"])]
        if x < 0.96:
            return [f"{pick(['Version', 'Section', 'Item'])}", f"{int(r.integers(9))}.{int(r.integers(9))}."]
        if x < 0.98:
            return [pick(CUES)] if r.random() < 0.6 else [pick(INTRODUCING)]  # a cue or an introducing word with nothing behind it
        return [word() + pick(["###", "&&&", "***", "!!"])]

    def secret() -> tuple[list[str], list[int]]:
        x = r.random()
        if x < 0.3:
            q = pick(['"', "'", ""])
            return [pick(CUES), pick(["=", ":"]), q + text(hexs, int(r.integers(24, 65))) + q], [0, 0, 1]
        if x < 0.55:
            return [f"{pick(CUES)}={text(hexs if r.random() < 0.5 else lower, int(r.integers(10, 40)))}"], [1]
        if x < 0.8:
            return ["AKIA" + text(upper, 16)], [1]
        return [pick(["ghp_", "sk_", "xoxb-"]) + text(lower + upper, int(r.integers(24, 40)))], [1]

    def name() -> tuple[list[str], list[int]]:
        if r.random() < 0.3:
            lead = pick(INTRODUCING)
            return [lead.capitalize() if r.random() < 0.6 else lead, pick(GIVEN), pick(FAMILY)], [0, 2, 2]
        parts = [pick(GIVEN), pick(FAMILY)] if r.random() < 0.6 else [pick(FAMILY)]
        return [pick(HONORIFICS), *parts], [0, *[2] * len(parts)]

    out = []
    for _ in range(n):
        words: list[str] = []
        labels: list[int] = []
        if r.random() < 0.12:  # a line of capitalised words, often one word again and again
            same = word().capitalize()
            words = [same if r.random() < 0.6 else word().capitalize() for _ in range(int(r.integers(4, 40)))]
            labels = [0] * len(words)
        for _ in range(int(r.integers(3, 20)) if not words else int(r.integers(0, 4))):
            x = r.random()
            w, y = secret() if x < 0.06 else name() if x < 0.1 else ((p := plain()), [0] * len(p))
            words += w
            labels += y
        out.append((words, labels))
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Field:
    """Weights: features by labels, and label pairs."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    @classmethod
    def train(cls, table: list[tuple[list[str], list[int]]], steps: int = 60, rate: float = 0.4, penalty: float = 1e-4) -> Field:
        """Full-batch AdaGrad on the exact conditional likelihood; lines are padded to one length and run together."""
        n, longest, k = len(table), max(len(w) for w, _ in table), len(LABELS)
        known: dict[str, list] = {}
        feats: list[np.ndarray] = []
        place: list[np.ndarray] = []
        y = np.zeros((n, longest), np.int64)
        mask = np.zeros((n, longest), bool)
        for i, (words, labels) in enumerate(table):
            s = [known.setdefault(w, slots(word_features(w))) for w in words]
            for t in range(len(words)):
                f = s[t][0] + (s[t - 1][1] if t else []) + (s[t + 1][2] if t + 1 < len(words) else [])
                feats.append(np.array(f))
                place.append(np.full(len(f), i * longest + t))
            y[i, : len(words)], mask[i, : len(words)] = labels, True
        feat, at = np.concatenate(feats), np.concatenate(place)
        w, pairs = np.zeros((FEATURES, k)), np.zeros((k, k))
        gw, gp = np.full_like(w, 1e-8), np.full_like(pairs, 1e-8)
        gold = np.zeros((n * longest, k))
        gold[np.arange(n * longest), y.ravel()] = mask.ravel()
        both = mask[:, 1:] & mask[:, :-1]
        gold_pairs = np.zeros((k, k))
        np.add.at(gold_pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
        for _ in range(steps):
            score = np.stack([np.bincount(at, weights=w[feat, c], minlength=n * longest) for c in range(k)], axis=1).reshape(n, longest, k)
            fwd, bwd = np.zeros_like(score), np.zeros_like(score)
            fwd[:, 0] = score[:, 0]
            for t in range(1, longest):
                step = _logsumexp(fwd[:, t - 1, :, None] + pairs, 1) + score[:, t]
                fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
            for t in range(longest - 2, -1, -1):
                step = _logsumexp(pairs + (score[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                bwd[:, t] = np.where(mask[:, t + 1, None], step, 0)
            total = _logsumexp(fwd[:, -1], 1)
            node = np.exp(fwd + bwd - total[:, None, None]) * mask[..., None]
            edge = np.exp(fwd[:, :-1, :, None] + pairs + (score + bwd)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
            off = (gold - node.reshape(-1, k))[at]
            dw = np.stack([np.bincount(feat, weights=off[:, c], minlength=FEATURES) for c in range(k)], axis=1)
            dw, dp = dw / n - penalty * w, (gold_pairs - edge.sum((0, 1))) / n - penalty * pairs
            gw, gp = gw + dw**2, gp + dp**2
            w, pairs = w + rate * dw / np.sqrt(gw), pairs + rate * dp / np.sqrt(gp)
        return cls(w, pairs)

    def feature_scores(self, features: tuple[str, ...]) -> np.ndarray:
        """(role, label) scores of a word with these features."""
        return np.array([self.weights[s].sum(axis=0) for s in slots(features)], np.float32)

    def certain(self, emit: np.ndarray) -> np.ndarray:
        """Whether a word of these scores has label 0 in every best path, whatever stands on either side of it or nothing."""
        p = self.pairs
        out = np.ones(len(emit), bool)
        for k in range(1, p.shape[0]):
            gain = max(0.0, float((p[:, k] - p[:, 0]).max())) + max(0.0, float((p[k] - p[0]).max()))
            out &= emit[:, 0] > emit[:, k] + np.float32(gain + 1e-4)
        return out

    def decode(self, emit: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Best labels of words with scores ``emit``; words of one line share their ``row`` and follow each other."""
        out = np.zeros(len(emit), np.int8)
        at = np.flatnonzero(~self.certain(emit))
        if not len(at):
            return out
        score = emit[at].copy()
        same = np.zeros(len(emit) + 1, bool)  # whether a word follows another of its line
        same[1:-1] = row[1:] == row[:-1]
        begins = np.concatenate(([True], (at[1:] != at[:-1] + 1) | ~same[at[1:]]))
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(at)) - 1
        # The neighbours of a stretch within its line are certain.
        pairs = self.pairs.astype(np.float32)
        score[first[same[at[first]]]] += pairs[0]
        score[last[same[at[last] + 1]]] += pairs[:, 0]
        size = last - first + 1
        order = np.argsort(size, kind="stable")
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * size[order[b]] <= CELLS:
                b += max(1, min(len(order) - b, int(CELLS // size[order[b]]) - (b - a)) // 2)
            some = order[a:b]
            n = size[some]
            inside = np.arange(n.max()) < n[:, None]
            padded = np.zeros((len(some), n.max(), score.shape[1]), np.float32)
            words = np.repeat(first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            padded[inside] = score[words]
            out[at[words]] = self.viterbi(padded, n)[inside]
            a = b
        return out

    def viterbi(self, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of a padded batch (row, place, label)."""
        n, longest, k = score.shape
        pairs = self.pairs.astype(np.float32)
        back = np.zeros((longest, n, k), np.int8)
        best = score[:, 0].copy()
        for t in range(1, longest):
            step = best[:, :, None] + pairs
            back[t] = step.argmax(axis=1)
            on = (t < lengths)[:, None]
            best = np.where(on, step.max(axis=1) + score[:, t], best)
        out = np.zeros((n, longest), np.int8)
        now = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            inside = t < lengths
            out[:, t] = np.where(inside, now, 0)
            now = np.where(inside & (t > 0), back[t, rows, now], now)
        return out


class Finder:
    """Decodes whole texts; keeps which scores belong to distinct words, up to ``limit`` words."""

    def __init__(self, field: Field, limit: int = 100_000):
        self.field, self.limit = field, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.plain: dict[str, int] = {}
        self.known: dict[tuple[str, ...], int] = {}
        self.used = 0
        self.scores = np.zeros((1024, 3, len(LABELS)), np.float32)

    def _place(self, word: str) -> int:
        c = canonical(word)
        i = self.plain.get(c) if c is not None else None
        if i is None:
            f = word_features(word)
            i = self.known.get(f)
            if i is None:
                i, self.used = self.used, self.used + 1
                if i >= len(self.scores):
                    self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
                self.scores[i] = self.field.feature_scores(f)
                self.known[f] = i
            if c is not None:
                self.plain[c] = i
        if len(word) < 64:
            self.index[word] = i
        return i

    def scores_of(self, words: list[str]) -> np.ndarray:
        """(word, role, label) scores."""
        if len(self.index) > self.limit or self.used > self.limit:
            self.clear()
        get, place = self.index.get, self._place
        at = np.fromiter([place(w) if (i := get(w)) is None else i for w in words], np.int64, len(words))
        return self.scores[at]

    def labels(self, words: list[str], row: np.ndarray) -> np.ndarray:
        """Labels of the words; words of one line share their ``row``."""
        if not words:
            return np.zeros(0, np.int8)
        s = self.scores_of(words)
        emit = s[:, 0].copy()
        same = row[1:] == row[:-1]
        emit[1:][same] += s[:-1, 1][same]
        emit[:-1][same] += s[1:, 2][same]
        return self.field.decode(emit, row)

    def added(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of the words that the field labels, runs of names joined; quotes and stops at the edges are left out."""
        words: list[str] = []
        counts: list[int] = []
        owner: list[tuple[int, int]] = []  # text and start of each line
        for i, t in enumerate(texts):
            at = 0
            for line in t.split("\n"):
                got = line.split()
                if got:
                    words += got
                    counts.append(len(got))
                    owner.append((i, at))
                at += len(line) + 1
        ends = np.cumsum(np.array(counts, np.int64))
        row = np.repeat(np.arange(len(counts)), counts)
        y = self.labels(words, row)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for r in np.unique(row[np.flatnonzero(y)]).tolist():
            i, end = owner[r]
            for k in range(int(ends[r]) - counts[r], int(ends[r])):
                w, label = words[k], int(y[k])
                start = texts[i].index(w, end)
                end = start + len(w)
                if label:
                    body = w.strip("\"'.,;:()[]")
                    if not body:
                        continue
                    a = start + w.index(body)
                    kind = BASE_KINDS + label - 1
                    last = out[i][-1] if out[i] else None
                    if label == 2 and last and last[1] == kind and texts[i][last[2] : a] == " ":
                        out[i][-1] = (last[0], kind, a + len(body))
                    else:
                        out[i].append((a, kind, a + len(body)))
        return out


_FIELDS: list[Field] = []


def default_field() -> Field:
    """The field trained on the generated table; trained once in a process."""
    if not _FIELDS:
        _FIELDS.append(Field.train(labelled_table()))
    return _FIELDS[0]


def all_spans(texts: list[str], finder: Finder) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text; an added span that overlaps a base span is dropped."""
    out = []
    for text, more in zip(texts, finder.added(texts), strict=True):
        base = base_spans(text)
        out.append((base, sorted(base + untouched(more, base)) if more else base))
    return out


def untouched(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of ``more`` that overlap none of ``base``; both are sorted by start."""
    out, k, reach = [], 0, 0  # ``reach``: how far the base spans that begin before the span's end go
    for m in more:
        while k < len(base) and base[k][0] < m[2]:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m[0]:
            out.append(m)
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans, counts of the added kinds and of all spans for each row of docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    field = field or default_field()
    more = [f"n_{k}" for k in KINDS[BASE_KINDS:]] + ["n_spans"]
    names = ["doc_id", *[f"n_{k}" for k in KINDS[:BASE_KINDS]], "base_sha256", "spans", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                got = all_spans([t or "" for t in part.column(1).to_pylist()], finder)
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in got], pa.int64()) for k in range(BASE_KINDS)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in got]), pa.array([_joined(every) for _, every in got]), *[pa.array([sum(s[1] == k for s in every) for _, every in got], pa.int64()) for k in range(BASE_KINDS, len(KINDS))], pa.array([len(every) for _, every in got], pa.int64())], names)

    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return flat.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS[:BASE_KINDS]) + ", base_sha256 string, spans string, " + ", ".join(f"{n} long" for n in more))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, end = [], 0
    for a, kind, b in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind]}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with all columns, personal data in text masked; an n_chars column follows the new text."""
    bounded_batches(docs.sparkSession)
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                at = part.schema.get_field_index("text")
                texts = part.column(at).to_pylist()
                new = [t if t is None or not s else mask(t, s) for t, (_, s) in zip(texts, all_spans([t or "" for t in texts], finder), strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
        del finder
        give_back()

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return out
