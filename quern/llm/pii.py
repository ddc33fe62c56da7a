"""Personal data: base patterns, and a skip-chain conditional random field that adds spans.

Base spans are found by fixed patterns with checks (see ``base_spans``); all
scans are linear in the text. The field's variables are a document's candidate
words (those with a digit, "@", "(at)", "[at]" or a leading "+"), its labels
"nothing" and the four kinds. Neighbouring candidates are joined in a chain;
consecutive occurrences of like words (equal digits, or equal letters without
regard to case, signs written out as "[at]" and "[.]" counting as what they
stand for), however distant, are joined by skip edges whose potentials reward
equal labels. So what a pattern recognises in one place is carried to places
where it is written without the marks that the pattern needs, and a number that
a pattern swallows together with the number after it is found by itself.

Training: pseudo-likelihood on a bounded sample (``TRAIN_ROWS`` documents drawn
by a hash; of those with over ``TRAIN_WORDS`` candidates, runs of neighbours
spread over the whole text) with the base spans as labels: once as it is, once
with half of the words' features blotted out, so that the edges learn to carry
labels, and once without edges. For the same reason each base span is repeated after its document
in a form that the patterns don't find (``weakened``).
Decoding: loopy sum-product message passing over all documents of a batch at
once. A word whose belief in a kind reaches ``BELIEF`` gives a span, joined
with its neighbours of that kind, if the span has the kind's form (``formed``)
and meets no base span. Base spans always stay. One text is one field: memory
is a few hundred bytes a candidate word of the longest text in a batch.

Defined cases: null text counts as empty and has no spans; offsets are code
points, the end exclusive; a word that ties between labels keeps the first, so
"nothing" wins; repeated rows get equal spans; an empty table gives an empty
result. Only the id and the text are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import Scratch, md5_long, small_batches

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS, TRAIN_WORDS = 4000, 400
ROUNDS, DAMPING, BELIEF = 10, 0.5, 0.9
#: Words handled at a time in decoding; messages handled at a time.
BATCH_WORDS, MESSAGES = 20000, 1 << 17
#: Neighbouring candidates that a training sample keeps together.
RUN = 20

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[(\[]at[)\]]")
_AT, _DOT = re.compile(r"[(\[]at[)\]]"), re.compile(r"[(\[]\.[)\]]")
_EMAIL_FORM = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_FORM = re.compile(r"[0-9]{1,3}(?:[.-][0-9]{1,3}){3}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each match has one "@": what stands before it is sought backwards, up to the match or "@" before."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        size = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if size else None
        if m:
            out.append((at - size, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; matches that fail a kind's check are dropped."""
    out = [(0, a, b) for a, b in emails(text)]
    if not _MARK.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def plain(word: str) -> str:
    """A word with the signs that it writes out."""
    return _DOT.sub(".", _AT.sub("@", word)) if "(" in word or "[" in word else word


class Words:
    """A document's candidates: places, features, chain and skip edges, labels by its base spans."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans, self.numbers, rows, likes = [], [], [], {}
        chain, skip = [], []
        before = ""
        for n, m in enumerate(_WORD.finditer(text)):
            word = m.group()
            if _MARK.search(word) or word[0] == "+":
                i = len(self.spans)
                core = word.strip(".,;:!?\"'()[]{}<>|*#$%&=")
                lead = word.find(core) if core else 0
                core = core or word
                self.spans.append((m.start() + lead, m.start() + lead + len(core)))
                meant = plain(core)
                digits = _NOT_DIGIT.sub("", meant)
                rows.append(features(word, core, meant, digits, before))
                if i and n - self.numbers[-1] == 1:
                    chain.append((i - 1, i))
                like = digits if len(digits) >= 3 and "@" not in meant else meant.casefold()
                if like in likes:
                    skip.append((likes[like], i))
                likes[like] = i
                self.numbers.append(n)
            before = word
        self.x = np.array(rows, np.float32).reshape(-1, N_FEATURES)
        self.chain, self.skip = (np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip))
        self.labels = np.zeros(len(self.spans), np.int64)
        if base and self.spans:
            begin, end = np.array(self.spans).T
            for kind, a, b in base:
                self.labels[np.searchsorted(end, a, "right") : np.searchsorted(begin, b, "left")] = kind + 1

    def sampled(self, most: int) -> Words:
        """About ``most`` candidates, in runs of ``RUN`` spread evenly over the text."""
        n = len(self.labels)
        if n <= most:
            return self
        starts = np.linspace(0, n - RUN, max(1, most // RUN)).astype(int)
        return self.part(np.unique((starts[:, None] + np.arange(RUN)).reshape(-1)))

    def part(self, keep: np.ndarray) -> Words:
        to = np.full(len(self.labels), -1)
        to[keep] = np.arange(len(keep))
        edges = [to[e] for e in (self.chain, self.skip)]
        return Words.of(self.x[keep], self.labels[keep], *[e[(e >= 0).all(1)] for e in edges])

    @classmethod
    def of(cls, x: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> Words:
        out = cls.__new__(cls)
        out.x, out.labels, out.chain, out.skip = x, labels, chain, skip
        return out


def features(word: str, core: str, meant: str, digits: str, before: str) -> list[float]:
    n = len(digits)
    dots, letters = meant.count("."), any(c.isalpha() for c in meant)
    return [
        1.0,
        n == 0, 1 <= n <= 2, n == 3, n == 4, 5 <= n <= 7, 8 <= n <= 15, 16 <= n <= 19, n > 19,
        n > 0 and n == len(core),
        16 <= n <= 19 and luhn(digits),
        "@" in meant, "@" in meant and "." in meant.rpartition("@")[2],
        dots == 3 and not letters, dots > 0, letters, n > 0 and letters,
        "-" in core, "(" in word, word[0] == "+", "+" in word,
        before[-1:] == "=", before[:1] == "+", "(" in before, before[-1:] == ":",
        meant != core, _IP_FORM.fullmatch(meant) is not None,
    ]


N_FEATURES = len(features("a", "a", "a", "", ""))


class Field:
    """Potentials: unary (features, labels), chain (labels, labels), skip (one reward a label)."""

    def __init__(self):
        self.unary = np.zeros((N_FEATURES, 5))
        self.unary[0, 0] = 4.0
        self.chain = np.zeros((5, 5))
        self.skip = np.zeros(5)

    def train(self, docs: list[Words], steps: int = 400, rate: float = 0.1, ridge: float = 3e-4) -> Field:
        """Adam on the pseudo-likelihood: each word's label given its neighbours' labels."""
        docs = [d for d in docs if len(d.labels)]
        if not docs:
            return self
        x, y, chain, skip = joined(docs)
        # Again with the features of half of the words blotted out: their labels must come from their neighbours.
        blot = np.random.default_rng(20240229).random(len(x)) < 0.5
        faint = np.where(blot[:, None] & (np.arange(N_FEATURES) > 0), 0.0, x)
        # And once more without edges: where no pattern gives a neighbour its label, a word's own features must do.
        x, y = np.concatenate([x, faint, x]), np.concatenate([y, y, y])
        chain, skip = np.concatenate([chain, chain + len(blot)]), np.concatenate([skip, skip + len(blot)])
        hot = np.eye(5)[y]
        left, right, like = np.zeros_like(hot), np.zeros_like(hot), np.zeros_like(hot)
        np.add.at(left, chain[:, 1], hot[chain[:, 0]])
        np.add.at(right, chain[:, 0], hot[chain[:, 1]])
        np.add.at(like, skip[:, 1], hot[skip[:, 0]])
        np.add.at(like, skip[:, 0], hot[skip[:, 1]])
        params = [self.unary, self.chain, self.skip]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        n = len(x)
        for step in range(1, steps + 1):
            z = x @ self.unary + left @ self.chain + right @ self.chain.T + like * self.skip
            p = np.exp(z - z.max(1, keepdims=True))
            g = hot - p / p.sum(1, keepdims=True)
            grads = [x.T @ g / n, (left.T @ g + g.T @ right) / n, (like * g).sum(0) / n]
            for param, grad, a, b in zip(params, grads, m1, m2, strict=True):
                grad = grad - ridge * param
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                param += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        for p in params:
            np.round(p, 6, out=p)
        return self

    def beliefs(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Marginals by loopy message passing; ``fixed`` labels over 0 (base spans) are evidence."""
        unary = x @ self.unary
        known = np.flatnonzero(fixed)
        unary[known] = -30.0
        unary[known, fixed[known]] = 0.0
        c, n = len(chain), len(chain) + len(skip)
        edges = np.concatenate([chain, skip])
        # Both ways of an edge: message e goes from its first end to its second, e + n back.
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        kind = np.repeat([0, 2, 1, 2], [c, n - c, c, n - c])
        pair = np.stack([self.chain, self.chain.T, np.diag(self.skip)])
        message = np.zeros((2 * n, 5))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, message)
            fresh = np.empty_like(message)
            for lo in range(0, 2 * n, MESSAGES):
                e = np.arange(lo, min(lo + MESSAGES, 2 * n))
                z = (belief[src[e]] - message[(e + n) % (2 * n)])[:, :, None] + pair[kind[e]]
                top = z.max(1)
                new = top + np.log(np.exp(z - top[:, None]).sum(1))
                fresh[e] = new - new.max(1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * fresh
        belief = unary
        np.add.at(belief, dst, message)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def joined(docs: list[Words]):
    """One graph of the documents' graphs."""
    at = np.cumsum([0] + [len(d.labels) for d in docs])
    shift = lambda name: np.concatenate([getattr(d, name) + a for d, a in zip(docs, at, strict=False)])
    return np.concatenate([d.x for d in docs]).astype(float), np.concatenate([d.labels for d in docs]), shift("chain"), shift("skip")


def formed(kind: str, span: str) -> bool:
    """Whether an added span has the form of its kind, whatever its separators."""
    meant = plain(span)
    digits = _NOT_DIGIT.sub("", meant)
    if kind == "email":
        return _EMAIL_FORM.fullmatch(meant) is not None
    if kind == "ip":
        return _IP_FORM.fullmatch(meant) is not None and all(int(x) <= 255 for x in re.split("[.-]", meant))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and not any(c.isalpha() for c in meant)


def added_spans(text: str, words: Words, p: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    label = np.where(p.max(1) >= BELIEF, p.argmax(1), 0)
    out, i = [], 0
    taken = sorted((a, b) for _, a, b in base)
    # Base spans of different kinds may meet: the furthest end so far keeps the ends in order.
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, int)
    while i < len(label):
        j = i + 1
        if label[i] and not words.labels[i]:
            # Only phone numbers and cards are written in several words; a new "+" begins a new number.
            while label[i] >= 3 and j < len(label) and label[j] == label[i] and not words.labels[j] and words.numbers[j] - words.numbers[j - 1] == 1 and text[words.spans[j][0]] != "+":
                j += 1
            kind, b = int(label[i]) - 1, words.spans[j - 1][1]
            if kind == 2 and j - i > 1 and formed("card", text[slice(*words.spans[i])]):
                j, b = i + 1, words.spans[i][1]
            a = words.spans[i][0]
            if KINDS[kind] == "phone" and a and text[a - 1] == "(":
                a -= 1
            k = int(np.searchsorted(ends, a, "right"))
            free = k == len(taken) or taken[k][0] >= b
            if free and formed(KINDS[kind], text[a:b]):
                out.append((kind, a, b))
        i = j
    return out


def find(field: Field, texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; spans are (kind, start, end)."""
    out: list = [None] * len(texts)
    waiting: list[tuple[int, str, list, Words]] = []

    def decode():
        if waiting:
            x, fixed, chain, skip = joined([w for *_, w in waiting])
            p, at = field.beliefs(x, chain, skip, fixed), 0
            for i, text, base, words in waiting:
                n = len(words.labels)
                out[i] = (base, sorted(base + added_spans(text, words, p[at : at + n], base)))
                at += n
            waiting.clear()

    size = 0
    for i, text in enumerate(texts):
        text = text or ""
        if not _MARK.search(text):
            out[i] = ([], [])
            continue
        base = base_spans(text)
        words = Words(text, base)
        if not len(words.labels):
            out[i] = (base, base)
            continue
        waiting.append((i, text, base, words))
        size += len(words.labels)
        if size >= BATCH_WORDS:
            decode()
            size = 0
    decode()
    return out


def weakened(kind: str, span: str, turn: int) -> list[tuple[str, str | None]]:
    """A form of a span that the patterns don't find, as parts (text, its kind)."""
    digits = _NOT_DIGIT.sub("", span)
    if kind == "email":
        at, dot = (("[at]", "."), ("(at)", "."), ("[at]", "[.]"))[turn % 3]
        local, _, domain = span.partition("@")
        return [(local + at + domain.replace(".", dot), kind)]
    if kind == "ip":
        return [(span.replace(".", ("[.]", "-")[turn % 2]), kind)]
    # A number directly after it takes the pattern beyond its greatest number of digits.
    some = (turn * 7919 + 104729) % 10**7
    after = [(" ", None), (f"{some:07d}", None) if turn // 2 % 2 else (".".join(str(some >> s & 255) for s in (0, 5, 9, 14)), "ip")]
    if kind == "card":
        return ([(".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), kind)], [(digits, kind), *after])[turn % 2]
    local = span.partition(" ")[2]
    return [(local, kind)] if local and turn % 2 else [(span, kind), *after]


def with_echoes(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """A training text with weakened repeats of its base spans, and its labelled spans."""
    base = base_spans(text)
    parts, size, spans = [text], len(text), list(base)
    for turn, (kind, a, b) in enumerate(base):
        for part, meant in [(" a ", None), *weakened(KINDS[kind], text[a:b], turn + a)]:
            if meant:
                spans.append((KINDS.index(meant), size, size + len(part)))
            parts.append(part)
            size += len(part)
    return "".join(parts), spans


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """A field fitted on about ``rows`` documents."""
    n = docs.select("doc_id").count()
    draw = F.pmod(md5_long(F.lit("train"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.select(F.col("doc_id").cast("long"), "text").where(draw < min(1.0, rows / max(n, 1)))

    def cut(batches):
        for batch in batches:
            ids, xs, ys, cs, ss = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words(*with_echoes(text or "")).sampled(TRAIN_WORDS)
                if len(words.labels):
                    ids.append(key)
                    xs.append(words.x.tobytes())
                    ys.append(words.labels.tobytes())
                    cs.append(words.chain.tobytes())
                    ss.append(words.skip.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(v, pa.binary()) for v in (xs, ys, cs, ss)]], ["doc_id", "x", "y", "c", "s"])

    cuts = Scratch(docs.sparkSession, "pii").save(sample.mapInArrow(cut, "doc_id long, x binary, y binary, c binary, s binary"))
    got = cuts.orderBy(md5_long(F.col("doc_id")), "doc_id", "x").limit(rows).collect()
    learnt = [
        Words.of(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES), np.frombuffer(r["y"], np.int64), *[np.frombuffer(r[e], np.int64).reshape(-1, 2) for e in ("c", "s")])
        for r in got
    ]
    return Field().train(learnt)


SPAN = "struct<kind:string,start:long,end:long>"


def detect(docs: DataFrame, field: Field) -> DataFrame:
    """Rows (doc_id, base, spans): arrays of kind, start and end, by kind as in ``KINDS``, then start."""
    small_batches(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    names = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def run(batches):
        for batch in batches:
            found = find(field, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([names(f[i]) for f in found], pa.list_(kind)) for i in (0, 1)]], ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, base array<{SPAN}>, spans array<{SPAN}>")


def listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def summary(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redacted(text: str, spans) -> str:
    """``text`` with each span replaced by its kind in brackets."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[kind]}]"]
            last = b
    return "".join(out) + text[last:]
