"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: compatible forms (mathematical, full-width, circled letters) and lower
case; accents go; letters of other scripts that look Latin become Latin; digits
and signs that stand for letters become letters where they touch letters of a
word; everything but letters becomes one blank.

Lexicon: words and word beginnings, weighted by their log odds between toxic
and clean training documents, less one standard error; all that reach
``MIN_DOCS`` and ``MIN_WEIGHT`` count. They come from a bounded sample of
labelled documents (``TRAIN_ROWS`` a class, in hash order). A beginning gives
way to a longer pattern that has nearly all of its toxic documents.

Exceptions: a few fixed phrases, and pairs of words of the sample that hold a
word of the lexicon, but stand in enough clean documents to be harmless
themselves. If labels of either kind are missing there is nothing to learn: a
short list of words (``SEEDS``) then has fixed weights.

Score: the heaviest match at each word counts, unless it lies in an exception
phrase. The sum, and the sum over the text's length, go through a logistic
curve. It is fitted on the sample, each half read with a lexicon of the other
half.

Defined cases: a null, empty or wordless text has no matches and gets the score
of a text without any; labels that are null are not learnt from; repeated rows
get equal scores; an empty table gives an empty result. Scores depend on the
text alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import Scratch, md5_long, small_batches

TRAIN_ROWS = 4000
MIN_DOCS, MIN_WEIGHT, COVERED = 4, 1.5, 0.9
PREFIXES = range(3, 9)
TOXIC_SCORE = 0.7

#: Fixed values. Used where no labels are given.
SEEDS = ("idiot", "moron", "imbecile", "scum", "loser", "pathetic", "worthless", "disgusting")
#: Fixed values. Harmless phrases that hold a word of the lexicon.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "clown nose", "sore loser bracket", "pathetic fallacy")
#: Cyrillic and Greek letters by the Latin letters they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_FOREIGN = re.compile("[Ͱ-ԯ]")
_ACCENT = re.compile("[\u0300-\u036f]")
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()}
_SIGN = re.compile(r"(?<![a-z0-9@$!|])(?:[0-9@$]++[a-z]++(?:[0-9@$!|]++[a-z]++)*+|[a-z]++(?:[0-9@$!|]++[a-z]++)++)")
_SIGNS = {ord(k): v for k, v in SUBSTITUTES.items()}
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Folded words, each between blanks."""
    low = text.lower()
    if not low.isascii():
        low = _ACCENT.sub("", unicodedata.normalize("NFKD", low).lower())
    if _FOREIGN.search(low):
        low = low.translate(_FOLD)
    low = _SIGN.sub(lambda m: m.group().translate(_SIGNS), low)
    return " " + _OTHER.sub(" ", low).strip() + " "


def features(folded: str) -> set[str]:
    """Patterns that a text has: " word " and " beginning"."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in PREFIXES if len(word) >= n)
    return out


class Lexicon:
    """Weighted patterns; two numbers a text."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS):
        self.weights, self.exceptions = weights, [fold(e) for e in exceptions]
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for p, w in self.weights.items():
                a.add_word(p, (len(p), w))
            for p in self.exceptions:
                a.add_word(p, (len(p), None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def read(self, text: str) -> tuple[float, int]:
        """Sum of weights and number of words of a text."""
        folded = fold(text)
        words = folded.count(" ") - 1 if len(folded) > 2 else 0
        if not self.weights:
            return 0.0, words
        best: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton().iter(folded):
            at = end - size + 1
            if w is None:
                harmless.append((at, end))
            elif w > best.get(at, 0.0):
                best[at] = w
        for lo, hi in harmless:
            for at in [a for a in best if lo <= a < hi]:
                del best[at]
        return float(sum(best.values())), words


def design(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * b * len(y)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


class Model:
    def __init__(self, lexicon: Lexicon, curve: np.ndarray):
        self.lexicon, self.curve = lexicon, curve

    def scores(self, texts: list[str | None]) -> np.ndarray:
        read = [self.lexicon.read(t or "") for t in texts]
        x = design(np.array([r[0] for r in read]), np.array([r[1] for r in read]))
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30))) if len(read) else np.zeros(0)


def seed_model() -> Model:
    return Model(Lexicon({f" {w} ": 3.0 for w in SEEDS}), np.array([-3.0, 2.0, 1.0]))


#: Counts of documents with a pattern, by label and half of the sample.
COUNTS = {"t0": (True, False), "t1": (True, True), "c0": (False, False), "c1": (False, True)}


def pairs(folded: str, lexicon: Lexicon) -> set[str]:
    """Pairs of neighbouring words, " one two ", of which one is in the lexicon."""
    words = folded.split()
    known = {w: any(p in lexicon.weights for p in (f" {w} ", *(f" {w[:n]}" for n in PREFIXES if len(w) >= n))) for w in set(words)}
    return {f" {a} {b} " for a, b in zip(words[:-1], words[1:], strict=True) if known[a] or known[b]}


def harmless(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    """Pairs (pair, toxic documents, clean documents) that speak for no toxicity, by a standard error."""
    odds = lambda t, c: np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)) + (1 / (t + 0.5) + 1 / (c + 0.5)) ** 0.5
    return sorted(p for p, t, c in counts if c >= MIN_DOCS and odds(t, c) <= 0)


def _pattern_counts(batches):
    for batch in batches:
        counts = {key: Counter() for key in COUNTS.values()}
        for text, label, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[label, half].update(features(fold(text or "")))
        patterns = list(set().union(*counts.values()))
        cols = [pa.array([counts[key][p] for p in patterns], pa.int64()) for key in COUNTS.values()]
        yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.string()), *cols], ["pattern", *COUNTS])


def weighed(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of patterns from (pattern, toxic documents, clean documents)."""
    have = {}
    for p, t, c in counts:
        w = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)) - (1 / (t + 0.5) + 1 / (c + 0.5)) ** 0.5
        if t >= MIN_DOCS and w >= MIN_WEIGHT:
            have[p] = (t, float(w))
    covered = set()
    for p, (t, _) in have.items():
        covered.update(q for q in (p[: n + 1] for n in PREFIXES if n + 1 < len(p)) if q in have and t >= COVERED * have[q][0])
    return {p: have[p][1] for p in sorted(have) if p not in covered}


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from ``labels(doc_id, toxic)``, at most ``rows`` documents a class."""
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "toxicity")
    labels = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("_id"), (F.col("toxic") != 0).alias("_toxic"))
    draw = [labels.where(F.col("_toxic") == t).orderBy(md5_long(F.col("_id")), "_id").limit(rows) for t in (True, False)]
    chosen = F.broadcast(draw[0].unionByName(draw[1]))  # 2 * rows ids at most
    sample = docs.join(chosen, docs["doc_id"] == F.col("_id")).select("text", F.col("_toxic").alias("label"), (F.pmod(md5_long(F.lit("half"), F.col("_id")), F.lit(2)) == 0).alias("half"))
    sample = scratch.save(sample)
    totals = {r["_toxic"]: r["count"] for r in labels.groupBy("_toxic").count().collect()}
    halves = {(r["label"], r["half"]): r["count"] for r in sample.groupBy("label", "half").count().collect()}
    if not all(halves.get((label, False), 0) + halves.get((label, True), 0) for label in (True, False)):
        return seed_model()
    counts = sample.select("text", "label", "half").mapInArrow(_pattern_counts, "pattern string, " + ", ".join(f"{c} long" for c in COUNTS))
    counts = counts.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in COUNTS])
    n = {name: halves.get(key, 0) for name, key in COUNTS.items()}
    # Patterns that reach the least weight in the sample or in a half; the sample's size bounds them.
    reach = lambda t, c, nt, nc: (t >= MIN_DOCS) & (F.log((t + 0.5) / (nt + 1)) - F.log((c + 0.5) / (nc + 1)) - F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= MIN_WEIGHT - 1e-6)
    whole = reach(F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), n["t0"] + n["t1"], n["c0"] + n["c1"])
    found = counts.where(whole | reach(F.col("t0"), F.col("c0"), n["t0"], n["c0"]) | reach(F.col("t1"), F.col("c1"), n["t1"], n["c1"])).collect()
    by_half = [Lexicon(weighed([(r["pattern"], r[f"t{h}"], r[f"c{h}"]) for r in found], n[f"t{h}"], n[f"c{h}"])) for h in (0, 1)]
    lexicon = Lexicon(weighed([(r["pattern"], r["t0"] + r["t1"], r["c0"] + r["c1"]) for r in found], n["t0"] + n["t1"], n["c0"] + n["c1"]))

    def pair_counts(batches):
        for batch in batches:
            seen = {True: Counter(), False: Counter()}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(pairs(fold(text or ""), lexicon))
            every = sorted(set(seen[True]) | set(seen[False]))
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([seen[k][p] for p in every], pa.int64()) for k in (True, False)]], ["pair", "t", "c"])

    two = sample.select("text", "label").mapInArrow(pair_counts, "pair string, t long, c long").groupBy("pair").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    two = [(r["pair"], r["t"], r["c"]) for r in two.where(F.col("c") >= MIN_DOCS).collect()]
    phrases = (*EXCEPTIONS, *harmless(two, n["t0"] + n["t1"], n["c0"] + n["c1"]))
    lexicon, by_half = Lexicon(lexicon.weights, phrases), [Lexicon(x.weights, phrases) for x in by_half]

    def read(batches):
        for batch in batches:
            got = [by_half[not half].read(text or "") for text, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], ["label", "total", "words"])

    seen = sample.select("text", "label", "half").mapInArrow(read, "label boolean, total double, words long").toPandas()
    y = seen["label"].to_numpy().astype(float)
    share = np.where(y == 1, totals[True] / max(1, n["t0"] + n["t1"]), totals[False] / max(1, n["c0"] + n["c1"]))
    x = design(seen["total"].to_numpy(), seen["words"].to_numpy())
    order = np.lexsort((x[:, 2], x[:, 1], y))  # sums don't depend on the order of rows
    return Model(lexicon, np.round(fit_curve(x[order], y[order], (share / share.mean())[order]), 9))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, predicted)."""

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            p = np.round(model.scores(batch.column(1).to_pylist()), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= TOXIC_SCORE).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score less than ``TOXIC_SCORE``."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            p = np.round(model.scores(batch.column(at).to_pylist()), 9)
            yield batch.filter(pa.array(p < TOXIC_SCORE))

    return docs.mapInArrow(run, docs.schema)
