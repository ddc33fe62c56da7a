"""Language identification by a byte convolutional network.

Texts are UTF-8 bytes, lower-cased over A-Z, with every other ASCII sign as a
blank, cut in windows of ``WINDOW`` bytes (the last one padded). The network
embeds bytes, convolves with filters of several widths, takes each filter's
greatest value over the window, and goes through a rectifier and a softmax. It
is trained in numpy on windows of a bounded sample of labelled documents: about
``TRAIN_ROWS`` of each language, drawn by a hash, and of their windows an equal
number for each language, ``TRAIN_TOTAL`` in all or ``LEAST_WINDOWS`` a language
where that is more. Every language that a label names is learnt. A document's probabilities
are its windows' means, weighted by their letters; every window is read.

A filter's value at a place is a sum over pairs of bytes, so for inference all
pairs are tabulated once, and a convolution is a few table look-ups.

Defined cases: a null text or one without a letter is ``und`` with score 0; so
is every text if there are no labels; null labels are not learnt from; ties go
to the language that sorts first; repeated rows get equal results; an empty
table gives an empty result. Predictions depend on the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .support import Scratch, md5_long, small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 8, 8
TRAIN_ROWS = 1500
#: Windows learnt from a document, spread over its whole length; in all; of a language at least.
TRAIN_WINDOWS, TRAIN_TOTAL, LEAST_WINDOWS = 3, 16000, 50
EPOCHS, BATCH, RATE = 6, 128, 0.01
BLOCK = 256

SYMBOL = K.LOWER.copy()
SYMBOL[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
INK = np.zeros(256, bool)
INK[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = True


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of symbols, row of each window)."""
    counts = -(-np.diff(at) // WINDOW)
    out = np.full((int(counts.sum()), WINDOW), 0x20, np.uint8)
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = out.reshape(-1)
    place = np.arange(at[-1] - at[0]) + np.repeat(first[:-1] * WINDOW - at[:-1] + at[0], np.diff(at))
    flat[place] = SYMBOL[data[at[0] : at[-1]]]
    return out, np.repeat(np.arange(len(counts)), counts)


class Network:
    def __init__(self, languages: list[str], seed: int = 20240229):
        draw = np.random.default_rng(seed)
        self.languages = languages
        self.embed = draw.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = [draw.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = draw.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self._tables = None

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}

    def _parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Network:
        """Adam on the weighted cross entropy of windows ``x`` with language numbers ``y``."""
        draw = np.random.default_rng(seed)
        params = self._parameters()
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(EPOCHS):
            order = draw.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                pick = order[lo : lo + BATCH]
                grads = self._gradients(x[pick], y[pick], weight[pick])
                step += 1
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, a, b in zip(params, grads, m1, m2, strict=True):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, x, y, weight):
        n = len(x)
        e = self.embed[x]
        tops, places = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            conv = sum(e[:, j : WINDOW - w + 1 + j] @ f[j] for j in range(w))
            best = conv.argmax(axis=1)
            places.append(best)
            tops.append(np.take_along_axis(conv, best[:, None], 1)[:, 0])
        top = np.concatenate(tops, 1) + self.bias
        hidden = np.maximum(top, 0)
        p = softmax(hidden @ self.out + self.out_bias)
        p[np.arange(n), y] -= 1
        p *= (weight / max(weight.sum(), 1e-9))[:, None]
        p = p.astype(np.float32)
        back = (p @ self.out.T) * (top > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        rows = np.arange(n)[:, None]
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            d = np.zeros_like(f)
            for j in range(w):
                seen = x[rows, places[i] + j]
                d[j] = np.einsum("nf,nfe->ef", g, self.embed[seen])
                np.add.at(d_embed, seen.reshape(-1), (g[:, :, None] * f[j].T[None]).reshape(-1, EMBEDDING))
            d_filters.append(d)
        return [d_embed, *d_filters, back.sum(0), hidden.T @ p, p.sum(0)]

    def tables(self):
        """For each width its values by the first pair of bytes, and those of the bytes after it."""
        if self._tables is None:
            at = [self.embed @ f for f in self.filters]  # (w, 256, FILTERS) each
            pairs = [(a[0][:, None] + a[1][None]).reshape(65536, FILTERS) for a in at]
            self._tables = pairs, at[1][2], (at[2][2][:, None] + at[2][3][None]).reshape(65536, FILTERS)
        return self._tables

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, languages)."""
        pairs, third, last = self.tables()
        out = np.zeros((len(x), len(self.languages)))
        for lo in range(0, len(x), BLOCK):
            part = x[lo : lo + BLOCK]
            code = part[:, :-1].astype(np.int32) << 8 | part[:, 1:]
            tops = [
                pairs[0][code].max(1),
                (pairs[1][code[:, :-1]] + third[part[:, 2:]]).max(1),
                (pairs[2][code[:, :-2]] + last[code[:, 2:]]).max(1),
            ]
            hidden = np.maximum(np.concatenate(tops, 1) + self.bias, 0)
            out[lo : lo + BLOCK] = softmax(hidden @ self.out + self.out_bias)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, at = K.string_bytes(column)
        n = len(at) - 1
        total = np.zeros((n, len(self.languages)))
        letters = np.zeros(n)
        for i, j in K.pieces(at, 1 << 20) if self.languages else ():
            part = at[i : j + 1] - at[i]
            x, row = windows(data[at[i] : at[j]], part)
            if len(x):
                ink = (x != 0x20).sum(1)
                weighed = self.probabilities(x) * ink[:, None]
                np.add.at(total, row + i, weighed)
                np.add.at(letters, row + i, ink)
        best = total.argmax(1) if self.languages and n else np.zeros(n, int)
        names, scores = [], np.zeros(n)
        for r in range(n):
            text = data[at[r] : at[r + 1]]
            lettered = letters[r] > 0 and (_ascii_letter(text) or any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace")))
            if lettered and self.languages:
                names.append(self.languages[best[r]])
                scores[r] = min(1.0, total[r, best[r]] / letters[r])
            else:
                names.append("und")
        return names, np.round(scores, 6)


_ASCII = np.zeros(256, bool)
_ASCII[[b for b in range(128) if chr(b).isalpha()]] = True


def _ascii_letter(text: np.ndarray) -> bool:
    return bool(_ASCII[text[:64]].any() or _ASCII[text].any())


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def training_windows(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    x, _ = windows(data, np.array([0, len(data)]))
    return x[np.unique(np.linspace(0, len(x) - 1, min(len(x), TRAIN_WINDOWS)).astype(int))]


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    """A network from the labelled rows of ``docs(doc_id, text, lang)``: about ``rows`` documents a language."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return Network([])
    spark = docs.sparkSession
    share = spark.createDataFrame([(lang, min(1.0, rows / n)) for lang, n in counts.items()], "lang string, share double")
    draw = F.pmod(md5_long(F.lit("train"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(share), "lang").where(draw < F.col("share"))

    def cut(batches):
        for batch in batches:
            x, y, key = [], [], []
            for i, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for k, w in enumerate(training_windows(text)):
                    x.append(w.tobytes())
                    y.append(lang)
                    key.append((batch.column(0)[i].as_py(), k))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in key], pa.int64()), pa.array([k[1] for k in key], pa.int32()), pa.array(y, pa.string()), pa.array(x, pa.binary())], ["doc_id", "k", "lang", "x"])

    scratch = Scratch(spark, "langid")
    cuts = scratch.save(sample.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(cut, "doc_id long, k int, lang string, x binary"))
    # Sampled rows alone: a language has 3 * TRAIN_ROWS windows or so.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(md5_long(F.col("doc_id"), F.col("k")), "x"))
    got = cuts.withColumn("place", place).where(F.col("place") <= max(LEAST_WINDOWS, TRAIN_TOTAL // len(counts))).orderBy("place", "lang").collect()
    languages = sorted({r["lang"] for r in got})
    x = np.frombuffer(b"".join(r["x"] for r in got), np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(r["lang"]) for r in got])
    full = (x != 0x20).any(1)
    return Network(languages).train(x[full], y[full], (x[full] != 0x20).sum(1) / WINDOW)


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """Rows (doc_id, lang_pred, score)."""

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            names, scores = network.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
