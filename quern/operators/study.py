"""Ways of pruning side by side, block by block: what each reads of the postings, and the best documents that it leaves.

The candidates are those of :mod:`pruning`; no table of postings and no pair of query and document is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as b
from . import pruning

WAYS = ("none", "champion", "elimination", "cluster")
#: Champions of a term, nearest leaders of a query; least idf and number of a query's rare terms.
CHAMPIONS, NEAR, LEAST_IDF, LEAST_MATCH = 10, 2, 1.0, 2
#: Queries in a part, about.
ASKED = 512


def weights(packed: DataFrame, step: int) -> DataFrame:
    """(term, leader, wl): weights of the documents whose id is divisible by ``step``."""

    def spread(batches):
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids, norms, _, terms, sizes, docs, tfs = b._opened(row)
                at = np.flatnonzero(ids[docs] % step == 0)
                w = (1 + np.log10(tfs[at])) / norms[docs[at]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(terms, sizes)[at], ids[docs[at]], w)], ["term", "leader", "wl"])

    return packed.mapInArrow(spread, "term bigint, leader bigint, wl double")


def champions(packed: DataFrame, terms: DataFrame, r: int) -> DataFrame:
    """(term, doc_id): :func:`pruning.champions` of the given terms. A block tells the r best that it holds."""
    one = b.parts(terms.select(F.lit(0).cast("bigint").alias("qid"), "term", F.lit(1.0).alias("w")).distinct(), 1)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_buffer() for c in batch.columns]
                ids, norms, _, terms, sizes, docs, tfs = b._opened(row[:7])
                there = np.flatnonzero(np.isin(terms, np.frombuffer(row[8], np.int64)))
                at, _ = b._spread((np.cumsum(sizes) - sizes)[there], sizes[there])
                w = b._rounded((1 + np.log10(tfs[at])) / norms[docs[at]], 9)
                term, doc = np.repeat(there, sizes[there]), ids[docs[at]]
                by = np.lexsort((doc, -w, term))
                best = by[b._spread(np.zeros(len(there), np.int64), sizes[there])[0] < r]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (terms[term[best]], doc[best], w[best])], ["term", "doc_id", "w"])

    rows = _paired(packed, one).mapInArrow(run, "term bigint, doc_id bigint, w double")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w"), "doc_id"))).where(F.col("r") <= r).select("term", "doc_id")


def _paired(packed: DataFrame, parts: DataFrame) -> DataFrame:
    """All parts with every block: tasks hold blocks, since the queries are few."""
    b._small_batches(packed)
    packed.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return packed.hint("shuffle_replicate_nl").crossJoin(parts.coalesce(1))


def _followed(leads, block, first):
    """Each document's most similar leader: of equal (rounded) similarities the least, ``first`` if none is similar."""
    best, sim = np.full(len(block[0]), first), np.full(len(block[0]), -1.0)
    for part in leads:
        scores, _ = b._scores(part, block, "tfidf", 0.0)
        q, d = np.nonzero((scores > 0) & (scores >= scores.max(axis=0) - 2e-9))
        x, lead = b._rounded(scores[q, d], 9), part[0][q]
        by = np.lexsort((lead, -x, d))
        at = by[np.flatnonzero(np.diff(d[by], prepend=-1))]
        d, x, lead = d[at], x[at], lead[at]
        better = (x > sim[d]) | (x == sim[d]) & (lead < best[d])
        best[d[better]], sim[d[better]] = lead[better], x[better]
    return best


def _matches(part, block):
    """Cells (query by document) of each use of a query's term, the query's weights and the postings, in pieces."""
    ids, _, _, terms, sizes, docs, _ = block
    _, qterms, qsizes, qrows, qws = part[:5]
    _, x, y = np.intersect1d(qterms, terms, assume_unique=True, return_indices=True)
    of, n = b._spread((np.cumsum(qsizes) - qsizes)[x], qsizes[x])
    base, times = np.repeat((np.cumsum(sizes) - sizes)[y], qsizes[x]), np.repeat(sizes[y], qsizes[x])
    upto, at = np.cumsum(times), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + b.CHUNK, "right")))
        posting, _ = b._spread(base[at:end], times[at:end])
        entry = np.repeat(of[at:end], times[at:end])
        yield qrows[entry] * len(ids) + docs[posting], qws[entry], posting
        at = end


def _masks(part, kept, block, leader):
    """Scores, numbers of shared terms, and what each way leaves, query by document."""
    ids, norms, _, _, _, docs, tfs = block
    shape = len(part[0]), len(ids)
    wd, size = (1 + np.log10(tfs)) / norms[docs], shape[0] * shape[1]
    scores, shared, rare = np.zeros(size), np.zeros(size, np.int32), np.zeros(size, np.int32)
    for cell, w, posting in _matches(part, block):
        scores += np.bincount(cell, w * wd[posting], size)
        shared += np.bincount(cell, minlength=size).astype(np.int32)
    need = np.full(shape[0], 1.0)
    if kept is not None:  # of the same queries
        need[kept[3]] = kept[4]
        for cell, _, _ in _matches(kept, block):
            rare += np.bincount(cell, minlength=size).astype(np.int32)
    scores, shared, rare = (x.reshape(shape) for x in (scores, shared, rare))
    vsizes, vdocs, _, csizes, cdocs = part[5:]
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids[order], cdocs), len(ids) - 1)
    found = ids[order][at] == cdocs
    champion, cluster = np.zeros(shape, bool), np.zeros(shape, bool)
    champion[np.repeat(np.arange(shape[0]), csizes)[found], order[at[found]]] = True
    for row, lead in zip(np.repeat(np.arange(shape[0]), vsizes), vdocs, strict=True):
        cluster[row] |= leader == lead
    any_ = shared > 0
    return scores, shared, {"none": any_, "champion": any_ & champion, "elimination": any_ & (rare >= need[:, None]), "cluster": any_ & cluster}


def _placed(have, scores, ids, mask, k, digits=6):
    """``have``, the best so far of one query, with a block's documents."""
    s, d = have
    least = s[-1] - 2 * 10.0**-digits if len(s) == k else -1.0
    at = np.flatnonzero(mask & (scores > least))
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k] - 2 * 10.0**-digits]
    if not len(at):
        return have
    x, y = np.concatenate([s, b._rounded(scores[at], digits)]), np.concatenate([d, ids[at]])
    by = b._best(x, y, k)
    return x[by], y[by]


def compared(packed: DataFrame, terms: DataFrame, asked: DataFrame, df: DataFrame, n_docs: int, step: int, first: int | None, k: int) -> DataFrame:
    """(method, qid, doc_id, score, postings, docs) of every way: its k best documents of each query with their scores, and,
    without a document, the postings and documents that it reads, in several rows.

    ``terms(qid, term, qtf)`` and their weights ``asked(qid, term, w)`` have hashed terms. Documents whose id is divisible
    by ``step`` lead; ``first`` is the least of them.
    """
    lead = b.cut(weights(packed, step))
    near = pruning.nearest_leaders(asked, lead, NEAR).groupBy("qid").agg(F.collect_list(F.struct(F.col("leader").alias("doc_id"), F.col("sim").alias("score"))).alias("votes"))
    champ = terms.join(champions(packed, terms.select("term").distinct(), CHAMPIONS), "term").groupBy("qid").agg(F.collect_set("doc_id").alias("cites"))
    rare = pruning.rare_terms(terms, df, n_docs, LEAST_IDF, LEAST_MATCH).select("qid", "term", F.col("need").cast("double").alias("w"))
    n = -(-terms.select("qid").distinct().count() // ASKED)
    none = [F.lit(b"").alias(c) for c in b.ATTACHED.replace(" binary", "").split(", ")]
    parts = b.parts(asked, n, near.join(champ, "qid", "full"), n).withColumn("role", F.lit(2))
    for role, frame in ((1, b.parts(rare, n, n=n)), (0, b.parts(lead.select(F.col("leader").alias("qid"), "term", F.col("wl").alias("w")), n_docs // step, n=1))):
        parts = parts.unionByName(frame.select("*", *none, F.lit(role).alias("role")))
    types = (np.int64, np.int64, np.int64, np.int64, np.float64, np.int64, np.int64, np.float64, np.int64, np.int64)
    nobody = np.iinfo(np.int64).min if first is None else first

    def run(batches):
        opened, best, read, last, block, held = {}, {}, {}, None, None, []

        def finish():
            leader = _followed([opened[x] for x in held if x[0] == 0], block, nobody)
            for key in (x for x in held if x[0] == 2):
                part = opened[key]
                scores, shared, masks = _masks(part, opened.get((1, key[1])), block, leader)
                for way, mask in masks.items():
                    have = read.setdefault(way, [0, 0])
                    have[0] += int(shared[mask].sum())
                    have[1] += int(mask.sum())
                    for row in np.flatnonzero(mask.any(axis=1)):
                        of = way, int(part[0][row])
                        best[of] = _placed(best.get(of, (np.zeros(0), np.zeros(0, np.int64))), scores[row], block[0], mask[row], k)

        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_buffer() for c in batch.columns[:-1]]
                if last != bytes(row[0]):
                    if held:
                        finish()
                    last, block, held = bytes(row[0]), b._opened(row[:7]), []
                key = batch.columns[-1][i].as_py(), bytes(row[7])
                if key not in opened:
                    opened[key] = [np.frombuffer(x, t).copy() for x, t in zip(row[7:], types, strict=True)]
                held.append(key)
        if held:
            finish()
        names = ["method", "qid", "doc_id", "score", "postings", "docs"]
        counts = [(way, None, None, None, *n) for way, n in read.items() if n[1]]
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in counts], schema)
        for way in WAYS:
            some = [(q, s, d) for (x, q), (s, d) in best.items() if x == way]
            if some:
                size = sum(len(s) for _, s, _ in some)
                columns = [pa.array([way] * size), pa.array(np.repeat([q for q, _, _ in some], [len(s) for _, s, _ in some])), pa.array(np.concatenate([d for _, _, d in some])), pa.array(np.concatenate([s for _, s, _ in some])), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    schema = pa.schema([("method", pa.string()), ("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64()), ("postings", pa.int64()), ("docs", pa.int64())])
    rows = b.cut(_paired(packed, parts).mapInArrow(run, "method string, qid bigint, doc_id bigint, score double, postings bigint, docs bigint"))
    ranked = rows.where("doc_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("method", "qid").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    return b.cut(ranked.unionByName(rows.where("doc_id is null").withColumn("rank", F.lit(None).cast("int"))))
