"""Text scores of all queries at once: joins on terms, sums by (query, document).

Inputs: postings(term, doc_id, tf) of one zone, or a :class:`TextIndex` of them;
query terms (qid, term, qtf). A query side of ``FEW_ROWS`` at most is broadcast,
so that postings don't shuffle; a greater one is joined by shuffles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW_ROWS = 200_000


def frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def few(rows: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``rows`` marked for broadcast if a count says that there are ``most`` at most."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


class TextIndex:
    """Postings of one zone with what scores need of them: document frequencies, weights and lengths.

    ``keep`` is applied to each table when it is first asked for; an index that
    serves many queries passes one that persists.
    """

    def __init__(self, post: DataFrame, keep=lambda table: table):
        self.post, self._keep = post, keep

    @classmethod
    def of(cls, post: DataFrame | TextIndex) -> TextIndex:
        return post if isinstance(post, cls) else cls(post)

    @cached_property
    def df(self) -> DataFrame:
        return self._keep(frequencies(self.post))

    @cached_property
    def weights(self) -> DataFrame:
        return self._keep(document_weights(self.post))

    @cached_property
    def sized(self) -> DataFrame:
        """(term, doc_id, tf, len)."""
        return self._keep(self.post.join(self.post.groupBy("doc_id").agg(F.sum("tf").alias("len")), "doc_id").select("term", "doc_id", "tf", "len"))


def document_weights(post: DataFrame) -> DataFrame:
    """(term, doc_id, w): 1 + log tf over the document's norm."""
    w = post.withColumn("w", 1 + F.log10("tf"))
    norm = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "doc_id").select("term", "doc_id", (F.col("w") / F.col("norm")).alias("w"))


def query_weights(terms: DataFrame, df: DataFrame, n_docs: Column | int) -> DataFrame:
    """(qid, term, w): (1 + log qtf) idf over the norm of the query's known terms; 0 where that is 0."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    w = terms.join(df, "term").withColumn("w", (1 + F.log10("qtf")) * F.log10(n / F.col("df")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qid")))
    return w.select("qid", "term", F.when(norm > 0, F.col("w") / norm).otherwise(0.0).alias("w"))


def dot(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id, score): sums of products over shared terms."""
    both = few(queries.select("qid", "term", F.col("w").alias("wq"))).join(docs.select("term", "doc_id", F.col("w").alias("wd")), "term")
    return both.groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def tfidf(post: DataFrame | TextIndex, terms: DataFrame, n_docs: int, among: DataFrame | None = None) -> DataFrame:
    """Cosine of log-weighted documents and idf-weighted queries; ``among(qid, doc_id)`` restricts the candidates."""
    index = TextIndex.of(post)
    out = dot(query_weights(terms, index.df, n_docs), index.weights)
    return out if among is None else out.join(among, ["qid", "doc_id"], "left_semi")


def bm25_weights(terms: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """(qid, term, w) of raw query frequencies."""
    return terms.join(df, "term").select("qid", "term", (F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qtf").cast("double")).alias("w"))


def bm25(post: DataFrame | TextIndex, terms: DataFrame, n_docs: int, k1: float = 1.2, b: float = 0.75, query_tf: str = "raw", k3: float = 1.2) -> DataFrame:
    """Okapi scores; the query's frequency counts raw, binary or saturated. Mean length is over all documents, empty ones too."""
    factor = {"raw": F.col("qtf").cast("double"), "binary": F.lit(1.0), "saturated": F.col("qtf") * (k3 + 1) / (F.col("qtf") + k3)}[query_tf]
    index = TextIndex.of(post)
    q = terms.join(index.df, "term").select("qid", "term", (F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)) * factor).alias("w"))
    mean = index.post.agg((F.sum("tf") / n_docs).alias("mean"))  # one row
    long = 1 - b + b * F.col("len") / F.col("mean")
    d = index.sized.crossJoin(F.broadcast(mean)).select("term", "doc_id", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * long)).alias("w"))
    return dot(q, d)


def ranked(scores: DataFrame, k: int | None = None, digits: int = 6, score: str = "score") -> DataFrame:
    """(qid, doc_id, score, rank): best first, equal (rounded) scores by document."""
    s = scores.withColumn(score, F.round(score, digits))
    out = s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "doc_id")))
    return out if k is None else out.where(F.col("rank") <= k)


def zone_pairs(post: DataFrame, views: DataFrame, n_docs: int, view_names: tuple[str, ...], zone_names: tuple[str, ...], among: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, one column a view and zone): cosines of every query view (qid, view, term, qtf) with
    every zone of postings(zone, term, doc_id, tf), 0 where they share nothing.

    Weights of all views stand in one row a query and term, those of all zones in one row a document and
    term: the postings are joined once, and one sum gives all pairs.
    """
    df = post.groupBy("zone", "term").agg(F.count("*").alias("df"))
    w = 1 + F.log10("tf")
    size = lambda z: F.sqrt(F.sum(F.when(F.col("zone") == z, w * w)))
    norms = post.groupBy("doc_id").agg(*[size(z).alias(f"n_{z}") for z in zone_names])
    wide = post.groupBy("term", "doc_id").agg(*[F.sum(F.when(F.col("zone") == z, w)).alias(f"d_{z}") for z in zone_names])
    wide = wide.join(norms, "doc_id").select("term", "doc_id", *[F.coalesce(F.col(f"d_{z}") / F.col(f"n_{z}"), F.lit(0.0)).alias(f"d_{z}") for z in zone_names])
    q = views.join(df, "term").withColumn("w", (1 + F.log10("qtf")) * F.log10(n_docs / F.col("df")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qid", "view", "zone")))
    q = q.withColumn("w", F.when(norm > 0, F.col("w") / norm).otherwise(0.0))
    pairs = [(v, z) for v in view_names for z in zone_names]
    one = [F.coalesce(F.sum(F.when((F.col("view") == v) & (F.col("zone") == z), F.col("w"))), F.lit(0.0)).alias(f"q_{v}_{z}") for v, z in pairs]
    rows = few(q.groupBy("qid", "term").agg(*one)).join(wide, "term")
    rows = rows if among is None else rows.join(among, ["qid", "doc_id"], "left_semi")
    return rows.groupBy("qid", "doc_id").agg(*[F.sum(F.col(f"q_{v}_{z}") * F.col(f"d_{z}")).alias(f"{v}_{z}") for v, z in pairs])


def zone_pair_score(pairs: DataFrame, weights: dict[tuple[str, str], float]) -> DataFrame:
    """Weighted sums of zone-pair cosines; weights are not negative and sum to 1."""
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must not be negative and must sum to 1")
    return pairs.select("qid", "doc_id", sum((F.col(f"{v}_{z}") * w for (v, z), w in weights.items()), F.lit(0.0)).alias("score"))


def popularity(edges: DataFrame) -> DataFrame:
    """(doc_id, n): citing sources of each cited document."""
    return edges.distinct().groupBy(F.col("dst").alias("doc_id")).agg(F.count("*").alias("n"))


def draw(*keys: Column) -> Column:
    """A number in [0, 1) from the MD5 of the keys: the same wherever it is computed."""
    text = F.concat_ws("/", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def random_scores(pairs: DataFrame, seed: int = 13) -> DataFrame:
    """A hash of (seed, query, document) as a score in [0, 1)."""
    return pairs.withColumn("score", draw(F.lit(seed), F.col("qid"), F.col("doc_id")))


def term_overlap(post: DataFrame, terms: DataFrame, statutes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The demonstration ranker: 0.7 hits over the query's most, and 0.3 Jaccard of statute sets (qid / doc_id, statutes)."""
    hits = terms.join(post, "term").groupBy("qid", "doc_id").agg(F.sum("tf").alias("hits"))
    share = 0.7 * F.col("hits") / F.max("hits").over(Window.partitionBy("qid"))
    if statutes is None:
        return hits.select("qid", "doc_id", share.alias("score"))
    q, d = statutes
    both = hits.join(q.select("qid", F.col("statutes").alias("a")), "qid").join(d.select("doc_id", F.col("statutes").alias("b")), "doc_id")
    n = F.size(F.array_union("a", "b"))
    return both.select("qid", "doc_id", (share + 0.3 * F.when(n > 0, F.size(F.array_intersect("a", "b")) / n).otherwise(0.0)).alias("score"))


def with_channel(scores: DataFrame, channel: DataFrame, beta: float) -> DataFrame:
    """Text over the query's best text, plus beta times a channel(qid, doc_id, channel)."""
    top = F.max("score").over(Window.partitionBy("qid"))
    text = scores.select("qid", "doc_id", F.when(top > 0, F.col("score") / top).otherwise(0.0).alias("score"))
    return text.join(channel, ["qid", "doc_id"], "left").select("qid", "doc_id", (F.col("score") + beta * F.coalesce("channel", F.lit(0.0))).alias("score"))
