"""Citation, neighbour and date features, and the net score made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scoring

#: Standing of courts; the frozen weights and neighbour settings.
COURT_PRIOR = {"SC": 1.0, "HC": 0.6}
OTHER_COURT = 0.3
WEIGHTS = {"text": 0.35444, "neighbour": 0.48788, "authority": 0.15768}
NEIGHBOURS, POWER = 20, 4
#: Documents of the best text scores that are ranked by the net score.
FIRST_STAGE = 1000
#: Cited documents, or queries, that are sent to all tasks at most.
CITED_ROWS = 1_000_000


def court_prior(court: Column) -> Column:
    out = F.lit(OTHER_COURT)
    for name, value in COURT_PRIOR.items():
        out = F.when(court == name, value).otherwise(out)
    return out


def year_gap(later: Column, earlier: Column) -> Column:
    return F.year(later) - F.year(earlier)


def recency(gap: Column, tau: float) -> Column:
    return F.when(gap >= 0, F.exp(-gap / tau)).otherwise(0.0)


def precedes(doc_date: Column, query_date: Column) -> Column:
    """Whether a document may be cited: it is older, or a date is unknown."""
    return F.coalesce(doc_date < query_date, F.lit(True))


def authority_of(pairs: DataFrame, edges: DataFrame, queries: DataFrame, splits: tuple[str, ...] = ("train",), leave_one_out: bool = True) -> DataFrame:
    """``pairs(qid, doc_id)`` with ``authority``: log(1 + citations) from pool documents and queries of ``splits``,
    the query's own left out. No pair beyond those given is formed."""
    inside = queries.where(F.col("split").isin(*splits)).select(F.col("qid").alias("src"))
    sources = edges.join(queries.select(F.col("qid").alias("src")), "src", "left_anti").unionByName(edges.join(inside, "src", "left_semi"))
    out = pairs.join(scoring.popularity(sources), "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    if leave_one_out:
        own = sources.select(F.col("src").alias("qid"), F.col("dst").alias("doc_id")).distinct().withColumn("own", F.lit(1))
        out = out.join(own, ["qid", "doc_id"], "left")
        n = n - F.coalesce("own", F.lit(0))
    return out.withColumn("authority", F.log1p(n)).drop("n", "own")


def asked_weights(terms: DataFrame, df: DataFrame, n: Column | int) -> DataFrame:
    """(qid, term, w): normed weights of the terms(qid, term, qtf) that some but not all of n training queries hold."""
    n = n if isinstance(n, Column) else F.lit(n)
    idf = df.select("term", F.log10(n / F.col("df")).alias("idf")).where("idf > 0")
    asked = terms.join(idf, "term").withColumn("w", (1 + F.log10("qtf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qid")))
    return asked.select("qid", "term", F.when(norm > 0, F.col("w") / norm).otherwise(0.0).alias("w"))


def neighbours(terms: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, asked: DataFrame | None = None) -> DataFrame:
    """(qid, neighbour, sim, rank): the most similar training queries, a query itself left out; similarities are positive.

    ``asked(qid, term, qtf)`` are the queries that neighbours are sought for, by default all of ``terms``.
    Terms that all training queries hold weigh nothing and are not joined.
    """
    train = queries.where("split = 'train'").select("qid")
    t = terms.join(train, "qid", "left_semi")
    n = train.agg(F.count("*").alias("n"))
    df = t.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    asked = asked_weights(terms if asked is None else asked, df, F.col("n"))
    index = scoring.document_weights(t.select("term", F.col("qid").alias("doc_id"), F.col("qtf").alias("tf")))
    sims = scoring.dot(asked, index).where("qid <> doc_id").select("qid", F.col("doc_id").alias("neighbour"), F.round("score", 9).alias("sim")).where("sim > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "neighbour")
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def votes(near: DataFrame, edges: DataFrame, k: int = NEIGHBOURS, power: int = POWER) -> DataFrame:
    """(qid, doc_id, neighbour): sums of sim**power over the k nearest that cite a document."""
    cites = edges.select(F.col("src").alias("neighbour"), F.col("dst").alias("doc_id")).distinct()
    hit = near.where(F.col("rank") <= k).join(cites, "neighbour")
    return hit.groupBy("qid", "doc_id").agg(F.sum(F.pow("sim", F.lit(float(power)))).alias("neighbour"))


def vote_reasons(near: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, doc_id, reasons): the neighbours that cite a document, most similar first."""
    cites = edges.select(F.col("src").alias("neighbour"), F.col("dst").alias("doc_id")).distinct()
    hit = near.join(cites, "neighbour").groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "neighbour"))).alias("r"))
    return hit.select("qid", "doc_id", F.transform("r", lambda x: F.struct(x["neighbour"], (-x["s"]).alias("sim"))).alias("reasons"))


def candidates(sources: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """(qid, doc_id): union of the best n of each (frame, score, n); the query itself is left out."""
    out = None
    for frame, score, n in sources:
        w = Window.partitionBy("qid").orderBy(F.desc(score), "doc_id")
        top = frame.where(F.col(score).isNotNull() & (F.col("qid") != F.col("doc_id"))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("qid", "doc_id")
        out = top if out is None else out.unionByName(top)
    return out.distinct()


def scaled(rows: DataFrame, names: list[str]) -> DataFrame:
    """Features scaled to [0, 1] among a query's candidates; constant ones become 0."""
    w = Window.partitionBy("qid")
    lo, hi = (lambda c: F.min(c).over(w)), (lambda c: F.max(c).over(w))
    return rows.select("qid", "doc_id", *[F.when(hi(c) > lo(c), (F.col(c) - lo(c)) / (hi(c) - lo(c))).otherwise(0.0).alias(c) for c in names], *[c for c in rows.columns if c not in ("qid", "doc_id", *names)])


def net(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.col(name) * w
    return out


def reweighted(weights: dict[str, float]) -> Column:
    """Net score with weights that are first made to sum to 1."""
    total = sum(weights.values())
    return net({k: (w / total if total else 0.0) for k, w in weights.items()})


def ordered(rows: DataFrame, removed: Column | None = None, digits: int = 6) -> DataFrame:
    """Rank: removed documents last, then net score, text, document."""
    gone = F.lit(False) if removed is None else removed
    w = Window.partitionBy("qid").orderBy(gone, F.desc(F.round("net", digits)), F.desc(F.round("text", digits)), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w))


def expected_ranks(rows: DataFrame, score: str = "net", digits: int = 6) -> DataFrame:
    """Mean rank over the orders of ties: 1 + better + (equal - 1) / 2."""
    s = F.round(score, digits)
    better = F.rank().over(Window.partitionBy("qid").orderBy(F.desc(s)))
    equal = F.count("*").over(Window.partitionBy("qid", s))
    return rows.withColumn("expected_rank", better + (equal - 1) / 2)


def explained(weights: dict[str, float]) -> Column:
    """Array of (name, contribution), greatest first."""
    parts = F.array(*[F.struct(F.round(-F.col(n) * w, 5).alias("c"), F.lit(n).alias("name")) for n, w in weights.items()])
    return F.transform(F.array_sort(parts), lambda p: F.struct(p["name"].alias("name"), (-p["c"]).alias("contribution")))


def assembled(text: DataFrame, vote: DataFrame, edges: DataFrame, queries: DataFrame, splits=("train",), leave_one_out: bool = True) -> DataFrame:
    """The first stage ``text(qid, doc_id, score)`` with text, neighbour and authority features, 0 where they have none."""
    rows = text.select("qid", "doc_id", F.col("score").alias("text")).join(vote, ["qid", "doc_id"], "left")
    rows = rows.withColumn("neighbour", F.coalesce("neighbour", F.lit(0.0)))
    return authority_of(rows, edges, queries, splits, leave_one_out)


def with_authority(rows: DataFrame, edges: DataFrame, queries: DataFrame, splits=("train",), leave_one_out: bool = True, name: str = "authority") -> DataFrame:
    """``rows(qid, doc_id, cites, …)`` with the authority of :func:`authority_of`: whether a query cites a document stands in
    its row, so that rows move only if cited documents are more than are broadcast."""
    inside = queries.where(F.col("split").isin(*splits)).select("qid")
    sources = edges.join(queries.select(F.col("qid").alias("src")), "src", "left_anti").unionByName(edges.join(inside.select(F.col("qid").alias("src")), "src", "left_semi"))
    out = rows.join(scoring.few(scoring.popularity(sources), CITED_ROWS), "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    if leave_one_out:
        out = out.join(scoring.few(inside.withColumn("inside", F.lit(True)), CITED_ROWS), "qid", "left")
        n = n - F.when(F.col("cites") & F.coalesce("inside", F.lit(False)), 1).otherwise(0)
    return out.withColumn(name, F.log1p(n)).drop("n", "inside")


def places(rows: DataFrame, orders: dict[str, list[Column]]) -> DataFrame:
    """``rows`` with a rank for each named order; all stand on one shuffle by query."""
    return rows.select("*", *[F.row_number().over(Window.partitionBy("qid").orderBy(*by)).alias(name) for name, by in orders.items()])


def net_order(net: Column, text: Column, removed: Column | None = None, digits: int = 6) -> list[Column]:
    """The order of :func:`ordered`."""
    return [F.lit(False) if removed is None else removed, F.desc(F.round(net, digits)), F.desc(F.round(text, digits)), F.col("doc_id")]


def union_recall(sources: list[tuple[DataFrame, str]], qrels: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(size, recall, mean_size): share of relevant documents in the union of the best ``size`` of every (frame, score), and its mean size, over queries with any."""
    n = qrels.groupBy("qid").agg(F.count("*").alias("n_rel"))
    out = None
    for size in sizes:
        cand = candidates([(frame, score, size) for frame, score in sources]).join(n.select("qid"), "qid", "left_semi")
        hits = cand.join(qrels, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
        per = n.join(cand.groupBy("qid").agg(F.count("*").alias("size")), "qid", "left").join(hits, "qid", "left")
        zero = F.lit(0)
        one = per.agg(F.avg(F.coalesce("hits", zero) / F.col("n_rel")).alias("recall"), F.avg(F.coalesce("size", zero)).alias("mean_size")).select(F.lit(size).alias("size"), "recall", "mean_size")
        out = one if out is None else out.unionByName(one)
    return out
