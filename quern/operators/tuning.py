"""Choosing parameters: grids as tables, random search, cross-validation, coordinate ascent."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import evaluation, features, scoring


def folds(queries: DataFrame, n: int = 5) -> DataFrame:
    """(qid, fold) by a stable hash."""
    return queries.select("qid", F.floor(scoring.draw(F.lit("fold"), F.col("qid")) * n).cast("int").alias("fold"))


def bm25_grid(post: DataFrame | scoring.TextIndex, terms: DataFrame, n_docs: int, k1s, bs) -> DataFrame:
    """(k1, b, qid, doc_id, score) for every pair of parameters: one pass over the postings with a sum for each."""
    index = scoring.TextIndex.of(post)
    grid = [(float(k), float(b)) for k in k1s for b in bs]
    q = terms.join(index.df, "term").select("qid", "term", (F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qtf")).alias("wq"))
    mean = index.post.agg((F.sum("tf") / n_docs).alias("mean"))  # one row
    rows = scoring.few(q).join(index.sized.crossJoin(F.broadcast(mean)), "term")
    part = lambda k, b: F.col("wq") * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("mean")))
    sums = rows.groupBy("qid", "doc_id").agg(*[F.sum(part(k, b)).alias(f"s{i}") for i, (k, b) in enumerate(grid)])
    every = F.array(*[F.struct(F.lit(k).alias("k1"), F.lit(b).alias("b"), F.col(f"s{i}").alias("score")) for i, (k, b) in enumerate(grid)])
    return sums.select("qid", "doc_id", F.explode(every).alias("x")).select("x.k1", "x.b", "qid", "doc_id", "x.score")


def mean_ap(scores: DataFrame, qrels: DataFrame, by: list[str]) -> DataFrame:
    """(…by, map) of scores with parameter columns."""
    w = Window.partitionBy(*by, "qid").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return mean_ap_of(scores.withColumn("rank", F.row_number().over(w)).join(qrels, ["qid", "doc_id"]), qrels, by)


def mean_ap_of(hits: DataFrame, qrels: DataFrame, by: list[str]) -> DataFrame:
    """(…by, map) of the ranks (…by, qid, doc_id, rank) of relevant documents alone."""
    hits = hits.withColumn("i", F.row_number().over(Window.partitionBy(*by, "qid").orderBy("rank")))
    ap = hits.groupBy(*by, "qid").agg(F.sum(F.col("i") / F.col("rank")).alias("s"))
    n = qrels.groupBy("qid").agg(F.count("*").alias("n_rel"))
    total = n.agg(F.count("*").alias("nq"))
    return ap.join(n, "qid").groupBy(*by).agg(F.sum(F.col("s") / F.col("n_rel")).alias("s")).crossJoin(F.broadcast(total)).select(*by, (F.col("s") / F.col("nq")).alias("map"))


def neighbour_grid(near: DataFrame, edges: DataFrame, ks, powers) -> DataFrame:
    """(k, p, qid, doc_id, score): votes for every pair of parameters."""
    grid = near.sparkSession.createDataFrame([(int(k), int(p)) for k in ks for p in powers], "k int, p int")
    cites = edges.select(F.col("src").alias("neighbour"), F.col("dst").alias("doc_id")).distinct()
    rows = near.join(cites, "neighbour").crossJoin(F.broadcast(grid)).where("rank <= k")
    return rows.groupBy("k", "p", "qid", "doc_id").agg(F.sum(F.pow("sim", F.col("p").cast("double"))).alias("score"))


def weight_trials(names: list[str], n: int, seed: int = 13, seeds: list[dict[str, float]] | None = None) -> list[dict[str, float]]:
    """Each feature alone, given starts, and n points drawn evenly from the simplex."""
    rng = random.Random(seed)
    out = [{m: float(m == name) for m in names} for name in names] + list(seeds or [])
    for _ in range(n):
        draw = [rng.expovariate(1.0) for _ in names]
        out.append({m: x / sum(draw) for m, x in zip(names, draw, strict=True)})
    return out


def search(rows: DataFrame, qrels: DataFrame, trials: list[dict[str, float]], by_fold: DataFrame) -> DataFrame:
    """(trial, fold, map, n): every trial's net score over scaled features, by fold, in one job."""
    spark, names = rows.sparkSession, list(trials[0])
    table = spark.createDataFrame([(i, *[t[n] for n in names]) for i, t in enumerate(trials)], "trial int, " + ", ".join(f"w_{n} double" for n in names))
    score = sum((F.col(n) * F.col(f"w_{n}") for n in names[1:]), F.col(names[0]) * F.col(f"w_{names[0]}"))
    scored = rows.crossJoin(F.broadcast(table)).select("trial", "qid", "doc_id", score.alias("score"))
    w = Window.partitionBy("trial", "qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return searched(scored.withColumn("rank", F.row_number().over(w)).join(qrels, ["qid", "doc_id"]), qrels, len(trials), by_fold)


def trial_places(rows: DataFrame, trials: list[dict[str, float]], digits: int = 9) -> DataFrame:
    """(trial, qid, doc_id, rank) of the cited documents of ``rows(qid, doc_id, cites, …)`` under every trial: a query's rows
    are ranked where they stand, and none is copied for a trial."""
    import numpy as np
    import pyarrow as pa

    from .blocks import _rounded

    names = list(trials[0])

    def rank(table):
        docs, cited = table.column("doc_id").to_numpy(), table.column("cites").to_numpy().astype(bool)
        columns, out = [table.column(n).to_numpy() for n in names], []
        for t in trials if cited.any() else ():
            score = columns[0] * t[names[0]]
            for x, n in zip(columns[1:], names[1:], strict=True):
                score = score + x * t[n]
            by = np.lexsort((docs, -_rounded(score, digits)))
            out.append(np.flatnonzero(cited[by]) + 1)
            out.append(docs[by][cited[by]])
        n = int(cited.sum()) if out else 0
        ranks, found = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (out[::2], out[1::2]))
        qid = table.column("qid")[0].as_py()
        columns = [np.repeat(np.arange(len(trials), dtype=np.int32), n), np.full(len(ranks), qid, np.int64), found, ranks.astype(np.int32)]
        return pa.table([pa.array(c) for c in columns], names=["trial", "qid", "doc_id", "rank"])

    return rows.select("qid", "doc_id", "cites", *names).groupBy("qid").applyInArrow(rank, "trial int, qid bigint, doc_id bigint, rank int")


def searched(hits: DataFrame, qrels: DataFrame, n_trials: int, by_fold: DataFrame) -> DataFrame:
    """As :func:`search`, from the ranks (trial, qid, doc_id, rank) of relevant documents alone."""
    table = hits.sparkSession.createDataFrame([(i,) for i in range(n_trials)], "trial int")
    hits = hits.withColumn("i", F.row_number().over(Window.partitionBy("trial", "qid").orderBy("rank")))
    ap = hits.groupBy("trial", "qid").agg(F.sum(F.col("i") / F.col("rank")).alias("s"))
    n_rel = qrels.groupBy("qid").agg(F.count("*").alias("n_rel")).join(by_fold, "qid")
    every = n_rel.crossJoin(F.broadcast(table.select("trial")))
    return every.join(ap, ["trial", "qid"], "left").groupBy("trial", "fold").agg(F.avg(F.coalesce(F.col("s") / F.col("n_rel"), F.lit(0.0))).alias("map"), F.count("*").alias("n"))


def nested(results: DataFrame) -> DataFrame:
    """(fold, trial, map): for each fold the trial that is best on the others, with its score on the fold."""
    per_trial = Window.partitionBy("trial")
    mass, n = F.sum(F.col("map") * F.col("n")).over(per_trial), F.sum("n").over(per_trial)
    r = results.withColumn("others", F.round((mass - F.col("map") * F.col("n")) / (n - F.col("n")), 9))
    w = Window.partitionBy("fold").orderBy(F.desc("others"), "trial")
    return r.withColumn("r", F.row_number().over(w)).where("r = 1").select("fold", "trial", "map")


def coordinate_ascent(rows: DataFrame, qrels: DataFrame, names: list[str], grid=(0.0, 0.1, 0.25, 0.5), rounds: int = 5, start: dict[str, float] | None = None) -> tuple[dict[str, float], float]:
    """Weights that no single change on the grid improves. Each round tries all changes in one job over cached features."""
    rows = rows.select("qid", "doc_id", *names).persist()
    one = qrels.select("qid").distinct().withColumn("fold", F.lit(0))
    weights, best = start or {n: 1 / len(names) for n in names}, -1.0
    try:
        for _ in range(rounds):
            tried = [weights] + [{**weights, n: g} for n in names for g in grid if g != weights[n]]
            tried = [t for t in tried if sum(t.values()) > 0]
            tried = [{n: w / sum(t.values()) for n, w in t.items()} for t in tried]
            top = search(rows, qrels, tried, one).orderBy(F.desc(F.round("map", 9)), "trial").first()
            if top is None or top["map"] <= best + 1e-9:
                break
            weights, best = tried[top["trial"]], top["map"]
    finally:
        rows.unpersist()
    return weights, best


def ablation(rows: DataFrame, qrels: DataFrame, subsets: dict[str, dict[str, float]]) -> DataFrame:
    """(system, measures): named sets of weights over the same scaled features."""
    out = None
    for name, weights in subsets.items():
        ranked = features.ordered(rows.withColumn("net", features.reweighted(weights)))
        got = evaluation.averages(evaluation.measures(ranked, qrels)).withColumn("system", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def frozen(results: DataFrame, trials: list[dict[str, float]]) -> dict:
    """The trial of the best mean over all folds, with its weights, fold scores and the nested score: what a release fixes."""
    rows = results.collect()  # one row a trial and fold
    total = {}
    for r in rows:
        s, n = total.get(r["trial"], (0.0, 0))
        total[r["trial"]] = (s + r["map"] * r["n"], n + r["n"])
    best = min(total, key=lambda t: (-round(total[t][0] / total[t][1], 9), t))
    held = nested(results).join(results.select("fold", "trial", "n"), ["fold", "trial"]).collect()
    return {
        "weights": {k: round(v, 5) for k, v in trials[best].items()}, "map": round(total[best][0] / total[best][1], 5),
        "fold_map": [round(r["map"], 5) for r in sorted(rows, key=lambda r: r["fold"]) if r["trial"] == best],
        "nested_map": round(sum(r["map"] * r["n"] for r in held) / sum(r["n"] for r in held), 5),
    }


def regularised(rows: DataFrame, qrels: DataFrame, fixed: str, names: list[str], by_fold: DataFrame, grid=(0.0, 0.05, 0.1, 0.2, 0.4, 0.8), sweeps: int = 5) -> tuple[dict[str, float], int]:
    """Weights that are added to ``fixed`` at weight 1, by coordinate ascent that stops after the number of sweeps that is best on held-out folds."""

    def path(of: DataFrame) -> list[dict[str, float]]:
        have = [dict.fromkeys(names, 0.0)]
        for _ in range(sweeps):
            now = dict(have[-1])
            for name in names:
                tried = [now] + [{**now, name: g} for g in grid if g != now[name]]
                top = search(rows, of, [{fixed: 1.0, **t} for t in tried], of.select("qid").distinct().withColumn("fold", F.lit(0)))
                now = tried[top.orderBy(F.desc(F.round("map", 6)), "trial").first()["trial"]]
            have.append(now)
            if now == have[-2]:
                break
        return have + [have[-1]] * (sweeps + 1 - len(have))

    rows = rows.select("qid", "doc_id", fixed, *names).persist()
    try:
        total = [0.0] * (sweeps + 1)
        for fold in [r["fold"] for r in by_fold.select("fold").distinct().orderBy("fold").collect()]:
            inside = by_fold.where(F.col("fold") == fold)
            outside = qrels.join(inside, "qid", "left_anti")
            held = qrels.join(inside, "qid", "left_semi")
            steps = path(outside)
            got = search(rows, held, [{fixed: 1.0, **t} for t in steps], inside).collect()
            for r in got:
                total[r["trial"]] += r["map"]
        best = max(range(sweeps + 1), key=lambda i: (round(total[i], 9), -i))
        return {fixed: 1.0, **path(qrels)[best]}, best
    finally:
        rows.unpersist()
