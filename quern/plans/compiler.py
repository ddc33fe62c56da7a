"""Trees of the query language as plans over the index tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import analysis, porter
from quern.operators import tolerant
from quern.sources.corpus import POSITIONAL

from .language import Node, QuerySyntaxError, day, parse, pretty, words, years


class Searcher:
    """Boolean search over postings(zone, term, doc_id, tf), tokens(zone, doc_id, pos, term) and docs(doc_id, court, date).

    Each node becomes a frame of distinct ``doc_id``; ``None`` stands for "no
    constraint", which is what a word gives that is not indexed.
    """

    def __init__(self, postings: DataFrame, tokens: DataFrame, docs: DataFrame, stem: bool = False):
        self.postings, self.tokens, self.docs, self.stem = postings, tokens, docs, stem

    def index_terms(self, text: str) -> list[str]:
        """The text's index terms; a few words on the driver, by the same expressions as documents."""
        got = self.docs.sparkSession.range(1).select(analysis.terms(F.lit(text)).alias("t")).first()["t"]
        return [porter.stem(t) if self.stem and len(t) > 3 and t.isalpha() else t for t in got]

    def _matching(self, frame: DataFrame, word: str) -> DataFrame | None:
        """Rows of ``frame`` whose term the word stands for; None if it isn't indexed."""
        if "*" in word:
            return frame.where(F.col("term").like(tolerant.wildcard_like(word)))
        known = self.index_terms(word)
        return frame.where(F.col("term") == known[0]) if known else None

    def docs_of(self, node: Node) -> DataFrame | None:
        return getattr(self, f"_{node.kind}")(node)

    def _term(self, node: Node) -> DataFrame | None:
        rows = self._matching(self.postings.where(F.col("zone") == (node.zone or "all")), node.value)
        return None if rows is None else rows.select("doc_id").distinct()

    def _all_terms(self, terms: list[str], zone: str) -> DataFrame:
        """Documents with every one of the terms in a zone: one pass, not a join a term."""
        need = len(set(terms))
        rows = self.postings.where((F.col("zone") == zone) & F.col("term").isin(*set(terms)))
        return rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == need).select("doc_id")

    def _places(self, node: Node) -> DataFrame | None:
        """(zone, doc_id, pos) at which a node matches, in the zones that keep positions; zone prefixes are not looked at."""
        kept = self.tokens.where(F.col("zone").isin(*POSITIONAL))
        if node.kind == "term":
            rows = self._matching(kept, node.value)
            return None if rows is None else rows.select("zone", "doc_id", "pos")
        if node.kind == "phrase":
            terms = self.index_terms(node.value)
            if not terms:
                return None
            parts = [kept.where(F.col("term") == t).select("zone", "doc_id", (F.col("pos") - i).alias("pos")) for i, t in enumerate(terms)]
            return reduce(lambda a, b: a.join(b, ["zone", "doc_id", "pos"]), parts)
        if node.kind in ("near", "then"):
            left, right = (self._places(c) for c in node.children)
            if left is None or right is None:
                return kept.limit(0).select("zone", "doc_id", "pos")
            a, b = left.alias("a"), right.alias("b")
            gap = F.col("b.pos") - F.col("a.pos")
            near = gap.between(1, node.k) if node.kind == "then" else F.abs(gap).between(1, node.k)
            same = (F.col("a.zone") == F.col("b.zone")) & (F.col("a.doc_id") == F.col("b.doc_id"))
            return a.join(b, same & near).select("b.zone", "b.doc_id", "b.pos").distinct()
        raise QuerySyntaxError("only words and phrases have a distance")

    def _phrase(self, node: Node) -> DataFrame | None:
        if node.zone and node.zone not in POSITIONAL:
            terms = self.index_terms(node.value)
            return self._all_terms(terms, node.zone) if terms else None
        places = self._places(node)
        if places is None:
            return None
        return (places.where(F.col("zone") == node.zone) if node.zone else places).select("doc_id").distinct()

    def _near(self, node: Node) -> DataFrame:
        return self._places(node).select("doc_id").distinct()

    _then = _near

    def _filter(self, node: Node) -> DataFrame:
        if node.zone == "court":
            hit = F.col("court") == node.value.upper()
        elif node.zone == "year":
            hit = F.year("date").between(*years(node.value))
        else:
            limit = F.lit(day(node.zone, node.value))
            hit = F.col("date") < limit if node.zone == "before" else F.col("date") > limit
        return self.docs.where(hit).select("doc_id")

    def _not(self, node: Node) -> DataFrame | None:
        inner = self.docs_of(node.children[0])
        return None if inner is None else self.docs.select("doc_id").join(inner, "doc_id", "left_anti")

    def _or(self, node: Node) -> DataFrame | None:
        parts = [p for p in map(self.docs_of, node.children) if p is not None]
        return reduce(DataFrame.unionByName, parts).distinct() if parts else None

    def _and(self, node: Node) -> DataFrame | None:
        wanted = [self.docs_of(c) for c in node.children if c.kind != "not"]
        unwanted = [self.docs_of(c.children[0]) for c in node.children if c.kind == "not"]
        wanted, unwanted = ([p for p in side if p is not None] for side in (wanted, unwanted))
        if not wanted and not unwanted:
            return None
        out = wanted[0] if wanted else self.docs.select("doc_id")
        for p in wanted[1:]:
            out = out.join(p, "doc_id", "left_semi")
        for p in unwanted:
            out = out.join(p, "doc_id", "left_anti")
        return out

    def search(self, query: str) -> DataFrame:
        """``doc_id`` of the documents that match; all of them if nothing constrains."""
        found = self.docs_of(parse(query))
        return self.docs.select("doc_id") if found is None else found

    def trace(self, query: str) -> DataFrame:
        """(step, node, docs): the number of documents that each node of the tree finds, inner nodes after their children, in one job."""
        steps: list[tuple[str, DataFrame]] = []

        def walk(node: Node) -> None:
            for child in node.children:
                walk(child)
            found = self.docs_of(node)
            steps.append((pretty(node), self.docs.select("doc_id") if found is None else found))

        walk(parse(query))
        parts = [f.agg(F.count("*").alias("docs")).select(F.lit(i).alias("step"), F.lit(label).alias("node"), "docs") for i, (label, f) in enumerate(steps)]
        return reduce(DataFrame.unionByName, parts)

    def and_costs(self, queries: list[str]) -> DataFrame:
        """(query, written, by_size, docs): what intersecting the words of a conjunction list by list reads,
        in the order written and from the shortest list on. Sizes of a few words' lists are known to the driver."""
        whole = self.postings.where("zone = 'all'")
        out = None
        for query in queries:
            terms = list(dict.fromkeys(self.index_terms(query)))
            sizes = {r["term"]: r["n"] for r in whole.where(F.col("term").isin(*terms)).groupBy("term").agg(F.count("*").alias("n")).collect()}
            lists = {t: sizes.get(t, 0) for t in terms}
            orders = {"written": terms, "by_size": sorted(terms, key=lambda t: (lists[t], t))}
            # Every document with the places of its words: the length of the common prefix says which intersections it is in.
            has = whole.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(F.collect_set("term").alias("have"))
            cols = []
            for name, order in orders.items():
                met = [F.count_if(F.forall(F.array(*map(F.lit, order[: i + 1])), lambda t: F.array_contains("have", t))) for i in range(len(order))]
                reads = sum((met[i - 1] + F.lit(lists[order[i]]) for i in range(1, len(order))), F.lit(0).cast("long"))
                cols.append(reads.cast("long").alias(name))
                last = met[-1]
            one = has.agg(*cols, last.alias("docs")).select(F.lit(query).alias("query"), "written", "by_size", "docs")
            out = one if out is None else out.unionByName(one)
        return out

    def ranked(self, query: str, k: int | None = None) -> DataFrame:
        """(doc_id, score, rank): sum over the query's words of (1 + log tf) times idf in the whole text."""
        node = parse(query)
        whole = self.postings.where("zone = 'all'")
        hits = None
        for kind, text in words(node):
            for t in [text] if "*" in text else self.index_terms(text):
                rows = whole.where(F.col("term").like(tolerant.wildcard_like(t))) if "*" in t else whole.where(F.col("term") == t)
                if kind == "term" or "*" not in text:
                    hits = rows if hits is None else hits.unionByName(rows)
                if kind == "term":
                    break
        found = self.search(query)
        if hits is None:
            scored = found.withColumn("score", F.lit(0.0))
        else:
            n = self.docs.agg(F.count("*").alias("n"))
            df = whole.groupBy("term").agg(F.count("*").alias("df"))
            w = hits.join(df, "term").crossJoin(F.broadcast(n)).select("doc_id", ((1 + F.log10("tf")) * F.log10(F.col("n") / F.col("df"))).alias("w"))
            scored = found.join(w.groupBy("doc_id").agg(F.sum("w").alias("score")), "doc_id", "left").select("doc_id", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"))
        out = scored.orderBy(F.desc("score"), "doc_id")
        return out if k is None else out.limit(k)
