import datetime
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import crawl, evaluation, features, fusion, index, pruning, scoring, sessions, statutes, tolerant, tuning
from quern.plans import language
from quern.plans.compiler import Searcher
from quern.sources import corpus

PARAS = [
    ("A", "facts", "the accused committed murder with a knife"), ("A", "issues", "whether the burden of proof was discharged"), ("A", "decision", "appeal dismissed"),
    ("B", "facts", "murder trial witness turned hostile"), ("B", "issues", "whether dowry death is proved"), ("B", "reasoning", "murder charge fails"),
    ("C", "facts", "land acquisition compensation awarded"), ("C", "issues", "whether compensation is adequate"), ("C", "decision", "appeal allowed"),
    ("D", "facts", "knife attack and murder near market"), ("D", "issues", "proof of intention"),
]
DOCS = [("A", "SC", datetime.date(1990, 5, 1)), ("B", "HC", datetime.date(2005, 3, 3)), ("C", "SC", datetime.date(2012, 7, 7)), ("D", "OTHER", None)]


@pytest.fixture(scope="module")
def search(spark):
    rows = [(d, i, z, t) for i, (d, z, t) in enumerate(PARAS)]
    paras = spark.createDataFrame(rows, "doc_id string, para int, zone string, line string")
    toks = index.tokens(paras, stem=True).persist()
    docs = spark.createDataFrame(DOCS, "doc_id string, court string, date date")
    return Searcher(index.postings(toks).persist(), toks, docs, stem=True)


@pytest.mark.parametrize(
    ("query", "docs"),
    [("murder", "ABD"), ("murder AND knife", "AD"), ("knife OR compensation", "ACD"), ("murder AND NOT knife", "B"), ("NOT murder", "C"), ("(knife OR dowry) AND murder", "ABD"),
     ("the murder", "ABD"), ("the of", "ABCD"), ("reasoning:murder", "B"), ("decision:murder", ""), ("issues:dowry", "B"), ('"burden of proof"', "A"), ('"proof burden"', ""), ('"murder knife"', "A"),
     ("murder /1 knife", "A"), ("murder /2 knife", "AD"), ("knife pre/2 murder", "D"), ("murder pre/1 knife", "A"), ("murder /0 knife", ""), ('decision:"appeal dismissed"', "A"),
     ("murd*", "ABD"), ("acquis*", "C"), ("xyz*", ""), ("court:SC", "AC"), ("year:1990..2005", "AB"), ("year:>=2000", "BC"), ("before:2000-01-01", "A"), ("after:2000-01-01", "BC")],
)
def test_boolean(search, query, docs):
    assert "".join(sorted(r["doc_id"] for r in search.search(query).collect())) == docs


@pytest.mark.parametrize("query", ["", "(a", "a)", "AND", "murder /5", "nofield:x y:", "a OR", "before:1990"])
def test_syntax_errors(search, query):
    with pytest.raises(language.QuerySyntaxError):
        search.search(query)


def test_printers():
    node = language.parse('a "b c" OR NOT facts:d')
    assert language.pretty(node) == '((a AND "b c") OR NOT facts:d)'
    assert language.words(node) == [("term", "a"), ("phrase", "b c")]
    assert language.tree(node)["kind"] == "or"


def test_boolean_ranking(search):
    got = search.ranked("murder knife").collect()
    assert [r["doc_id"] for r in got] == ["A", "D"] and got[0]["score"] == got[1]["score"] > 0


def test_wildcards_and_spelling(spark):
    words = "cat catch category cattle action convention motion nation notion mother murder murderer mardar tin".split()
    terms = spark.createDataFrame([(w, 2) for w in words], "term string, df long")
    assert [r["term"] for r in tolerant.wildcard(terms, "*tion").collect()] == ["action", "convention", "motion", "nation", "notion"]
    assert [r["term"] for r in tolerant.wildcard(terms, "con*ion").collect()] == ["convention"]
    asked = spark.createDataFrame([("murdar",)], "word string")
    assert tolerant.suggestions(terms, asked).orderBy("rank").first()["term"] in ("murder", "mardar")


def test_measures(spark):
    ranks = spark.createDataFrame([(1, d, i) for i, d in enumerate("abcde", 1)], "qid int, doc_id string, rank int")
    rel = spark.createDataFrame([(1, d) for d in "acf"], "qid int, doc_id string")
    m = evaluation.measures(ranks, rel, (3, 5)).first()
    assert m["p3"] == pytest.approx(2 / 3) and m["r3"] == pytest.approx(2 / 3) and m["f3"] == pytest.approx(2 / 3) and m["p5"] == pytest.approx(0.4)
    assert m["ap"] == pytest.approx((1 + 2 / 3) / 3) and m["rr"] == 1


def test_split_guard():
    with pytest.raises(evaluation.SplitGuard):
        evaluation.guard("test")
    assert evaluation.guard("test", final=True) == "test" and evaluation.guard("dev") == "val"


def test_rrf(spark):
    lists = [(1, 1, "a", 1), (1, 1, "b", 2), (1, 1, "c", 3), (1, 2, "b", 1), (1, 2, "c", 2), (1, 2, "a", 3), (2, 1, "x", 1), (2, 2, "y", 1), (2, 3, "x", 1)]
    got = fusion.rrf(spark.createDataFrame(lists, "qid int, list_no int, doc_id string, rank int")).orderBy("qid", "rank").collect()
    assert [r["doc_id"] for r in got] == ["b", "a", "c", "x", "y"]


def test_bm25_against_plain_python(spark):
    import math

    docs = {1: "a a b", 2: "b c", 3: "c c c d"}
    post = [(t, d, x.split().count(t)) for d, x in docs.items() for t in set(x.split())]
    got = scoring.bm25(spark.createDataFrame(post, "term string, doc_id long, tf long"), spark.createDataFrame([(0, "a", 1), (0, "c", 2)], "qid int, term string, qtf long"), 4)
    mean = 9 / 4
    for r in got.collect():
        want = 0.0
        for t, q in (("a", 1), ("c", 2)):
            tf, df = docs[r["doc_id"]].split().count(t), sum(t in x.split() for x in docs.values())
            want += q * math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[r["doc_id"]].split()) / mean))
        assert r["score"] == pytest.approx(want)


def test_authority_leaves_one_out(spark):
    edges = spark.createDataFrame([(0, 1), (9, 2), (9, 3), (100, 1), (100, 2), (200, 2)], "src long, dst long")
    queries = spark.createDataFrame([(9, "val"), (100, "train"), (200, "train")], "qid long, split string")
    pairs = spark.createDataFrame([(q, d) for q in (9, 100, 200) for d in range(4)], "qid long, doc_id long")
    got = {(r["qid"], r["doc_id"]): round(2.718281828459045 ** r["authority"] - 1) for r in features.authority_of(pairs, edges, queries).collect()}
    assert [got[100, d] for d in range(4)] == [0, 1, 1, 0]
    assert [got[9, d] for d in range(4)] == [0, 2, 2, 0]


def test_scaling_and_order(spark):
    rows = spark.createDataFrame([(1, d, float(x), 5.0) for d, x in enumerate((1, 3, 5))], "qid int, doc_id long, text double, same double")
    got = features.scaled(rows, ["text", "same"]).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [0.0, 0.5, 1.0] and {r["same"] for r in got} == {0.0}
    ranked = features.expected_ranks(spark.createDataFrame([(1, 1.0), (1, 0.5), (1, 0.5)], "qid int, net double")).orderBy("expected_rank").collect()
    assert [r["expected_rank"] for r in ranked] == [1.0, 2.5, 2.5]


def test_recency_and_dates(spark):
    gaps = spark.createDataFrame([(10,), (-5,), (None,), (0,)], "gap int").select(features.recency(F.col("gap"), 10.0).alias("r")).collect()
    assert [round(r["r"], 6) for r in gaps] == [0.367879, 0.0, 0.0, 1.0]
    dates = spark.createDataFrame([("1995",), (" 2001-02-03T10 ",), ("2001-13-03",), (None,)], "t string").select(corpus.parse_date(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in dates] == [None, datetime.date(2001, 2, 3), None, None]
    courts = spark.createDataFrame([("Supreme Court of India",), ("Delhi High Court",), ("X",), (" ",), (None,)], "j string").select(corpus.court_of(F.col("j")).alias("c")).collect()
    assert [r["c"] for r in courts] == ["SC", "HC", "OTHER", None, None]


def test_pruning(spark):
    w = [("t0", 0, 0.9), ("t0", 1, 0.5), ("t0", 2, 0.1), ("t1", 1, 0.8), ("t1", 3, 0.7), ("t2", 2, 0.6), ("t2", 4, 0.2), ("t2", 5, 0.3)]
    weights = spark.createDataFrame(w, "term string, doc_id long, w double")
    terms = spark.createDataFrame([(0, t, 1) for t in ("t0", "t1", "t2")], "qid int, term string, qtf long")
    assert sorted(r["doc_id"] for r in pruning.champion_candidates(weights, terms, 1).collect()) == [0, 1, 2]
    assert sorted(r["doc_id"] for r in pruning.elimination(weights, terms, 6, 0.0, 2).collect()) == [1, 2]
    assert sorted(r["doc_id"] for r in pruning.elimination(weights, terms, 6, 0.4, 2).collect()) == [1, 3]


def test_crawl():
    pages = {i: f"h{i % 3}" for i in range(7)}
    out = {0: [1, 2], 1: [3], 2: [4], 3: [5], 4: [6]}
    assert [p for _, _, p in crawl.crawl(pages, out, [0], 7, "bfs")] == [0, 1, 2, 3, 4, 5, 6]
    got = crawl.crawl(pages, out, [0], 7, "priority", {i: 1 for i in pages})
    assert sorted(p for *_, p in got) == list(range(7))
    last = {}
    for _, at, p in got:
        assert at - last.get(pages[p], -9) >= 1.0
        last[pages[p]] = at


def test_frontier_moves_pages_up_and_bounds_its_hosts():
    f = crawl.Frontier(3, hosts=2)
    for page in range(6):
        f.put(page, f"h{page}", 2)
    f.put(5, "h5", 0)
    f.put(5, "h5", 1)
    got = []
    while (turn := f.take()) is not None:
        got.append(turn[2])
        assert len(f.back) <= 2
    assert sorted(got) == list(range(6)) and got.index(5) < 3


def jaccard_sets(texts, k=4):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]))
    return out


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice((3, 20, 200, 300)))) for _ in range(25)]
    out = list(base)
    for _ in range(60):
        w = rng.choice(out).split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        out.append(" ".join(w))
    return [*out, "", None, base[0].upper()]


def test_shingle_pairs_and_content_seen_against_brute_force(spark, near_texts):
    sets = jaccard_sets(near_texts)
    df = spark.createDataFrame(list(enumerate(near_texts)), "doc_id long, text string")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    close = lambda x, y: bool(x | y) and len(x & y) >= 0.9 * len(x | y) - 1e-9
    want = {(i, j) for x, i in first.items() for y, j in first.items() if i < j and x and y and close(x, y)}
    got = {(r["a"], r["b"]): r["jaccard"] for r in crawl.shingle_pairs(df).collect()}
    assert set(got) == want and len(want) > 20
    assert all(v == pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for (a, b), v in got.items())
    kept, seen = [], {}
    for i, s in enumerate(sets):
        if near_texts[i] is None:
            seen[i] = None
            continue
        seen[i] = next((j for j in kept if sets[j] == s or close(sets[j], s)), None)
        if seen[i] is None:
            kept.append(i)
    assert {r["doc_id"]: r["seen"] for r in crawl.content_seen(df).collect()} == seen


def test_tiers_against_a_sort(spark, monkeypatch):
    monkeypatch.setattr(pruning, "ID_RANGE", 16)
    rng = random.Random(6)
    n = {i: rng.choice([0, 0, 0, 1, 2, 9]) for i in range(200)}
    docs = spark.createDataFrame([(i,) for i in n], "doc_id long")
    pop = spark.createDataFrame([(i, x) for i, x in n.items() if x], "doc_id long, n long")
    order = sorted(n, key=lambda i: (-n[i], i))
    want = {d: 0 if r <= 40 else 1 if r <= 100 else 2 for r, d in enumerate(order, 1)}
    assert {r["doc_id"]: r["tier"] for r in pruning.tiers(docs, pop).collect()} == want


def test_pool_and_query_files(spark, tmp_path):
    """Files of a pool, queries and provisions: zones, courts, scrubbed texts, both views, gold provisions apart."""
    schema = "id string, case_title string, date string, jurisdiction string, text array<string>, rhetorical_roles array<string>, relevant_statutes array<string>, relevant_statute_ids array<string>, relevant_precedents array<string>, relevant_precedent_ids array<string>"
    rows = [("P1", None, "2000-01-02", "Supreme Court of India", ["rain fell", "see AIR 1988 Bom 77", "was it wet", "so it was"], ["Facts", "Facts", "Issue", "Conclusion"], ["x"], ["S1", "S1"], [], ["P2", "P2"])]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([("S1", "Section 5 of the Limitation Act", ["late"])], "id string, provision_name string, text array<string>").write.parquet(str(tmp_path / "s"))
    pool = corpus.read_pool(spark, str(tmp_path / "q"))
    assert [tuple(r) for r in corpus.paragraphs(pool).select("para", "zone").collect()] == [(0, "facts"), (1, "facts"), (2, "issues"), (3, "decision")]
    assert (pool.first()["court"], pool.first()["title"], pool.first()["statute_ids"]) == ("SC", "", ["S1", "S1"])
    read = lambda **o: corpus.read_query_file(spark, str(tmp_path / "q"), "dev", **o).first()
    assert (read()["text"], read()["split"], read()["relevant"]) == ("rain fell see was it wet", "val", ["P2"])
    assert read(view="full")["text"].endswith("so it was") and "AIR" in read(scrub=False)["text"]
    assert "statute" not in " ".join(corpus.read_query_file(spark, str(tmp_path / "q"), "train").columns)
    assert corpus.read_statutes(spark, str(tmp_path / "s")).count() == 1
    assert [tuple(r) for r in corpus.read_gold_statutes(spark, str(tmp_path / "q")).collect()] == [("P1", "S1")]


def test_results_are_read_by_allowed_names(spark, tmp_path):
    corpus.write_results(spark.createDataFrame([(1, 0.5)], "qid long, ap double"), f"{tmp_path}/measures")
    assert corpus.read_results(spark, str(tmp_path), "measures", ("measures",)).first()["ap"] == 0.5
    with pytest.raises(KeyError):
        corpus.read_results(spark, str(tmp_path), "../measures", ("measures",))


def test_settings_are_checked():
    from quern.config import Config

    got = Config.checked({"k1": 2, "cutoffs": [1, 3], "weights": {"text": 0.5}})
    assert got.k1 == 2.0 and got.cutoffs == (1, 3) and got.weights == {"text": 0.5}
    for bad in ({"colour": 1}, {"k1": "2"}, {"seed": 1.5}, {"b": float("nan")}, {"weights": {"x": 1.0}}, {"seed": True}, {"rrf_k": -1}):
        with pytest.raises(ValueError):
            Config.checked(bad)


def test_trace_and_order(search):
    got = search.trace("(knife OR dowry) AND NOT hostile").orderBy("step").collect()
    assert [(r["node"], r["docs"]) for r in got] == [("knife", 2), ("dowry", 1), ("(knife OR dowry)", 3), ("hostile", 1), ("NOT hostile", 3), ("((knife OR dowry) AND NOT hostile)", 2)]
    costs = search.and_costs(["murder knife dowry"]).first()
    assert (costs["written"], costs["by_size"], costs["docs"]) == (3 + 2 + 2 + 1, 1 + 2 + 0 + 3, 0)


def test_title_leaks(spark):
    queries = spark.createDataFrame([(1, "as in Storm v. Harbour it rained"), (2, "the storm and the harbour"), (3, "nothing")], "qid long, text string")
    titles = spark.createDataFrame([(9, "Storm v. Harbour")], "doc_id long, title string")
    edges = spark.createDataFrame([(q, 9) for q in (1, 2, 3)], "src long, dst long")
    from quern.operators import profiling

    got = {r["qid"]: (r["exact"], r["parties"]) for r in profiling.title_leaks(queries, titles, edges).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, False)}


def test_frozen_and_regularised_weights(spark):
    rows = spark.createDataFrame([(q, d, float(d == 0), float(d == q % 4), 0.1 * d) for q in range(12) for d in range(4)], "qid long, doc_id long, text double, good double, bad double").persist()
    rel = spark.createDataFrame([(q, q % 4) for q in range(12)], "qid long, doc_id long")
    fold = rel.select("qid", (F.col("qid") % 3).cast("int").alias("fold"))
    trials = [{"text": 1.0, "good": 0.0}, {"text": 0.3, "good": 0.7}]
    got = tuning.frozen(tuning.search(rows, rel, trials, fold), trials)
    assert got["weights"] == trials[1] and got["map"] == got["nested_map"] == 1.0 and len(got["fold_map"]) == 3
    weights, sweeps = tuning.regularised(rows, rel, "text", ["good", "bad"], fold, grid=(0.0, 0.4, 2.0), sweeps=2)
    assert weights["text"] == 1.0 and weights["good"] == 2.0 and sweeps >= 1


def test_sessions(spark):
    ev = [(1, "a", f"2024-01-01 00:00:{s:02d}") for s in (0, 10, 59)] + [(2, "a", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(ev, "id int, user string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sessions.sliding_counts(df, "user", "ts", 60, 2).orderBy("ts").collect()
    assert [r["in_window"] for r in got] == [1, 2, 3, 1] and [r["allowed"] for r in got] == [True, True, False, True]


def test_provisions(spark):
    prov = spark.createDataFrame([("p1", "Section 302 of the Indian Penal Code", ["x"]), ("p2", "Article 21 of the Constitution", ["y"])], "id string, provision_name string, text array<string>")
    docs = spark.createDataFrame([(1, "tried u/s 302 IPC", ["p2"]), (2, "nothing", [])], "doc_id long, text string, statute_ids array<string>")
    held = statutes.document_provisions(docs, prov)
    assert sorted((r["doc_id"], r["id"]) for r in held.collect()) == [(1, "p1"), (1, "p2")]
    assert statutes.coverage(docs, held).first()["with_provision"] == 1
    texts = statutes.pseudo_documents(prov, held, docs.select("doc_id", "text"))
    assert sorted((r["id"], r["text"]) for r in texts.collect())[0:2] == [("p1", "Section 302 of the Indian Penal Code x"), ("p1", "tried u/s 302 IPC")]


def test_coordinate_ascent(spark):
    rows = spark.createDataFrame([(q, d, float(d == q), float(d)) for q in range(3) for d in range(4)], "qid long, doc_id long, good double, bad double")
    rel = spark.createDataFrame([(q, q) for q in range(3)], "qid long, doc_id long")
    weights, best = tuning.coordinate_ascent(rows, rel, ["good", "bad"], rounds=3)
    assert best == pytest.approx(1.0) and weights["good"] > weights["bad"]


def test_index_round_trip(spark, tmp_path, search):
    index.write(str(tmp_path), search.tokens, search.docs)
    back = index.read(spark, str(tmp_path))
    assert sorted(map(tuple, back["postings"].select("zone", "term", "doc_id", "tf").collect())) == sorted(map(tuple, search.postings.select("zone", "term", "doc_id", "tf").collect()))


def test_streaming_new_content(spark, tmp_path):
    from quern import streaming

    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "f g h i j")], "doc_id long, text string").withColumn("ts", F.current_timestamp())
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = streaming.new_content(stream).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["doc_id"] for r in spark.table("fresh").collect()) == [1, 3]


def test_queries_run_without_the_llm_folder():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_seams():
    from quern.functions import statutes as names
    from quern.plans import protocols

    assert isinstance(scoring.bm25, protocols.Ranker) and isinstance(names.extract, protocols.StatuteNormalizer)


def test_statute_channel(spark):
    scores = spark.createDataFrame([(1, "p1", 3.0), (1, "p2", 1.0), (1, "p3", 0.0)], "qid long, doc_id string, score double")
    pred = statutes.predicted(scores, 2)
    assert {r["doc_id"]: r["weight"] for r in pred.collect()} == {"p1": 0.75, "p2": 0.25}
    held = spark.createDataFrame([(7, "p1"), (8, "p2"), (9, "p1"), (9, "p2")], "doc_id long, id string")
    idf = spark.createDataFrame([("p1", 1.0), ("p2", 2.0)], "id string, idf double")
    got = {r["doc_id"]: r["channel"] for r in statutes.channel(pred, held, idf).collect()}
    assert got == {7: pytest.approx(0.375), 8: pytest.approx(0.25), 9: pytest.approx(0.625)}
    gold = spark.createDataFrame([(1, "p1"), (1, "p9")], "qid long, id string")
    assert statutes.recall(pred, gold).first()["recall"] == 0.5
