"""DuckDB SQL with the rows of the queries of the same names, written independently of them."""

from __future__ import annotations

from quern.functions.analysis import ENGLISH_STOP, LEGAL_STOP
from quern.queries import LADDER, MISSPELT, NAMES, PAIR_ZONES, TRIALS, VIEWS
from quern.sources.corpus import ZONES

_Q = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
STOP = _Q((*ENGLISH_STOP, *LEGAL_STOP))
ZONE_LIST = "[" + ", ".join(f"'{z}'" for z in ZONES) + "]"
KEPT = f"length(term) BETWEEN 2 AND 40 AND term NOT IN {STOP}"

#: Tables that queries share; each statement uses those it needs.
PRE = f"""WITH RECURSIVE docs AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'SC' WHEN 'fr' THEN 'HC' WHEN 'de' THEN 'HC' WHEN 'es' THEN 'OTHER' END AS court,
    CASE WHEN doc_id % 8 <> 0 THEN DATE '2000-01-01' + CAST(doc_id * 37 % 7300 AS INTEGER) END AS date FROM documents),
nd AS (SELECT count(*) AS n FROM documents),
paras AS (
  SELECT doc_id, i - 1 AS para, {ZONE_LIST}[(i - 1) % 8 + 1] AS zone, ls[i] AS line
  FROM (SELECT doc_id, str_split(text, chr(10)) AS ls FROM documents), UNNEST(range(1, len(ls) + 1)) AS t(i)),
words AS (
  SELECT doc_id, para, zone, j, ws[j] AS term
  FROM (SELECT doc_id, para, zone, regexp_extract_all(lower(line), '[a-z0-9]+') AS ws FROM paras), UNNEST(range(1, len(ws) + 1)) AS t(j)),
tok AS (
  SELECT doc_id, zone, CAST(row_number() OVER (PARTITION BY doc_id, zone ORDER BY para, j) - 1 AS INTEGER) AS pos, term FROM words WHERE {KEPT}),
post AS (
  SELECT zone, term, doc_id, count(*) AS tf FROM tok GROUP BY ALL
  UNION ALL SELECT 'all', term, doc_id, count(*) FROM tok GROUP BY ALL
  UNION ALL SELECT 'fi', term, doc_id, count(*) FROM tok WHERE zone IN ('facts', 'issues') GROUP BY ALL),
alls AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
adf AS (SELECT term, count(*) AS df FROM alls GROUP BY term),
qt AS (
  SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) WHERE {KEPT} GROUP BY ALL),
dnorm AS (SELECT doc_id, sqrt(sum((1 + log10(tf)) ** 2)) AS norm FROM alls GROUP BY doc_id),
dw AS (SELECT term, doc_id, (1 + log10(tf)) / norm AS w FROM alls JOIN dnorm USING (doc_id)),
qraw AS (SELECT qid, term, (1 + log10(qtf)) * log10(n / df) AS w FROM qt JOIN adf USING (term), nd),
qw AS (SELECT qid, term, CASE WHEN sum(w * w) OVER (PARTITION BY qid) > 0 THEN w / sqrt(sum(w * w) OVER (PARTITION BY qid)) ELSE 0 END AS w FROM qraw),
tfidf AS (SELECT qid, doc_id, round(sum(qw.w * dw.w), 6) AS score FROM qw JOIN dw USING (term) GROUP BY ALL),
tfidf_r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM tfidf),
dlen AS (SELECT doc_id, sum(tf) AS len FROM alls GROUP BY doc_id),
avgl AS (SELECT sum(tf) / any_value(n) AS mean FROM alls, nd),
bm AS (
  SELECT qid, doc_id, qtf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, tf, len, mean
  FROM qt JOIN adf USING (term) JOIN alls USING (term) JOIN dlen USING (doc_id), nd, avgl),
bm25 AS (SELECT qid, doc_id, round(sum(idf * qtf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM bm GROUP BY ALL),
bm25_r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm25),
edges AS (
  SELECT DISTINCT l_orderkey % n AS src, l_partkey % n AS dst FROM lineitem, nd
  WHERE l_orderkey % n <> l_partkey % n AND (l_partkey % n) % 5 <> 0),
pop AS (SELECT dst AS doc_id, count(*) AS n FROM edges GROUP BY dst),
dq AS (
  SELECT doc_id AS qid, CASE (doc_id // 5) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, date FROM docs WHERE doc_id % 5 = 0),
dqt AS (SELECT doc_id AS qid, term, count(*) AS qtf FROM tok WHERE doc_id % 5 = 0 AND zone IN ('facts', 'issues') GROUP BY ALL),
"""

# ---- features of documents as queries
FEATURES = """
npool AS (SELECT count(*) AS n FROM documents WHERE doc_id % 5 <> 0),
pp AS (SELECT * FROM alls WHERE doc_id % 5 <> 0),
pdf AS (SELECT term, count(*) AS df FROM pp GROUP BY term),
pnorm AS (SELECT doc_id, sqrt(sum((1 + log10(tf)) ** 2)) AS norm FROM pp GROUP BY doc_id),
pq0 AS (SELECT qid, term, (1 + log10(qtf)) * log10(n / df) AS w FROM dqt JOIN pdf USING (term), npool),
pqn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM pq0 GROUP BY qid),
ptext AS (
  SELECT qid, doc_id, round(sum(CASE WHEN pqn.norm > 0 THEN pq0.w / pqn.norm ELSE 0 END * (1 + log10(tf)) / pnorm.norm), 6) AS text
  FROM pq0 JOIN pqn USING (qid) JOIN pp USING (term) JOIN pnorm USING (doc_id) GROUP BY qid, doc_id),
ptop AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY text DESC, doc_id) AS r FROM ptext QUALIFY r <= 1000),
tt AS (SELECT * FROM dqt WHERE qid IN (SELECT qid FROM dq WHERE split = 'train')),
nt AS (SELECT count(*) AS n FROM dq WHERE split = 'train'),
tdf AS (SELECT term, count(*) AS df FROM tt GROUP BY term),
tnorm AS (SELECT qid, sqrt(sum((1 + log10(qtf)) ** 2)) AS norm FROM tt GROUP BY qid),
nq0 AS (SELECT qid, term, (1 + log10(qtf)) * log10(n / df) AS w FROM dqt JOIN tdf USING (term), nt WHERE df < n),
nqn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM nq0 GROUP BY qid),
sims AS (
  SELECT * FROM (SELECT a.qid, t.qid AS neighbour, round(sum(a.w / nqn.norm * (1 + log10(t.qtf)) / tnorm.norm), 9) AS sim
    FROM nq0 a JOIN nqn ON nqn.qid = a.qid JOIN tt t ON t.term = a.term AND t.qid <> a.qid JOIN tnorm ON tnorm.qid = t.qid GROUP BY ALL) WHERE sim > 0),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, neighbour) AS INTEGER) AS rank FROM sims),
vote AS (SELECT n.qid, e.dst AS doc_id, sum(n.sim ** 4) AS neighbour FROM near n JOIN edges e ON e.src = n.neighbour WHERE n.rank <= 20 GROUP BY ALL),
vtop AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(neighbour, 6) DESC, doc_id) AS r FROM vote WHERE qid <> doc_id),
cand AS (SELECT qid, doc_id FROM ptop WHERE qid <> doc_id AND r <= 20 UNION SELECT qid, doc_id FROM vtop WHERE r <= 5),
erel AS (SELECT src AS qid, count(*) AS n_rel FROM edges WHERE src % 5 = 0 GROUP BY src),
src AS (SELECT e.* FROM edges e LEFT JOIN dq ON dq.qid = e.src WHERE dq.split IS NULL OR dq.split = 'train'),
base AS (SELECT dst AS doc_id, count(*) AS n FROM src GROUP BY dst),
feat AS (
  SELECT c.qid, c.doc_id, c.text, coalesce(v.neighbour, 0) AS neighbour,
    ln(1 + coalesce(b.n, 0) - CASE WHEN s.src IS NULL THEN 0 ELSE 1 END) AS authority
  FROM ptop c LEFT JOIN vote v ON v.qid = c.qid AND v.doc_id = c.doc_id
  LEFT JOIN base b ON b.doc_id = c.doc_id LEFT JOIN src s ON s.src = c.qid AND s.dst = c.doc_id),
lim AS (
  SELECT qid, min(text) AS t0, max(text) AS t1, min(neighbour) AS n0, max(neighbour) AS n1, min(authority) AS a0, max(authority) AS a1 FROM feat GROUP BY qid),
scal AS (
  SELECT f.qid, f.doc_id, CASE WHEN t1 > t0 THEN (text - t0) / (t1 - t0) ELSE 0 END AS text,
    CASE WHEN n1 > n0 THEN (neighbour - n0) / (n1 - n0) ELSE 0 END AS neighbour,
    CASE WHEN a1 > a0 THEN (authority - a0) / (a1 - a0) ELSE 0 END AS authority
  FROM feat f JOIN lim USING (qid)),
nets AS (SELECT *, text * 0.35444 + neighbour * 0.48788 + authority * 0.15768 AS net FROM scal),
"""

#: Documents that share eight words in a row with an item, and their places in the tf-idf ranking.
RELEVANCE = r"""
dwords AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
iwords AS (SELECT item_id AS qid, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS s FROM dwords, UNNEST(range(1, len(w) - 6)) AS t(i)),
ish AS (SELECT DISTINCT qid, array_to_string(w[i:i + 7], ' ') AS s FROM iwords, UNNEST(range(1, len(w) - 6)) AS t(i)),
rel AS (SELECT DISTINCT qid, doc_id FROM ish JOIN dsh USING (s)),
nrel AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY qid),
jud AS (
  SELECT r.qid, x.rank, CASE WHEN x.rank IS NOT NULL THEN row_number() OVER (PARTITION BY r.qid ORDER BY x.rank NULLS LAST) END AS hit, n_rel
  FROM rel r JOIN nrel USING (qid) LEFT JOIN (SELECT * FROM tfidf_r WHERE rank <= 100) x ON x.qid = r.qid AND x.doc_id = r.doc_id),
"""
_CUTS = (1, 5, 10, 20)
_HITS = lambda k: f"sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END)"
_REL = "any_value(n_rel)"
_IDEAL = lambda k: f"list_sum(list_transform(range(1, least({_REL}, {k}) + 1), lambda i: 1 / log2(i + 1)))"
MEASURES = ", ".join(
    f"{_HITS(k)} / {k} AS p{k}, {_HITS(k)} / {_REL} AS r{k}, CASE WHEN {_HITS(k)} > 0 THEN 2.0 * {_HITS(k)} / ({k} + {_REL}) ELSE 0 END AS f{k}, "
    f"sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) / {_IDEAL(k)} AS ndcg{k}"
    for k in _CUTS
)
MEASURES += f", sum(coalesce(hit / rank, 0)) / {_REL} AS ap, coalesce(1 / min(rank), 0) AS rr"
_NAMES = [f"{m}{k}" for k in _CUTS for m in ("p", "r", "f", "ndcg")] + ["ap", "rr"]

_VBYTE = lambda v: "(1 + " + " + ".join(f"CASE WHEN {v} >= {1 << (7 * k)} THEN 1 ELSE 0 END" for k in range(1, 9)) + ")"
_HAS = lambda t, zone="all": f"SELECT DISTINCT doc_id FROM post WHERE zone = '{zone}' AND term = '{t}'"
_PAIRS = lambda a, b, gap: f"SELECT DISTINCT x.doc_id FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND x.zone = y.zone AND {gap} WHERE x.zone IN ('facts', 'issues') AND x.term = '{a}' AND y.term = '{b}'"


def _sql(body: str, *parts: str) -> str:
    """The shared tables and ``body``."""
    return (PRE + "".join(parts)).rstrip().rstrip(",") + "\n" + body


_QTF = {"raw": "qtf", "binary": "1.0", "saturated": "qtf * 2.2 / (qtf + 1.2)"}
_GRAMS = "list_distinct(list_transform(range(1, length(w) + 1), lambda i: substr('$' || w || '$', i, 3)))"
_MISSPELT = ", ".join(f"('{w}')" for w in MISSPELT)
_SIMILAR = f"""
asked AS (SELECT w AS word, {_GRAMS} AS g FROM (VALUES {_MISSPELT}) AS v(w)),
vocab AS (SELECT w AS term, {_GRAMS} AS g FROM (SELECT term AS w FROM adf)),
simil AS (
  SELECT word, term, len(list_intersect(a.g, v.g)) / (len(a.g) + len(v.g) - len(list_intersect(a.g, v.g))) AS jaccard FROM asked a, vocab v),
"""
_VIEWS = """
npool AS (SELECT count(*) AS n FROM documents WHERE doc_id % 5 <> 0),
zp AS (SELECT * FROM post WHERE doc_id % 5 <> 0 AND zone IN ('facts', 'issues', 'decision', 'all')),
zdf AS (SELECT zone, term, count(*) AS df FROM zp GROUP BY ALL),
znorm AS (SELECT zone, doc_id, sqrt(sum((1 + log10(tf)) ** 2)) AS norm FROM zp GROUP BY ALL),
vt AS (
  SELECT doc_id AS qid, zone AS view, term, count(*) AS qtf FROM tok WHERE doc_id % 5 = 0 AND zone IN ('facts', 'issues') GROUP BY ALL
  UNION ALL SELECT doc_id, 'fi', term, count(*) FROM tok WHERE doc_id % 5 = 0 AND zone IN ('facts', 'issues') GROUP BY ALL),
vw AS (SELECT qid, view, zone, term, (1 + log10(qtf)) * log10(n / df) AS w FROM vt JOIN zdf USING (term), npool),
vn AS (SELECT qid, view, zone, sqrt(sum(w * w)) AS norm FROM vw GROUP BY ALL),
zpair AS (
  SELECT vw.qid, vw.view, vw.zone, zp.doc_id, sum(CASE WHEN vn.norm > 0 THEN vw.w / vn.norm ELSE 0 END * (1 + log10(tf)) / znorm.norm) AS score
  FROM vw JOIN vn USING (qid, view, zone) JOIN zp ON zp.zone = vw.zone AND zp.term = vw.term JOIN znorm ON znorm.zone = zp.zone AND znorm.doc_id = zp.doc_id
  GROUP BY ALL),
"""
_LEADERS = """
lead AS (SELECT doc_id FROM docs, nd WHERE doc_id % greatest(1, CAST(round(sqrt(n)) AS BIGINT)) = 0),
fsim AS (
  SELECT d.doc_id, l.doc_id AS leader, round(sum(d.w * l.w), 9) AS sim FROM dw d JOIN dw l ON l.term = d.term WHERE l.doc_id IN (SELECT doc_id FROM lead) GROUP BY ALL),
fol AS (
  SELECT doc_id, coalesce(leader, (SELECT min(doc_id) FROM lead)) AS leader FROM (SELECT DISTINCT doc_id FROM dw)
  LEFT JOIN (SELECT doc_id, leader FROM fsim QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, leader) = 1) USING (doc_id)),
qsim AS (
  SELECT * FROM (SELECT q.qid, l.doc_id AS leader, round(sum(q.w * l.w), 9) AS sim FROM qw q JOIN dw l ON l.term = q.term WHERE l.doc_id IN (SELECT doc_id FROM lead) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, leader) <= 2),
"""
#: The code of a letter; h and w don't part equal codes, what is no letter does.
_SOUNDS = "CASE WHEN {0} IN ('b', 'f', 'p', 'v') THEN '1' WHEN {0} IN ('c', 'g', 'j', 'k', 'q', 's', 'x', 'z') THEN '2' WHEN {0} IN ('d', 't') THEN '3' WHEN {0} = 'l' THEN '4' WHEN {0} IN ('m', 'n') THEN '5' WHEN {0} = 'r' THEN '6' WHEN {0} IN ('h', 'w') THEN '7' ELSE '0' END"
_SYSTEMS = """
spop AS (SELECT dst AS doc_id, count(*) AS n FROM edges WHERE src % 5 <> 0 GROUP BY dst),
plen AS (SELECT doc_id, sum(tf) AS len FROM pp GROUP BY doc_id),
pavg AS (SELECT sum(tf) / any_value(n) AS mean FROM pp, npool),
pbm AS (
  SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qtf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM dqt JOIN pdf USING (term) JOIN pp USING (term) JOIN plen USING (doc_id), npool, pavg GROUP BY ALL),
sysr AS (
  SELECT 'random' AS system, qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(('0x' || substr(md5('13/' || qid || '/' || doc_id), 1, 13))::BIGINT / 4503599627370496, 9) DESC, doc_id) AS INTEGER) AS rank FROM ptop
  UNION ALL SELECT 'popularity', qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY coalesce(n, 0) DESC, doc_id) AS INTEGER) FROM ptop LEFT JOIN spop USING (doc_id)
  UNION ALL SELECT 'tfidf', qid, doc_id, CAST(r AS INTEGER) FROM ptop
  UNION ALL SELECT * FROM (SELECT 'bm25', qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS r FROM pbm) WHERE r <= 1000
  UNION ALL SELECT 'net', qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(net, 6) DESC, round(text, 6) DESC, doc_id) AS INTEGER) FROM nets
  UNION ALL SELECT 'net_dated', qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN coalesce(d.date >= dq.date, false) THEN 1 ELSE 0 END, round(net, 6) DESC, round(text, 6) DESC, doc_id) AS INTEGER)
    FROM nets JOIN dq USING (qid) JOIN docs d USING (doc_id)),
"""
_TRIED = f"""
trel AS (SELECT e.qid, n_rel, CAST(floor(('0x' || substr(md5('fold/' || e.qid), 1, 13))::BIGINT / 4503599627370496 * 5) AS INTEGER) AS fold FROM erel e JOIN dq ON dq.qid = e.qid WHERE dq.split = 'train'),
trials(trial, w1, w2, w3) AS (VALUES {", ".join(f"({i}, " + ", ".join(f"{t[n]!r}::DOUBLE" for n in NAMES) + ")" for i, t in enumerate(TRIALS))}),
trank AS (
  SELECT trial, qid, doc_id, row_number() OVER (PARTITION BY trial, qid ORDER BY round(text * w1 + neighbour * w2 + authority * w3, 9) DESC, doc_id) AS rank FROM scal JOIN trel USING (qid), trials),
tap AS (
  SELECT trial, qid, sum(i / rank) AS s FROM (SELECT t.trial, t.qid, t.rank, row_number() OVER (PARTITION BY t.trial, t.qid ORDER BY t.rank) AS i FROM trank t JOIN edges e ON e.src = t.qid AND e.dst = t.doc_id) GROUP BY ALL),
tried AS (
  SELECT CAST(trials.trial AS INTEGER) AS trial, fold, avg(coalesce(s / n_rel, 0)) AS map, count(*) AS n FROM trel, trials LEFT JOIN tap ON tap.trial = trials.trial AND tap.qid = trel.qid GROUP BY trials.trial, fold),
"""
#: References that stand after a document's text, by the way they are written.
_PLANTED = """CASE doc_id % 3 WHEN 0 THEN ['IPC_' || (doc_id % 60 + 100), 'IPC_' || (doc_id % 60 + 107)]
  WHEN 1 THEN ['CRPC_' || (doc_id % 60 + 100), 'IPC_' || (doc_id % 60 + 107), 'IPC_34'] ELSE ['CONST_ART_' || (doc_id % 60 + 100), 'COASTAL_BOATS_ACT_' || (doc_id % 60 + 107)] END"""
_HELD = f"""
prov AS (SELECT CAST(s_suppkey AS BIGINT) AS id, 'IPC_' || (s_suppkey + 99) AS token, text FROM supplier JOIN documents ON doc_id = s_suppkey),
held AS (
  SELECT doc_id, doc_id % 50 + 1 AS id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 50 + 1 IN (SELECT id FROM prov)
  UNION SELECT doc_id, id FROM (SELECT doc_id, unnest({_PLANTED}) AS token FROM documents) JOIN prov USING (token)),
pidf AS (SELECT id, ln((n + 1) / (count(DISTINCT doc_id) + 1)) AS idf FROM held, nd GROUP BY id, n),
ptok AS (SELECT id, term, count(*) AS tf FROM (
  SELECT id, unnest(regexp_extract_all(lower('section ' || (id + 99) || ' of the indian penal code, 1860 ' || text), '[a-z0-9]+')) AS term FROM prov) GROUP BY ALL),
ptk AS (SELECT id, term, tf FROM ptok WHERE {KEPT} AND term <> 'section' AND NOT (term = CAST(id + 99 AS VARCHAR) AND tf = 1) UNION ALL SELECT id, 's.' || (id + 99), 1 FROM prov),
pdl AS (SELECT id, sum(tf) AS len FROM ptk GROUP BY id),
pdfr AS (SELECT term, count(*) AS df FROM ptk GROUP BY term),
pnn AS (SELECT count(*) AS n FROM prov), pmean AS (SELECT sum(tf) / any_value(n) AS mean FROM ptk, pnn),
pscore AS (
  SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qtf * 2.2 / (qtf + 1.2) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM qt JOIN pdfr USING (term) JOIN ptk USING (term) JOIN pdl USING (id), pnn, pmean GROUP BY ALL),
ppred AS (
  SELECT qid, id, score / sum(score) OVER (PARTITION BY qid) AS weight, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM pscore WHERE score > 0 QUALIFY rank <= 10)),
"""
_CHAMPIONS = "champ AS (SELECT term, doc_id FROM dw QUALIFY row_number() OVER (PARTITION BY term ORDER BY round(w, 9) DESC, doc_id) <= 10),\n"
_TIERS = """
tier AS (
  SELECT doc_id, CASE WHEN r <= ceil(0.2 * n) THEN 0 WHEN r <= ceil(0.5 * n) THEN 1 ELSE 2 END AS tier
  FROM (SELECT doc_id, row_number() OVER (ORDER BY coalesce(pop.n, 0) DESC, doc_id) AS r FROM docs LEFT JOIN pop USING (doc_id)), nd),
"""
_SHINGLES = r"""
sh AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)),
"""
_URL = """
parts AS (
  SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
    regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages),
canon AS (
  SELECT page_id, host, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS canonical
  FROM (SELECT *, list_filter(str_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|sessionid|sid|fbclid|gclid)(=|$)')) AS kept FROM parts)),
"""

ORACLES = {
    "tokens_per_zone": _sql("SELECT zone, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM tok GROUP BY zone"),
    "term_positions": _sql("SELECT doc_id, zone, pos, term FROM tok WHERE zone = 'issues'"),
    "postings_of_zone": _sql("SELECT term, doc_id, tf FROM post WHERE zone = 'fi'"),
    "term_df": _sql("SELECT zone, term, count(*) AS df FROM post GROUP BY ALL"),
    "doc_len": _sql("SELECT z.zone, d.doc_id, coalesce(l.len, 0)::BIGINT AS len FROM docs d, (SELECT DISTINCT zone FROM post) z LEFT JOIN (SELECT zone, doc_id, sum(tf) AS len FROM post GROUP BY ALL) l ON l.zone = z.zone AND l.doc_id = d.doc_id"),
    "vbyte_sizes": _sql(
        f"""SELECT zone, count(*) AS terms, sum(df)::BIGINT AS postings, sum(tokens)::BIGINT AS tokens, sum(8 * df + 4)::BIGINT AS raw_bytes, sum(bytes + {_VBYTE("df")})::BIGINT AS vbyte_bytes
        FROM (SELECT zone, term, count(*) AS df, sum(tf) AS tokens, sum({_VBYTE("gap")} + {_VBYTE("tf")}) AS bytes
          FROM (SELECT *, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY zone, term ORDER BY doc_id), 0) AS gap FROM post) GROUP BY zone, term) GROUP BY zone"""
    ),
    "postings_preview": _sql(
        """SELECT zone, doc_id, tf, df, round(log10(n / df), 6) AS idf
        FROM (SELECT *, count(*) OVER (PARTITION BY zone) AS df, row_number() OVER (PARTITION BY zone ORDER BY doc_id) AS i FROM post WHERE term = 'und'), nd WHERE i <= 500"""
    ),
    "bool_and": _sql(f"{_HAS('und')} INTERSECT {_HAS('die')}"),
    "bool_or": _sql(f"{_HAS('und')} UNION {_HAS('que')}"),
    "bool_not": _sql(f"SELECT doc_id FROM docs EXCEPT {_HAS('und')}"),
    "bool_mixed": _sql(f"SELECT doc_id FROM docs WHERE court = 'HC' AND (doc_id IN ({_HAS('und')}) OR doc_id IN ({_HAS('que')})) AND doc_id NOT IN ({_HAS('die')})"),
    "bool_stop_word": _sql(_HAS("und")),
    "bool_zone": _sql(_HAS("und", "decision")),
    "phrase": _sql(_PAIRS("ist", "die", "y.pos = x.pos + 1")),
    "phrase_in_zone": _sql(_PAIRS("de", "la", "y.pos = x.pos + 1") + " AND x.zone = 'facts'"),
    "phrase_without_positions": _sql(f"{_HAS('de', 'decision')} INTERSECT {_HAS('la', 'decision')}"),
    "prox_unordered": _sql(_PAIRS("und", "die", "abs(x.pos - y.pos) BETWEEN 1 AND 3")),
    "prox_ordered": _sql(_PAIRS("und", "die", "y.pos - x.pos BETWEEN 1 AND 2")),
    "wildcard_search": _sql("SELECT DISTINCT doc_id FROM alls WHERE starts_with(term, 'thnd')"),
    "filter_year": _sql("SELECT doc_id FROM docs WHERE year(date) BETWEEN 2005 AND 2010"),
    "filter_year_open": _sql(f"SELECT doc_id FROM docs WHERE year(date) >= 2012 AND doc_id IN ({_HAS('und')})"),
    "filter_dates": _sql("SELECT doc_id FROM docs WHERE date > DATE '2003-01-01' AND date < DATE '2009-06-30'"),
    "filter_court": _sql("SELECT doc_id FROM docs WHERE court = 'SC'"),
    "bool_rank": _sql(
        f"""SELECT doc_id, round(coalesce(score, 0), 4) AS score FROM (({_HAS("und")} INTERSECT {_HAS("die")}) UNION {_HAS("que")})
        LEFT JOIN (SELECT doc_id, sum((1 + log10(tf)) * log10(n / df)) AS score FROM alls JOIN adf USING (term), nd WHERE term IN ('und', 'die', 'que') GROUP BY doc_id) USING (doc_id)
        ORDER BY score DESC, doc_id LIMIT 50"""
    ),
    "wildcard_terms": _sql("SELECT term FROM adf WHERE starts_with(term, 'th') AND ends_with(term, 'ing') AND length(term) >= 5 ORDER BY term LIMIT 500"),
    "similar_terms": _sql("SELECT word, term, round(jaccard, 6) AS jaccard FROM simil WHERE jaccard >= 0.2", _SIMILAR),
    "spelling": _sql(
        """SELECT word, term, distance, df, CAST(row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) AS INTEGER) AS rank
        FROM (SELECT word, term, CAST(levenshtein(word, term) AS INTEGER) AS distance, df FROM simil JOIN adf USING (term) WHERE jaccard >= 0.2 AND word NOT IN (SELECT term FROM adf))
        WHERE distance <= 2 QUALIFY rank <= 5""",
        _SIMILAR,
    ),
    "edit_distances": _sql("SELECT term, CAST(least(levenshtein(term, 'thing'), 5) AS INTEGER) AS distance FROM adf"),
    "soundex_groups": _sql(
        f"""SELECT code, count(*) AS n FROM (
          SELECT CASE WHEN regexp_matches(term, '^[a-z]') THEN upper(substr(term, 1, 1)) || rpad(substr(list_reduce(list_prepend({{'last': {_SOUNDS.format("substr(term, 1, 1)")}, 'out': ''}}, list_transform(range(2, length(term) + 1), lambda i: {{'last': {_SOUNDS.format("substr(term, i, 1)")}, 'out': ''}})),
            lambda a, x: {{'last': CASE WHEN x['last'] = '7' THEN a['last'] ELSE x['last'] END, 'out': a['out'] || CASE WHEN x['last'] IN ('0', '7') OR x['last'] = a['last'] THEN '' ELSE x['last'] END}})['out'], 1, 3), 3, '0') ELSE term END AS code FROM adf WHERE regexp_matches(term, '^[a-z]{{3,}}$')) GROUP BY code"""
    ),
    "random_baseline": _sql(
        """SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank
        FROM (SELECT item_id AS qid, doc_id, round(('0x' || substr(md5('13/' || item_id || '/' || doc_id), 1, 13))::BIGINT / 4503599627370496, 9) AS score FROM benchmark, documents) QUALIFY rank <= 5"""
    ),
    "tfidf_top10": _sql("SELECT qid, doc_id, score, rank FROM tfidf_r WHERE rank <= 10"),
    **{
        f"bm25_top10_{kind}": _sql(
            f"""SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank
            FROM (SELECT qid, doc_id, round(sum(idf * {f} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM bm GROUP BY ALL) QUALIFY rank <= 10"""
        )
        for kind, f in _QTF.items()
    },
    "zonepair_features": _sql("SELECT view, zone, count(*) FILTER (score > 0) AS pairs, round(sum(score), 3) AS total, round(max(score), 6) AS most FROM zpair GROUP BY ALL", _VIEWS),
    "zonepair_score": _sql(
        """SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank
        FROM (SELECT qid, doc_id, round(sum(CASE WHEN view = 'facts' AND zone = 'facts' THEN score * 0.25 WHEN view = 'issues' AND zone = 'issues' THEN score * 0.25 WHEN view = 'fi' AND zone = 'all' THEN score * 0.5 ELSE 0 END), 6) AS score FROM zpair GROUP BY ALL)
        QUALIFY rank <= 10""",
        _VIEWS,
    ),
    "stage_features": _sql(
        "SELECT p.qid, p.doc_id, " + ", ".join(f"round(coalesce(max(CASE WHEN view = '{v}' AND zone = '{z}' THEN score END), 0), 6) AS {v}_{z}" for v in VIEWS for z in PAIR_ZONES)
        + " FROM ptop p JOIN zpair z ON z.qid = p.qid AND z.doc_id = p.doc_id WHERE p.r <= 10 GROUP BY ALL",
        FEATURES,
        _VIEWS.replace("npool AS (SELECT count(*) AS n FROM documents WHERE doc_id % 5 <> 0),", ""),
    ),
    "efficiency_study": _sql(
        """SELECT method, postings, docs, round(map, 6) AS map FROM (
          SELECT method, count(*) AS postings, count(DISTINCT (qid, doc_id)) AS docs FROM qt JOIN alls USING (term) JOIN cands USING (qid, doc_id) GROUP BY method) JOIN (
          SELECT method, avg(ap) AS map FROM (SELECT method, qid, sum(coalesce(hit / rank, 0)) / any_value(n_rel) AS ap FROM (
            SELECT m.method, r.qid, x.rank, n_rel, CASE WHEN x.rank IS NOT NULL THEN row_number() OVER (PARTITION BY m.method, r.qid ORDER BY x.rank NULLS LAST) END AS hit
            FROM rel r JOIN nrel USING (qid), (SELECT DISTINCT method FROM cands) m LEFT JOIN kept x ON x.method = m.method AND x.qid = r.qid AND x.doc_id = r.doc_id) GROUP BY ALL) GROUP BY method) USING (method)""",
        RELEVANCE,
        _CHAMPIONS,
        _LEADERS,
        """cands AS (
  SELECT 'none' AS method, qid, doc_id FROM tfidf UNION ALL SELECT 'champion', * FROM (SELECT DISTINCT qid, champ.doc_id FROM qt JOIN champ USING (term))
  UNION ALL SELECT 'cluster', qid, fol.doc_id FROM qsim JOIN fol USING (leader)
  UNION ALL SELECT 'elimination', qid, doc_id FROM (SELECT qid, term, keep, sum(keep) OVER (PARTITION BY qid) AS k FROM (SELECT qid, term, CASE WHEN round(log10(n / df), 9) >= 1 THEN 1 ELSE 0 END AS keep FROM qt JOIN adf USING (term), nd)) JOIN alls USING (term)
    WHERE keep = 1 OR k = 0 GROUP BY qid, doc_id HAVING count(*) >= CASE WHEN any_value(k) = 0 THEN 1 ELSE least(2, any_value(k)) END),
kept AS (SELECT method, qid, doc_id, row_number() OVER (PARTITION BY method, qid ORDER BY score DESC, doc_id) AS rank FROM tfidf JOIN cands USING (qid, doc_id) QUALIFY rank <= 100),""",
    ),
    "popularity": _sql("SELECT doc_id, n FROM pop"),
    "demonstration_ranker": _sql(
        """SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank
        FROM (SELECT qid, doc_id, round(0.7 * hits / max(hits) OVER (PARTITION BY qid), 6) AS score FROM (SELECT qid, doc_id, sum(tf) AS hits FROM qt JOIN alls USING (term) GROUP BY ALL)) QUALIFY rank <= 5"""
    ),
    "neighbours_topk": _sql("SELECT qid, neighbour, round(sim, 6) AS sim, rank FROM near WHERE rank <= 5", FEATURES),
    "neighbour_reasons": _sql("SELECT n.qid, e.dst AS doc_id, CAST(count(*) AS INTEGER) AS n, string_agg(n.neighbour, ',' ORDER BY n.sim DESC, n.neighbour) AS neighbours FROM near n JOIN edges e ON e.src = n.neighbour WHERE n.rank <= 20 GROUP BY ALL", FEATURES),
    "union_recall": _sql(
        """SELECT CAST(s AS INTEGER) AS size, round(avg(coalesce(hits, 0) / n_rel), 6) AS recall, round(avg(coalesce(n, 0)), 6) AS mean_size
        FROM (SELECT s, qid, n_rel FROM erel, (VALUES (10), (50), (200)) AS v(s)) q
        LEFT JOIN (SELECT s, qid, count(*) AS n, count(r.src) AS hits FROM ucand u LEFT JOIN edges r ON r.src = u.qid AND r.dst = u.doc_id GROUP BY ALL) c USING (s, qid) GROUP BY s""",
        FEATURES,
        "ucand AS (SELECT s, qid, doc_id FROM ptop, (VALUES (10), (50), (200)) AS v(s) WHERE r <= s UNION SELECT s, qid, doc_id FROM vtop, (VALUES (10), (50), (200)) AS v(s) WHERE r <= s),",
    ),
    "all_systems": _sql("SELECT system, qid, doc_id, rank FROM sysr WHERE rank <= 3", FEATURES, _SYSTEMS),
    "system_measures": _sql(
        """SELECT system, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(p10), 6) AS p10, round(avg(ndcg10), 6) AS ndcg10 FROM (
          SELECT system, qid, sum(coalesce(hit / rank, 0)) / any_value(n_rel) AS ap, coalesce(1 / min(rank), 0) AS rr, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) / 10 AS p10,
            sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(any_value(n_rel), 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg10
          FROM (SELECT y.system, e.src AS qid, x.rank, n_rel, CASE WHEN x.rank IS NOT NULL THEN row_number() OVER (PARTITION BY y.system, e.src ORDER BY x.rank NULLS LAST) END AS hit
            FROM edges e JOIN erel ON erel.qid = e.src, (SELECT DISTINCT system FROM sysr) y LEFT JOIN sysr x ON x.system = y.system AND x.qid = e.src AND x.doc_id = e.dst) GROUP BY ALL) GROUP BY system""",
        FEATURES,
        _SYSTEMS,
    ),
    "ap_from_ranks": _sql(
        """SELECT qid, round(sum(i / rank) / any_value(n_rel), 6) AS ap FROM (SELECT p.qid, p.r AS rank, n_rel, row_number() OVER (PARTITION BY p.qid ORDER BY p.r) AS i
          FROM ptop p JOIN edges e ON e.src = p.qid AND e.dst = p.doc_id JOIN erel ON erel.qid = p.qid) GROUP BY qid""",
        FEATURES,
    ),
    "random_search": _sql("SELECT trial, fold, round(map, 6) AS map, n FROM tried", FEATURES, _TRIED),
    "nested_cv": _sql(
        """SELECT fold, trial, round(map, 6) AS map FROM (SELECT *, round((sum(map * n) OVER (PARTITION BY trial) - map * n) / (sum(n) OVER (PARTITION BY trial) - n), 9) AS others FROM tried)
        QUALIFY row_number() OVER (PARTITION BY fold ORDER BY others DESC, trial) = 1""",
        FEATURES,
        _TRIED,
    ),
    "ablation": _sql(
        "SELECT system, count(*) AS n_queries, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in _NAMES) + f""" FROM (SELECT system, qid, {MEASURES} FROM (
          SELECT s.system, e.src AS qid, x.rank, n_rel, CASE WHEN x.rank IS NOT NULL THEN row_number() OVER (PARTITION BY s.system, e.src ORDER BY x.rank NULLS LAST) END AS hit
          FROM edges e JOIN trel ON trel.qid = e.src, (SELECT DISTINCT system FROM ladr) s LEFT JOIN ladr x ON x.system = s.system AND x.qid = e.src AND x.doc_id = e.dst) GROUP BY ALL) GROUP BY system""",
        FEATURES,
        _TRIED,
        f"""lad(system, w1, w2, w3) AS (VALUES {", ".join(f"('{k}', " + ", ".join(f"{w.get(n, 0.0) / sum(w.values())!r}::DOUBLE" for n in NAMES) + ")" for k, w in LADDER.items())}),
ladr AS (SELECT system, qid, doc_id, row_number() OVER (PARTITION BY system, qid ORDER BY round(text * w1 + neighbour * w2 + authority * w3, 6) DESC, round(text, 6) DESC, doc_id) AS rank FROM scal, lad),""",
    ),
    "neighbour_votes": _sql("SELECT qid, doc_id, round(neighbour, 6) AS votes FROM vote", FEATURES),
    "candidates_top20": _sql("SELECT qid, count(*) AS n, sum(coalesce(x.n, 0))::BIGINT AS citations FROM cand LEFT JOIN (SELECT dst AS doc_id, count(*) AS n FROM edges WHERE src % 5 <> 0 GROUP BY dst) x USING (doc_id) GROUP BY qid", FEATURES),
    "authority_loo": _sql("SELECT qid, doc_id, round(authority, 6) AS authority FROM feat", FEATURES),
    "minmax_features": _sql("SELECT qid, doc_id, round(text, 6) AS text, round(neighbour, 6) AS neighbour, round(authority, 6) AS authority FROM scal", FEATURES),
    "net_score": _sql(
        """SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN d.date < dq.date OR d.date IS NULL OR dq.date IS NULL THEN 0 ELSE 1 END, round(net, 6) DESC, round(text, 6) DESC, doc_id) AS INTEGER) AS rank, round(net, 6) AS net
        FROM nets JOIN dq USING (qid) JOIN docs d USING (doc_id) QUALIFY rank <= 10""",
        FEATURES,
    ),
    "expected_ranks": _sql(
        """SELECT qid, sum(e) AS total, max(e) AS last FROM (SELECT qid, rank() OVER (PARTITION BY qid ORDER BY round(net, 3) DESC) + (count(*) OVER (PARTITION BY qid, round(net, 3)) - 1) / 2 AS e FROM nets) GROUP BY qid""", FEATURES
    ),
    "explanations": _sql(
        """SELECT qid, doc_id, CASE WHEN t >= n AND t >= a AND NOT (t = n OR t = a) THEN 'text' WHEN n > a AND n > t THEN 'neighbour' WHEN a > n AND a > t THEN 'authority' WHEN a = n AND a >= t OR a = t AND a >= n THEN 'authority' ELSE 'neighbour' END AS first_part,
          greatest(t, n, a) AS contribution
        FROM (SELECT qid, doc_id, round(text * 0.35444, 5) AS t, round(neighbour * 0.48788, 5) AS n, round(authority * 0.15768, 5) AS a FROM nets
          QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(net, 6) DESC, round(text, 6) DESC, doc_id) = 1)""",
        FEATURES,
    ),
    "reweighted_scores": _sql(
        """SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY net DESC, round(text, 6) DESC, doc_id) AS INTEGER) AS rank, net
        FROM (SELECT qid, doc_id, text, round(text * 0.5 + neighbour * 0.25 + authority * 0.25, 6) AS net FROM scal) QUALIFY rank <= 3""",
        FEATURES,
    ),
    "temporal_filter": _sql("SELECT e.src AS qid, e.dst AS doc_id FROM edges e JOIN dq ON dq.qid = e.src JOIN docs d ON d.doc_id = e.dst WHERE coalesce(d.date < dq.date, true)"),
    "recency_and_court": _sql(
        """SELECT e.src AS qid, e.dst AS doc_id, CAST(year(dq.date) - year(d.date) AS DOUBLE) AS gap, round(CASE WHEN year(dq.date) >= year(d.date) THEN exp(-(year(dq.date) - year(d.date)) / 10.0) ELSE 0 END, 6) AS recency,
          CASE d.court WHEN 'SC' THEN 1.0::DOUBLE WHEN 'HC' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS prior
        FROM edges e JOIN dq ON dq.qid = e.src JOIN docs d ON d.doc_id = e.dst"""
    ),
    "rrf_top10": _sql(
        """SELECT qid, doc_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first, doc_id) AS INTEGER) AS rank
        FROM (SELECT qid, doc_id, sum(1 / (60 + rank)) AS score, arg_min(rank, l) AS first FROM (SELECT qid, doc_id, rank, 1 AS l FROM tfidf_r WHERE rank <= 50 UNION ALL SELECT qid, doc_id, rank, 2 FROM bm25_r WHERE rank <= 50) GROUP BY ALL)
        QUALIFY rank <= 10"""
    ),
    "fused_then_base": _sql(
        """SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY part, r, doc_id) AS INTEGER) AS rank
        FROM (SELECT qid, doc_id, 0 AS part, rank AS r FROM bm25_r WHERE rank <= 3
          UNION ALL SELECT qid, doc_id, 1, rank FROM tfidf_r t WHERE rank <= 50 AND NOT EXISTS (SELECT 1 FROM bm25_r b WHERE b.qid = t.qid AND b.doc_id = t.doc_id AND b.rank <= 3)) QUALIFY rank <= 10"""
    ),
    "elimination": _sql(
        """SELECT qid, count(*) AS n FROM (
          SELECT qid, doc_id FROM (SELECT qid, term, keep, sum(keep) OVER (PARTITION BY qid) AS k FROM (SELECT qid, term, CASE WHEN round(log10(n / df), 9) >= 1 THEN 1 ELSE 0 END AS keep FROM qt JOIN adf USING (term), nd)) JOIN alls USING (term)
          WHERE keep = 1 OR k = 0 GROUP BY qid, doc_id HAVING count(*) >= CASE WHEN any_value(k) = 0 THEN 1 ELSE least(2, any_value(k)) END) GROUP BY qid"""
    ),
    "champions": _sql("SELECT qid, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT DISTINCT qid, doc_id FROM qt JOIN champ USING (term)) GROUP BY qid", _CHAMPIONS),
    "tiers": _sql("SELECT CAST(tier AS INTEGER) AS tier, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM tier GROUP BY tier", _TIERS),
    "tier_candidates": _sql(
        """SELECT qid, count(*) AS n FROM (SELECT h.qid, h.tier, d.depth FROM hit h JOIN (
          SELECT qid, coalesce(min(CASE WHEN upto >= 100 THEN tier END), max(tier)) AS depth FROM (SELECT qid, tier, sum(count(*)) OVER (PARTITION BY qid ORDER BY tier) AS upto FROM hit GROUP BY qid, tier) GROUP BY qid) d USING (qid))
        WHERE tier <= depth GROUP BY qid""",
        _TIERS,
        "hit AS (SELECT DISTINCT qid, doc_id, tier FROM qt JOIN alls USING (term) JOIN tier USING (doc_id)),",
    ),
    "cluster_candidates": _sql("SELECT qid, count(*) AS n FROM qsim JOIN fol USING (leader) GROUP BY qid", _LEADERS),
    "pruning_work": _sql("SELECT qid, count(*) AS postings, count(DISTINCT doc_id) AS docs FROM qt JOIN alls USING (term) WHERE (qid, doc_id) IN (SELECT qid, champ.doc_id FROM qt JOIN champ USING (term)) GROUP BY qid", _CHAMPIONS),
    "heap_top": _sql("SELECT doc_id, score FROM bm25 WHERE qid = 0 ORDER BY score DESC, doc_id LIMIT 25"),
    "relevance": _sql("SELECT qid, doc_id FROM rel", RELEVANCE),
    "measures_per_query": _sql(f"SELECT qid, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM (SELECT qid, {MEASURES} FROM jud GROUP BY qid)", RELEVANCE),
    "measures_mean": _sql(f"SELECT count(*) AS n_queries, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM (SELECT qid, {MEASURES} FROM jud GROUP BY qid)", RELEVANCE),
    "precision_recall_11": _sql(
        """SELECT level, round(avg(p), 6) AS precision FROM (SELECT qid, l / 10 AS level, coalesce(max(CASE WHEN hit / n_rel >= l / 10 - 1e-12 THEN hit / rank END), 0) AS p FROM jud, UNNEST(range(0, 11)) AS t(l) GROUP BY qid, l) GROUP BY level""", RELEVANCE
    ),
    "micro_averages": _sql(
        "SELECT count(DISTINCT qid) AS n_queries, " + ", ".join(f"round({_HITS(k)} / ({k} * count(DISTINCT qid)), 6) AS micro_p{k}, round({_HITS(k)} / count(*), 6) AS micro_r{k}" for k in _CUTS) + " FROM jud", RELEVANCE
    ),
    "filter_statistics": _sql(
        """SELECT round((SELECT avg(CASE WHEN date IS NULL THEN 0 ELSE 1 END) FROM dq) * (SELECT avg(CASE WHEN date IS NULL THEN 0 ELSE 1 END) FROM docs WHERE doc_id % 5 <> 0), 6) AS both_dated,
          round(avg(CASE WHEN d.date >= dq.date THEN 1 ELSE 0 END), 6) AS relevant_removed, round(avg(CASE WHEN p.qid IS NULL THEN 0 ELSE 1 END), 6) AS first_stage_recall
        FROM edges e JOIN dq ON dq.qid = e.src JOIN docs d ON d.doc_id = e.dst LEFT JOIN ptop p ON p.qid = e.src AND p.doc_id = e.dst""",
        FEATURES,
    ),
    "leakage_authority": _sql(
        """SELECT 'clean' AS kind, round(avg(authority), 6) AS authority FROM feat JOIN dq USING (qid) WHERE split <> 'test'
        UNION ALL SELECT 'own_links', round(avg(ln(1 + coalesce(b.n, 0))), 6) FROM feat JOIN dq USING (qid) LEFT JOIN base b USING (doc_id) WHERE split <> 'test'
        UNION ALL SELECT 'val_links', round(avg(ln(1 + coalesce(b.n, 0) - CASE WHEN s.src IS NULL THEN 0 ELSE 1 END)), 6) FROM feat f JOIN dq USING (qid) LEFT JOIN base2 b ON b.doc_id = f.doc_id LEFT JOIN src2 s ON s.src = f.qid AND s.dst = f.doc_id WHERE split <> 'test'""",
        FEATURES,
        "src2 AS (SELECT e.* FROM edges e LEFT JOIN dq ON dq.qid = e.src WHERE dq.split IS NULL OR dq.split IN ('train', 'val')), base2 AS (SELECT dst AS doc_id, count(*) AS n FROM src2 GROUP BY dst),",
    ),
    "leakage_audit": _sql(
        """SELECT kind, count(*) AS n, round(avg(ap), 6) AS map FROM (
          SELECT kind, qid, sum(coalesce(hit / rank, 0)) / any_value(n_rel) AS ap FROM (
            SELECT k.kind, e.src AS qid, n_rel, x.rank, CASE WHEN x.rank IS NOT NULL THEN row_number() OVER (PARTITION BY k.kind, e.src ORDER BY x.rank NULLS LAST) END AS hit
            FROM kinds k JOIN dq ON dq.split = k.split JOIN edges e ON e.src = dq.qid JOIN erel ON erel.qid = e.src LEFT JOIN leakr x ON x.kind = k.kind AND x.qid = e.src AND x.doc_id = e.dst) GROUP BY ALL) GROUP BY kind""",
        FEATURES,
        """kinds(kind, split) AS (VALUES ('a_clean', 'train'), ('a_own_links', 'train'), ('b_clean', 'val'), ('b_val_links', 'val'), ('c_full_text', 'val'), ('d_dated', 'val')),
src2 AS (SELECT e.* FROM edges e LEFT JOIN dq ON dq.qid = e.src WHERE dq.split IS NULL OR dq.split IN ('train', 'val')), base2 AS (SELECT dst AS doc_id, count(*) AS n FROM src2 GROUP BY dst),
aqt AS (SELECT doc_id AS qid, term, count(*) AS qtf FROM tok WHERE doc_id % 5 = 0 GROUP BY ALL),
aq0 AS (SELECT qid, term, (1 + log10(qtf)) * log10(n / df) AS w FROM aqt JOIN pdf USING (term), npool),
aqn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM aq0 GROUP BY qid),
atop AS (
  SELECT qid, doc_id, text FROM (SELECT qid, doc_id, round(sum(CASE WHEN aqn.norm > 0 THEN aq0.w / aqn.norm ELSE 0 END * (1 + log10(tf)) / pnorm.norm), 6) AS text
    FROM aq0 JOIN aqn USING (qid) JOIN pp USING (term) JOIN pnorm USING (doc_id) GROUP BY qid, doc_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY text DESC, doc_id) <= 1000),
leakf AS (
  SELECT k.kind, f.qid, f.doc_id, f.text, f.neighbour, CASE k.kind WHEN 'a_own_links' THEN ln(1 + coalesce(b.n, 0)) WHEN 'b_val_links' THEN ln(1 + coalesce(c.n, 0)) ELSE f.authority END AS authority
  FROM feat f JOIN dq USING (qid) JOIN kinds k ON k.split = dq.split AND k.kind <> 'c_full_text' LEFT JOIN base b ON b.doc_id = f.doc_id LEFT JOIN base2 c ON c.doc_id = f.doc_id
  UNION ALL SELECT 'c_full_text', a.qid, a.doc_id, a.text, coalesce(v.neighbour, 0), ln(1 + coalesce(b.n, 0) - CASE WHEN s.src IS NULL THEN 0 ELSE 1 END)
  FROM atop a JOIN dq ON dq.qid = a.qid AND dq.split = 'val' LEFT JOIN vote v ON v.qid = a.qid AND v.doc_id = a.doc_id LEFT JOIN base b ON b.doc_id = a.doc_id LEFT JOIN src s ON s.src = a.qid AND s.dst = a.doc_id),
leakl AS (SELECT kind, qid, min(text) AS t0, max(text) AS t1, min(neighbour) AS n0, max(neighbour) AS n1, min(authority) AS a0, max(authority) AS a1 FROM leakf GROUP BY ALL),
leaks AS (
  SELECT kind, qid, doc_id, CASE WHEN t1 > t0 THEN (text - t0) / (t1 - t0) ELSE 0 END AS text, CASE WHEN n1 > n0 THEN (neighbour - n0) / (n1 - n0) ELSE 0 END AS neighbour,
    CASE WHEN a1 > a0 THEN (authority - a0) / (a1 - a0) ELSE 0 END AS authority FROM leakf JOIN leakl USING (kind, qid)),
leakr AS (
  SELECT kind, qid, doc_id, row_number() OVER (PARTITION BY kind, qid ORDER BY CASE WHEN kind = 'd_dated' AND coalesce(d.date >= dq.date, false) THEN 1 ELSE 0 END,
    round(text * 0.35444 + neighbour * 0.48788 + authority * 0.15768, 6) DESC, round(text, 6) DESC, doc_id) AS rank FROM leaks JOIN dq USING (qid) JOIN docs d USING (doc_id)),""",
    ),
    "bootstrap_ci": _sql(
        """SELECT round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM (
          SELECT b, avg(delta) AS m, any_value(mean) AS mean FROM (
            SELECT b, mean, CAST(floor(('0x' || substr(md5('13/' || b || '/' || i), 1, 13))::BIGINT / 4503599627370496 * n) AS BIGINT) AS place
            FROM (SELECT count(*) AS n, avg(delta) AS mean FROM placed), UNNEST(range(0, 1000)) AS t(b), UNNEST(range(1, n + 1)) AS u(i)) JOIN placed USING (place) GROUP BY b)""",
        RELEVANCE,
        """judb AS (
  SELECT r.qid, x.rank, CASE WHEN x.rank IS NOT NULL THEN row_number() OVER (PARTITION BY r.qid ORDER BY x.rank NULLS LAST) END AS hit, n_rel
  FROM rel r JOIN nrel USING (qid) LEFT JOIN (SELECT * FROM bm25_r WHERE rank <= 100) x ON x.qid = r.qid AND x.doc_id = r.doc_id),
placed AS (
  SELECT a.ap - b.ap AS delta, row_number() OVER (ORDER BY qid) - 1 AS place FROM (SELECT qid, sum(coalesce(hit / rank, 0)) / any_value(n_rel) AS ap FROM jud GROUP BY qid) a
  JOIN (SELECT qid, sum(coalesce(hit / rank, 0)) / any_value(n_rel) AS ap FROM judb GROUP BY qid) b USING (qid)),""",
    ),
    "point_lookup": _sql("SELECT doc_id, court, date, CAST(length(text) AS INTEGER) AS n_chars FROM docs JOIN documents USING (doc_id) WHERE doc_id = 17"),
    "position_bytes": _sql(
        f"""SELECT zone, count(*) AS lists, sum(n)::BIGINT AS positions, sum(bytes)::BIGINT AS bytes, sum(total)::BIGINT AS checksum FROM (
          SELECT zone, count(*) AS n, sum({_VBYTE("gap")}) AS bytes, sum(pos + 1) AS total
          FROM (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY zone, term, doc_id ORDER BY pos), 0) AS gap FROM tok WHERE zone IN ('facts', 'issues')) GROUP BY zone, term, doc_id) GROUP BY zone"""
    ),
    "boolean_trace": _sql(
        f"""SELECT CAST(step AS INTEGER) AS step, node, docs FROM (VALUES (0, 'und', (SELECT count(*) FROM ({_HAS("und")}))), (1, 'que', (SELECT count(*) FROM ({_HAS("que")}))),
          (2, '(und OR que)', (SELECT count(*) FROM ({_HAS("und")} UNION {_HAS("que")}))), (3, 'die', (SELECT count(*) FROM ({_HAS("die")}))),
          (4, 'NOT die', (SELECT count(*) FROM (SELECT doc_id FROM docs EXCEPT {_HAS("die")}))), (5, 'facts:la', (SELECT count(*) FROM ({_HAS("la", "facts")}))),
          (6, '((und OR que) AND NOT die AND facts:la)', (SELECT count(*) FROM ((({_HAS("und")} UNION {_HAS("que")}) EXCEPT {_HAS("die")}) INTERSECT {_HAS("la", "facts")})))) AS v(step, node, docs)"""
    ),
    "title_leaks": _sql(
        """SELECT qid, doc_id, contains(x, t) AS exact, len(str_split(t, ' v. ')) = 2 AND list_bool_and(list_transform(str_split(t, ' v. '), lambda p: contains(x, p))) AS parties
        FROM rel JOIN (SELECT item_id AS qid, lower(text) AS x FROM benchmark) USING (qid) JOIN (
          SELECT doc_id, lower(CASE WHEN doc_id % 2 = 0 THEN concat_ws(' ', w[1], w[2]) ELSE w[1] || ' v. ' || coalesce(w[3], 'x') END) AS t FROM (SELECT doc_id, str_split(text, ' ') AS w FROM documents)) USING (doc_id)""",
        RELEVANCE,
    ),
    "and_order": _sql(
        """SELECT query, (CASE WHEN l3 = 0 THEN l1 + l2 ELSE l1 + l2 + (SELECT count(*) FROM sets s WHERE s.query = q.query AND has1 AND has2) + l3 END)::BIGINT AS written,
          (CASE WHEN c = '' THEN s1 + s2 ELSE s1 + s2 + (SELECT count(*) FROM sizes s WHERE s.query = q.query AND first2) + s3 END)::BIGINT AS by_size, (SELECT count(*) FROM sets s WHERE s.query = q.query AND has1 AND has2 AND has3) AS docs FROM q""",
        """
asked(query, a, b, c) AS (VALUES ('die und', 'die', 'und', ''), ('que la de', 'que', 'la', 'de'), ('thing onerr und', 'thing', 'onerr', 'und')),
sets AS (
  SELECT query, doc_id, bool_or(term = a) AS has1, bool_or(term = b) AS has2, bool_or(term = c) OR any_value(c) = '' AS has3 FROM asked JOIN alls ON term IN (a, b, c) GROUP BY ALL),
lens AS (SELECT query, a, b, c, count(*) FILTER (term = a) AS l1, count(*) FILTER (term = b) AS l2, count(*) FILTER (term = c) AS l3 FROM asked JOIN alls ON term IN (a, b, c) GROUP BY ALL),
ordr AS (SELECT query, w, l, row_number() OVER (PARTITION BY query ORDER BY l, w) AS r FROM (SELECT query, a AS w, l1 AS l FROM lens UNION ALL SELECT query, b, l2 FROM lens UNION ALL SELECT query, c, l3 FROM lens WHERE c <> '')),
q AS (SELECT lens.*, (SELECT l FROM ordr o WHERE o.query = lens.query AND r = 1) AS s1, (SELECT l FROM ordr o WHERE o.query = lens.query AND r = 2) AS s2, (SELECT l FROM ordr o WHERE o.query = lens.query AND r = 3) AS s3 FROM lens),
sizes AS (SELECT o.query, doc_id, count(*) = 2 AS first2 FROM ordr o JOIN alls ON term = w WHERE r <= 2 GROUP BY ALL),
""",
    ),
    "statute_references": "SELECT doc_id, unnest(" + _PLANTED + ") AS token FROM documents",
    "document_provisions": _sql("SELECT doc_id, id FROM held", _HELD),
    "provision_coverage": _sql("SELECT count(DISTINCT doc_id) AS with_provision, count(DISTINCT id) AS provisions, count(*) AS pairs, any_value(n) AS docs FROM held, nd", _HELD),
    "provision_idf": _sql("SELECT id, round(idf, 6) AS idf FROM pidf", _HELD),
    "provision_predictions": _sql("SELECT qid, id, round(weight, 6) AS weight, rank FROM ppred", _HELD),
    "provision_recall": _sql(
        "SELECT round(avg(r), 6) AS recall FROM (SELECT qid, avg(CASE WHEN p.id IS NULL THEN 0 ELSE 1 END) AS r FROM (SELECT item_id AS qid, item_id % 20 + k AS id FROM benchmark, (VALUES (1), (2)) AS v(k)) g LEFT JOIN ppred p USING (qid, id) GROUP BY qid)", _HELD
    ),
    "statute_channel": _sql(
        """SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (
          SELECT qid, doc_id, round(CASE WHEN max(t.score) OVER (PARTITION BY qid) > 0 THEN t.score / max(t.score) OVER (PARTITION BY qid) ELSE 0 END + 0.3 * coalesce(channel, 0), 6) AS score
          FROM (SELECT * FROM tfidf_r WHERE rank <= 100) t LEFT JOIN (
            SELECT qid, doc_id, sum(weight * idf) / (SELECT max(idf) FROM pidf) AS channel FROM ppred JOIN held USING (id) JOIN pidf USING (id) GROUP BY ALL) USING (qid, doc_id)) QUALIFY rank <= 10""",
        _HELD,
    ),
    "bm25_grid": _sql(
        """SELECT k1, b, round(sum(s / n_rel) / (SELECT count(*) FROM nrel), 6) AS map FROM (
          SELECT k1, b, qid, sum(i / rank) AS s FROM (SELECT *, row_number() OVER (PARTITION BY k1, b, qid ORDER BY rank) AS i FROM (
            SELECT k1, b, qid, doc_id, row_number() OVER (PARTITION BY k1, b, qid ORDER BY score DESC, doc_id) AS rank FROM (
              SELECT k1, b, qid, doc_id, round(sum(idf * qtf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / mean))), 6) AS score FROM bm, (VALUES (0.9::DOUBLE), (1.2::DOUBLE), (2.0::DOUBLE)) AS k(k1), (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) AS v(b) GROUP BY ALL))
            JOIN rel USING (qid, doc_id)) GROUP BY ALL) JOIN nrel USING (qid) GROUP BY k1, b""",
        RELEVANCE,
    ),
    "neighbour_grid": _sql(
        """SELECT k, p, round(sum(s / n_rel) / (SELECT count(*) FROM erel), 6) AS map FROM (
          SELECT k, p, qid, sum(i / rank) AS s FROM (SELECT *, row_number() OVER (PARTITION BY k, p, qid ORDER BY rank) AS i FROM (
            SELECT k, p, qid, doc_id, row_number() OVER (PARTITION BY k, p, qid ORDER BY score DESC, doc_id) AS rank FROM (
              SELECT k, p, n.qid, e.dst AS doc_id, round(sum(n.sim ** p), 6) AS score FROM near n JOIN edges e ON e.src = n.neighbour, (VALUES (5), (20)) AS a(k), (VALUES (1), (2)) AS b(p) WHERE n.rank <= k GROUP BY ALL))
            JOIN (SELECT src AS qid, dst AS doc_id FROM edges WHERE src % 5 = 0) USING (qid, doc_id)) GROUP BY ALL) JOIN erel USING (qid) GROUP BY k, p""",
        FEATURES,
    ),
    "url_canonical": _sql("SELECT page_id, canonical, host FROM canon", _URL),
    "host_pages": _sql("SELECT host, count(*) AS pages, count(DISTINCT canonical) AS distinct_pages FROM canon GROUP BY host", _URL),
    "page_links": "SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY href",
    "shingle_jaccard": _sql(
        """SELECT a, b, round(c / (na + nb - c), 6) AS jaccard FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c, any_value(p.n) AS na, any_value(q.n) AS nb FROM item p JOIN item q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL) WHERE c / (na + nb - c) >= 0.9""",
        _SHINGLES,
        "texts AS (SELECT min(doc_id) AS doc_id, s FROM sh WHERE len(s) > 0 GROUP BY s), item AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM texts),",
    ),
    "content_first_seen": _sql("SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM sh", _SHINGLES),
    "crawl_levels": _sql("SELECT page, CAST(min(level) AS INTEGER) AS level FROM reach GROUP BY page", "reach(page, level) AS (SELECT doc_id, 0 FROM docs WHERE doc_id < 3 UNION SELECT e.dst, level + 1 FROM reach JOIN edges e ON e.src = reach.page WHERE level < 3),"),
    "profile_documents": "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, count(doc_id) - count(DISTINCT doc_id) AS n_repeated, "
    + ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in ("doc_id", "text", "lang", "source", "n_chars"))
    + " FROM documents",
    "profile_roles": _sql("SELECT zone AS label, count(*) AS n, zone <> 'other' AS known FROM paras GROUP BY zone"),
    "profile_lengths": "SELECT round(avg(n), 6) AS mean, quantile_cont(n::DOUBLE, 0.5) AS median, CAST(max(n) AS INTEGER) AS most FROM (SELECT len(list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda w: w <> '')) AS n FROM documents)",
    "profile_overlaps": _sql("SELECT count(*) AS pairs, count(*) FILTER (dst % 5 <> 0) AS to_pool, count(*) FILTER (src = dst) AS to_self, count(DISTINCT dst) AS cited FROM edges"),
    "profile_dates": _sql('SELECT count(*) FILTER (y.date < x.date) AS "before", count(*) FILTER (y.date = x.date) AS same, count(*) FILTER (y.date > x.date) AS "after" FROM edges JOIN docs x ON x.doc_id = src JOIN docs y ON y.doc_id = dst'),
    "profile_patterns": " UNION ALL ".join(
        f"SELECT '{n}' AS pattern, count(*) FILTER (regexp_matches(text, '{p}')) AS rows, sum(len(regexp_extract_all(text, '{p}')))::BIGINT AS matches FROM documents"
        for n, p in (("email", "[a-z0-9.]+@[a-z0-9.]+"), ("number", "[0-9]+"), ("license", "Licensed|Released under"))
    ),
    "profile_shapes": "SELECT regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g') AS value, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, value LIMIT 8",
    "zone_profile": _sql(
        r"""SELECT zone, count(*) AS paragraphs, round(avg(place), 6) AS mean_position, round(avg(CASE WHEN place >= 0.9 THEN 1 ELSE 0 END), 6) AS late, round(avg(len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> ''))), 6) AS mean_words
        FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN para / (count(*) OVER (PARTITION BY doc_id) - 1) ELSE 0 END AS place FROM paras) GROUP BY zone"""
    ),
    "distinctive_terms": _sql(
        """SELECT zone, term, log_odds, CAST(row_number() OVER (PARTITION BY zone ORDER BY log_odds DESC, term) AS INTEGER) AS rank FROM (
          SELECT zone, term, round(ln((x + 0.5) / (z - x + 0.5)) - ln((t - x + 0.5) / (e - z - (t - x) + 0.5)), 6) AS log_odds
          FROM (SELECT zone, term, count(*) AS x, sum(count(*)) OVER (PARTITION BY term) AS t FROM tok GROUP BY zone, term) JOIN (SELECT zone, count(*) AS z FROM tok GROUP BY zone) USING (zone), (SELECT count(*) AS e FROM tok) WHERE t >= 30) QUALIFY rank <= 12"""
    ),
    "zone_cosines": _sql(
        """SELECT a.zone AS a, b.zone AS b, round(sum(a.df * b.df) / (any_value(x.norm) * any_value(y.norm)), 6) AS cosine FROM zd a JOIN zd b ON a.term = b.term AND a.zone < b.zone JOIN zn x ON x.zone = a.zone JOIN zn y ON y.zone = b.zone GROUP BY ALL""",
        "zd AS (SELECT zone, term, count(DISTINCT doc_id) AS df FROM tok GROUP BY ALL), zn AS (SELECT zone, sqrt(sum(df * df)) AS norm FROM zd GROUP BY zone),",
    ),
    "snippets": r"SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)",
    "host_slugs": _sql("SELECT page_id, regexp_replace(regexp_replace(host, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM parts", _URL),
    "rate_limit": "SELECT user_id, max(n) AS most, count(*) FILTER (n <= 3) AS allowed FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY user_id",
    "bounded_history": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5",
    "idempotent_saves": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
    "search_request": _sql(
        """SELECT CAST(row_number() OVER (ORDER BY round(net, 6) DESC, round(text, 6) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(net, 6) AS score, CAST(reasons AS INTEGER) AS n_reasons
        FROM (SELECT doc_id, text, reasons, text * 0.35444 + neighbour * 0.48788 + authority * 0.15768 AS net FROM rscal) QUALIFY rank <= 20""",
        FEATURES,
        """
rq AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(regexp_extract_all('und die thing que ofthe hation onerr', '[a-z0-9]+')) AS term) GROUP BY term),
rw0 AS (SELECT term, (1 + log10(qtf)) * log10(n / df) AS w FROM rq JOIN adf USING (term), nd),
rw AS (SELECT term, w / (SELECT sqrt(sum(w * w)) FROM rw0) AS w FROM rw0),
rs AS (
  SELECT doc_id, round(sum(rw.w * dw.w), 6) AS text FROM rw JOIN dw USING (term) JOIN docs USING (doc_id)
  WHERE court IN ('SC', 'HC') AND (year(date) BETWEEN 2001 AND 2015 OR date IS NULL) GROUP BY doc_id),
rn0 AS (SELECT term, (1 + log10(qtf)) * log10(n / df) AS w FROM rq JOIN tdf USING (term), nt WHERE df < n),
rnear AS (
  SELECT * FROM (SELECT t.qid AS neighbour, round(sum(a.w / (SELECT sqrt(sum(w * w)) FROM rn0) * (1 + log10(t.qtf)) / tnorm.norm), 9) AS sim FROM rn0 a JOIN tt t USING (term) JOIN tnorm USING (qid) GROUP BY ALL)
  WHERE sim > 0 ORDER BY sim DESC, neighbour LIMIT 20),
rvote AS (SELECT e.dst AS doc_id, sum(sim ** 4) AS neighbour, count(*) AS reasons FROM rnear JOIN edges e ON e.src = rnear.neighbour GROUP BY ALL),
rtop AS (
  SELECT doc_id, text, coalesce(neighbour, 0) AS neighbour, coalesce(reasons, 0) AS reasons, ln(1 + coalesce(base.n, 0)) AS authority
  FROM (SELECT * FROM rs ORDER BY text DESC, doc_id LIMIT 1000) LEFT JOIN rvote USING (doc_id) LEFT JOIN base USING (doc_id)),
rscal AS (
  SELECT doc_id, reasons, (text - min(text) OVER ()) / (max(text) OVER () - min(text) OVER ()) AS text, (neighbour - min(neighbour) OVER ()) / (max(neighbour) OVER () - min(neighbour) OVER ()) AS neighbour, (authority - min(authority) OVER ()) / (max(authority) OVER () - min(authority) OVER ()) AS authority FROM rtop),
""",
    ),
}
