"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed_dedup, langid, licenses, minhash, mixing, pii, sharding, suffixdedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_mixing(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op8_licenses(spark, sf_dir):
    """The table has no paths: source, language and id stand for directory, subdirectory and file."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(table(spark, sf_dir, "documents"), path=path)


def op1_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.summary(pii.detect(docs, pii.learn(docs)))


def _crc(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(_crc("doc_id", 3) != 1)
    out = toxicity.score(docs, toxicity.learn(docs, labels))
    return out.select("doc_id", F.coalesce(_crc("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.learn(docs.where(_crc("doc_id", 5) != 0)))
    return out.select("doc_id", F.coalesce(_crc("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark, sf_dir):
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op9_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_licenses": op8_licenses,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_minhash": op10_minhash,
}

#: Blanks are 0x20 and 0x09 to 0x0D; components by recursion over links.
OP10_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
raw AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM docs),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM raw),
items AS (SELECT doc_id, unnest(s) AS x FROM raw),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN sizes p ON p.doc_id = u JOIN sizes q ON q.doc_id = v WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.a, edges.v FROM reach JOIN edges ON reach.b = edges.u),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN comp USING (doc_id)
"""

OP9_SQL = """
WITH RECURSIVE vecs AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
sound AS (
  SELECT * FROM vecs WHERE label IS NOT NULL AND len(v) > 0 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM vecs UNION SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""

#: The placement table is a literal; placing rows by it is what is checked here, tests check the table.
OP7_SQL = f"""
WITH slots AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST({sharding.lookup_table(sharding.shard_names(sharding.N_SHARDS))}[slot + 1] AS INTEGER) AS shard FROM slots
"""

#: Waterfilled targets, hash-shuffled lines of words, golden-ratio slots. Ids are taken to be unique.
OP6_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('0' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
total AS (SELECT count(*) AS n, sum(size)::BIGINT AS words, greatest(1, ceil(sum(size) / {mixing.N_SLOTS}))::BIGINT AS block FROM sized),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
    row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT (words - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM src, total
  WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (SELECT *, least(cap, (SELECT max(level) FROM levels) * weight) AS target FROM src),
parts AS (SELECT *, sum(target) OVER (ORDER BY rank) / sum(target) OVER () AS hi FROM aims),
points AS (SELECT j, (j + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((j + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) AS u, block FROM total, UNNEST(range(0, ceil(words / block)::BIGINT)) AS t(j)),
slots AS (
  SELECT rank, j, row_number() OVER (PARTITION BY rank ORDER BY j) - 1 AS k, ceil(source_size / block)::BIGINT AS blocks
  FROM points JOIN (SELECT *, hi - target / (SELECT sum(target) FROM aims) AS lo FROM parts WHERE target > 0) ON u >= lo AND u < hi),
reads AS (SELECT rank, k % blocks AS b, count(*) AS times FROM slots WHERE k // blocks < 3 GROUP BY ALL),
laid AS (
  SELECT s.*, a.rank, a.source_size, a.target, coalesce(sum(size) OVER (PARTITION BY a.rank ORDER BY h % greatest(1, floor(sqrt(n))::BIGINT), h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, block
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source, total),
cut AS (
  SELECT doc_id, rank, b, least(start + size, (b + 1) * block) - greatest(start, b * block) AS w FROM laid, UNNEST(range(start // block, (start + size - 1) // block + 1)) AS t(b) WHERE size > 0),
got AS (SELECT doc_id, sum(w * times) AS taken FROM cut JOIN reads USING (rank, b) GROUP BY doc_id)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM laid LEFT JOIN got USING (doc_id)
"""

_TEMPLATES = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(licenses.TEMPLATES))
_WORDS_OF = "list_filter(regexp_split_to_array(replace(lower({}), 'licenc', 'licens'), '[^a-z0-9]+'), lambda w: w <> '')"
_COUNT = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"

#: TF-IDF cosines of all lines, blocks and texts to the templates, none left out before; then the nearest license file above.
OP8_SQL = rf"""
WITH tpl(i, name, text) AS (VALUES {_TEMPLATES}),
tw AS (SELECT i, w, count(*) AS tf FROM (SELECT i, unnest({_WORDS_OF.format("text")}) AS w FROM tpl) GROUP BY ALL),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT (SELECT count(*) FROM docs) + (SELECT count(*) FROM tpl) AS n),
dw AS (SELECT unnest(list_distinct({_WORDS_OF.format("text")})) AS w FROM docs),
df AS (SELECT w, count(*) AS df FROM (SELECT w FROM dw WHERE w IN (SELECT w FROM tw) UNION ALL SELECT w FROM tw) GROUP BY w),
idf AS (SELECT w, ln((1 + n) / (1 + df)) + 1 AS v FROM df, n),
tv AS (SELECT i, w, tf * v AS x FROM tw JOIN idf USING (w)),
tn AS (SELECT i, sqrt(sum(x * x)) AS norm FROM tv GROUP BY i),
bl AS (SELECT doc_id, b - 1 AS b, str_split(trim(bs[b], chr(10)), chr(10)) AS ls FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS bs FROM docs), UNNEST(range(1, len(bs) + 1)) AS t(b)),
un AS (
  SELECT doc_id, b, l - 1 AS l, ls[l] AS unit FROM bl, UNNEST(range(1, len(ls) + 1)) AS t(l)
  UNION ALL SELECT doc_id, b, -1, array_to_string(ls, chr(10)) FROM bl WHERE len(ls) > 1
  UNION ALL SELECT doc_id, -1, -1, text FROM docs WHERE regexp_matches(text, '\n[ \t\r]*\n')),
uw AS (SELECT doc_id, b, l, w, count(*) AS tf FROM (SELECT doc_id, b, l, unnest({_WORDS_OF.format("unit")}) AS w FROM un) GROUP BY ALL),
uv AS (SELECT doc_id, b, l, w, tf * coalesce(v, (SELECT ln(1 + n) + 1 FROM n)) AS x FROM uw LEFT JOIN idf USING (w)),
unorm AS (SELECT doc_id, b, l, sqrt(sum(x * x)) AS norm FROM uv GROUP BY ALL),
dots AS (SELECT u.doc_id, u.b, u.l, t.i, sum(u.x * t.x) AS dot FROM uv u JOIN tv t ON t.w = u.w GROUP BY ALL HAVING count(*) >= {licenses.MIN_SHARED}),
cos AS (SELECT d.doc_id, d.b, d.l, d.i, round(dot / (tn.norm * unorm.norm), 9) AS score FROM dots d JOIN tn ON tn.i = d.i JOIN unorm ON unorm.doc_id = d.doc_id AND unorm.b = d.b AND unorm.l = d.l),
best AS (SELECT * FROM cos WHERE score >= {licenses.MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY doc_id, b, l ORDER BY score DESC, i) = 1),
counted AS (SELECT best.*, {_COUNT.format("unit")} AS words FROM best JOIN un USING (doc_id, b, l)),
top AS (SELECT doc_id, name, score FROM best JOIN tpl USING (i) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, b, l, i) = 1),
held AS (SELECT doc_id, sum(words) AS licensed FROM (SELECT doc_id, b, coalesce(max(words) FILTER (l < 0), sum(words)) AS words FROM counted WHERE b >= 0 GROUP BY ALL) GROUP BY doc_id),
seen AS (SELECT doc_id, count(*) AS found, bool_or(b < 0) AS whole FROM best GROUP BY doc_id),
files AS (
  SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, name AS own_license, score, coalesce(found, 0)::BIGINT AS n_matches,
    coalesce(whole OR coalesce(licensed, 0) >= {licenses.FILE_SHARE} * {_COUNT.format("text")}, false) AS is_license_file
  FROM documents LEFT JOIN top USING (doc_id) LEFT JOIN held USING (doc_id) LEFT JOIN seen USING (doc_id)),
dirs AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
given AS (SELECT dir AS above, min(path) AS path, arg_min(own_license, path) AS lic FROM dirs WHERE is_license_file GROUP BY dir),
ancestors AS (SELECT dir, d, array_to_string(parts[1:d], '/') AS above FROM (SELECT DISTINCT dir, str_split(dir, '/') AS parts FROM dirs), UNNEST(range(0, len(parts) + 1)) AS t(d)),
near AS (SELECT dir, path AS near_path, lic FROM ancestors JOIN given USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY d DESC) = 1)
SELECT doc_id, path, own_license, score, n_matches, is_license_file, coalesce(own_license, lic) AS license, CASE WHEN own_license IS NULL THEN near_path END AS inherited_from
FROM dirs LEFT JOIN near USING (dir)
"""

ORACLES: dict[str, str] = {"op6_mixing": OP6_SQL, "op7_sharding": OP7_SQL, "op8_licenses": OP8_SQL, "op9_embedding_dedup": OP9_SQL, "op10_minhash": OP10_SQL}
