"""The registered queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import ann, bpe, collocations, ctw, divergence, langid, licenses, line_dedup, media, minhash_forest, packing, quality, toxicity
from lexweave.llm.common import documents, small_batches


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_forest.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), 4)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds media: every page, drawn as an image, is one."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    found = media.image_groups(pages, lambda markup: media.decode_image(media.rasterise(markup)))
    return found.withColumnRenamed("id", "page_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = line_dedup.dedup_lines(docs, count="n_dropped")
    return found.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"), F.col("n_dropped").cast("long").alias("n_dropped"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = lambda doc_id: remainder(doc_id, 4) == 2
    model = quality.train(docs, labels, held_out)
    found = quality.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    k = 20
    graphs, shards = ann.index(vectors, k + 1)
    asked = ann.usable(vectors, "vec_id", "embedding").where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    return ann.nearest(graphs, shards, asked, k)


def op7_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licenses.find_licenses(docs, licenses.known_digests(spark)).select("doc_id", "digest", "license_id")


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return ctw.score_documents(docs, remainder(F.col("doc_id"), 5) == 1)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.drop("text")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(documents(spark, sf_dir))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = lambda doc_id: remainder(doc_id, 5) == 0
    found = toxicity.score(docs, toxicity.train(docs, labels, held_out))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_page_images": op2_page_images,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_graph_ann": op6_graph_ann,
    "op7_license_digest": op7_license_digest,
    "op8_context_tree": op8_context_tree,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_tree_bpe": op10_tree_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_toxicity": op12_toxicity,
    "op13_collocations": op13_collocations,
}

OP1_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, g.b FROM reach r JOIN both_ways g ON r.b = g.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

# Candidates by equal halves, distance by counting places or by trying every deletion: another way to the same lines.
OP3_SQL = r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS no, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
k AS (SELECT line, length(line) AS n, min(doc_id * 10000000 + no) AS at FROM t WHERE length(line) >= 10 GROUP BY line),
same AS (SELECT x.line AS a, y.line AS b, x.at AS at_a, y.at AS at_b FROM k x JOIN k y ON x.n = y.n AND left(x.line, x.n // 2) = left(y.line, y.n // 2) AND x.line < y.line
  UNION SELECT x.line, y.line, x.at, y.at FROM k x JOIN k y ON x.n = y.n AND substr(x.line, x.n // 2 + 1) = substr(y.line, y.n // 2 + 1) AND x.line < y.line),
longer AS (SELECT x.line AS a, y.line AS b, x.at AS at_a, y.at AS at_b FROM k x JOIN k y ON y.n = x.n + 1 AND left(x.line, x.n // 2) = left(y.line, x.n // 2)
  UNION SELECT x.line, y.line, x.at, y.at FROM k x JOIN k y ON y.n = x.n + 1 AND substr(x.line, x.n // 2 + 1) = substr(y.line, x.n // 2 + 2)),
near AS (SELECT * FROM same WHERE len(list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1
  UNION SELECT * FROM longer WHERE len(list_filter(range(1, length(b) + 1), lambda i: left(b, i - 1) || substr(b, i + 1) = a)) > 0),
later AS (SELECT DISTINCT CASE WHEN at_a < at_b THEN b ELSE a END AS line FROM near),
f AS (SELECT t.doc_id, t.no, t.raw, coalesce(later.line IS NOT NULL OR t.doc_id * 10000000 + t.no > k.at, false) AS gone
  FROM t LEFT JOIN k ON t.line = k.line LEFT JOIN later ON t.line = later.line),
g AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS n_dropped FROM f GROUP BY 1)
SELECT d.doc_id, md5(g.text) AS text_md5, length(g.text) AS n_chars, coalesce(g.n_dropped, 0) AS n_dropped FROM documents d LEFT JOIN g USING (doc_id)"""

OP11_SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT t.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY t.lang, source) + v) AS p FROM t JOIN v ON t.lang = v.lang),
l AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL),
q AS (SELECT l.lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY l.lang) + v) AS q FROM l JOIN v ON l.lang = v.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN f USING (lang, source, item)
  UNION ALL SELECT p.lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 200"""

OP13_SQL = r"""WITH s AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM s),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
m AS (SELECT lang, ws, unnest(range(1, 6)) AS m FROM w),
c AS (SELECT lang, phrase, m, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM m WHERE len(ws) >= m) GROUP BY ALL HAVING count(*) >= 100),
k AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS ws FROM c WHERE m >= 2),
cut AS (SELECT lang, phrase, a, unnest(range(1, m)) AS k, ws, m FROM k),
sc AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN c x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN c y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[k + 1:cut.m], ' ') JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM sc) WHERE o = 1),
gone AS (SELECT DISTINCT x.lang, x.phrase FROM k x JOIN k y ON x.lang = y.lang AND x.m < y.m AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= 100 * x.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, phrase, a, l, r, n, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best ANTI JOIN gone USING (lang, phrase)) WHERE rank <= 2000"""

ORACLE: dict[str, str] = {"op11_source_divergence": OP11_SQL, "op13_collocations": OP13_SQL, "op1_minhash_forest": OP1_SQL, "op3_line_dedup": OP3_SQL, "op7_license_digest": licenses.oracle()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
