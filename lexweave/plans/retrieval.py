"""Retrieval queries over documents, benchmark passages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import retrieval as R
from lexweave.operators import search as S
from lexweave.session import table

STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def tok(column: str) -> str:
    """The tokens of a column in DuckDB's SQL; RE2 has no look-behind, so the letter before the dot is captured."""
    plain = f"regexp_replace(lower({column}), '\\b([a-z])\\.([a-z]|\\s|$)', '\\1\\2', 'g')"
    return f"list_filter(regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


POSTS = f"""p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n_doc FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id, {tok("text")} AS t FROM documents)) GROUP BY 1, 2)"""


def bm25_sql(query_table: str, k: int, k1: float, b: float, idf: str) -> str:
    return f"""WITH {POSTS},
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tok("text")}) AS term FROM {query_table}) GROUP BY 1, 2),
tot AS (SELECT count(*) AS n, avg(len(t)) AS m FROM (SELECT {tok("text")} AS t FROM documents)),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(qtf * {idf} * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * n_doc / m))), 6) AS score
  FROM q JOIN df USING (term) JOIN p USING (term), tot GROUP BY 1, 2)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"""


CLAMPED = "CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END"


def _asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(table(spark, sf_dir, "documents"), _asked_terms(spark, sf_dir), "item_id", "doc_id", 20)


def bm25_okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 350 words of the English documents, ranked as a small scoped corpus ranks them."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", X.blank_split(F.col("text")).alias("ws"))
    parts = docs.select("doc_id", F.posexplode(X.chunks(F.col("ws"), 350, 75)).alias("n", "part"))
    chunks = parts.select((F.col("doc_id") * 100000 + F.col("n")).alias("chunk_id"), F.array_join("part", " ").alias("text"))
    return R.okapi(chunks, _asked_terms(spark, sf_dir), "item_id", "chunk_id", 10)


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a whole passage, by its tokens."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase_text"))
    return R.phrase_matches(table(spark, sf_dir, "documents"), asked, "doc_id", "item_id")


def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = R.asked_postings(table(spark, sf_dir, "documents"), _asked_terms(spark, sf_dir), "doc_id", {"text": 1.0})
    return posts.where("term is not null").groupBy("doc_id").agg(F.count("*").alias("n_terms"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cosine_top_k(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 10)


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cosine_top_k(table(spark, sf_dir, "embeddings").where("label = 1"), _asked(spark, sf_dir), 5)


def cosine_max_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_per_group(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), "label")


def dense_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.best_per_group(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), "vec_id")
    return best.withColumnRenamed("best", "score").orderBy(F.desc("score"), "vec_id").limit(50)


def _arms(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Both arms for every passage; a passage's vector is that of its number."""
    lexical = bm25_topk(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"), "rank")
    vectors = table(spark, sf_dir, "embeddings")
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    asked = vectors.join(passages, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return {"lexical": lexical, "semantic": R.cosine_top_k(vectors, asked, 20).select("query_id", F.col("vec_id").alias("id"), "rank")}


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(R.rrf(_arms(spark, sf_dir), ["query_id", "id"]), 10, ["query_id"], [F.desc("score"), F.asc("id")])


def dual_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = _arms(spark, sf_dir)
    return arms["lexical"].where("rank <= 5").withColumn("arm", F.lit("lexical")).unionByName(arms["semantic"].where("rank <= 5").withColumn("arm", F.lit("semantic")))


def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion with a recency bonus: a document's date follows from its id."""
    fused = R.rrf(_arms(spark, sf_dir), ["query_id", "id"])
    years = F.greatest(F.floor((F.lit(3000) - F.col("id")).cast("double")) / 365.25, F.lit(0.0))
    return R.top_k(fused.withColumn("score", F.round(F.col("score") + 0.008 / (1 + years), 8)), 10, ["query_id"], [F.desc("score"), F.asc("id")])


TERMS = ["tion", "eau"]


def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_passage(table(spark, sf_dir, "documents"), TERMS, "doc_id")


def preview_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region around the first of the query's terms."""
    found = S.first_hit(F.col("text"), TERMS)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.greatest(F.lit(1), found - 40).cast("int").alias("start"))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.md5(F.substring("text", F.col("start"), F.lit(2000))).alias("region_md5"), (F.col("start") > 1).alias("cut_before"), (F.col("start") + 2000 <= F.length("text")).alias("cut_after"))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(S.preview_of(F.col("text"), TERMS)).alias("preview_md5"))


def jaccard_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the sentence nearest to the passage of its number by shared words, ties to the first."""
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.array_distinct(X.tokens(F.col("text"))).alias("claim"))
    n = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n_claims"))  # one row
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(n)).withColumn("claim_id", F.col("doc_id") % F.col("n_claims"))
    sentences = docs.select("doc_id", "claim_id", F.posexplode(F.split("text", r"[.;:\n]")).alias("pos", "s")).where(F.length(F.trim("s")) >= 20)
    words = sentences.select("doc_id", "claim_id", "pos", F.array_distinct(X.tokens(F.col("s"))).alias("words"))
    scored = words.join(R.small_side(claims, R.BROADCAST_QUERIES), "claim_id").withColumn("score", F.round(X.jaccard(F.col("words"), F.col("claim")), 6))
    return scored.groupBy("doc_id").agg(F.max("score").alias("score"), (-F.max(F.struct("score", (-F.col("pos")).alias("p")))["p"]).cast("long").alias("at"))


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(X.blank_split(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", X.chunk_count(n, 130, 30).alias("n_index"), X.chunk_count(n, 350, 75).alias("n_title"))


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The words are a column of their own, so that they are split once, not once a chunk.
    words = table(spark, sf_dir, "documents").select("doc_id", X.blank_split(F.col("text")).alias("ws"))
    parts = words.select("doc_id", F.posexplode(X.chunks(F.col("ws"), 130, 30)).alias("chunk", "ws"))
    return parts.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("ws").cast("long").alias("n_words"), F.sha2(F.array_join("ws", " "), 256).alias("content_hash"))


def titled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 350 words with the title, here the source, before each."""
    words = table(spark, sf_dir, "documents").select("doc_id", "source", X.blank_split(F.col("text")).alias("ws"))
    parts = words.select("doc_id", "source", F.posexplode(X.chunks(F.col("ws"), 350, 75)).alias("chunk", "ws"))
    return parts.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5(F.concat("source", F.lit("\n\n"), F.array_join("ws", " "))).alias("text_md5"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def snapshot_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over all rows in order, by a digest for each thousand ids first, so that no task holds all rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")).groupBy((F.col("doc_id") / 1000).cast("long").alias("part"))
    parts = rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda r: r["h"]), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda r: r["h"]), ""), 256).alias("snapshot"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines, up to 160 characters, that several documents of a source share."""
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.split("text", "\n").alias("ls"))
    edges = lines.select("source", "doc_id", F.explode(F.array_distinct(F.array(F.element_at("ls", 1), F.element_at("ls", -1)))).alias("line")).where(F.length("line") <= 160)
    return edges.groupBy("source", "line").agg(F.count("*").alias("n")).where("n >= 3").select("source", F.md5("line").alias("line_md5"), "n")


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("up"), X.token_estimate(F.col("text"), False).alias("down"))


def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.canonical_words(F.col("text"))).alias("canonical_md5"), F.md5(X.collapse(F.col("text"))).alias("collapsed_md5"))


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.url_canonical(F.col("url")).alias("canonical"))


def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of all turns by the words that they begin with, up to 12 characters; equal ones, whatever their case, get a number."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("turn_id"), X.slug(F.col("text"), 12).alias("slug"))
    ranked = R.top_k(rows.withColumn("low", F.lower("slug")), 2**31 - 1, ["low"], [F.asc("turn_id")])
    return ranked.select("turn_id", F.concat("slug", F.when(F.col("rank") > 1, F.concat(F.lit("-"), F.col("rank").cast("string"))).otherwise("")).alias("handle"))


COS = "round(list_dot_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6)"
SEM = f"SELECT a.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings a WHERE a.vec_id IN (SELECT item_id FROM benchmark)"
LEX = f"SELECT item_id AS query_id, doc_id AS id, rank FROM ({bm25_sql('benchmark', 20, 1.2, 0.75, CLAMPED)})"
FUSED = f"SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, count(*) AS arms FROM (SELECT * FROM ({LEX}) UNION ALL SELECT * FROM ({SEM}) WHERE rank <= 20) GROUP BY 1, 2"
SPLIT = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
COUNT = "CASE WHEN n <= {0} THEN (CASE WHEN n > 0 THEN 1 ELSE 0 END) ELSE CAST(ceil((n - {0}) / {1}.0) AS BIGINT) + 1 END"


def top_sql(inner: str, k: int, by: str, order: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM ({inner})) WHERE rank <= {k}"


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_okapi, tokenize_counts, phrase_match, matched_terms, cosine_topk, knn_filtered, cosine_max_per_group, dense_band, rrf_fusion, dual_arm, hybrid_score,
        best_window, preview_region, preview, jaccard_sentence, chunk_counts, chunk_index, titled_chunks, content_hash, snapshot_id, exact_duplicates, page_furniture, token_estimates, canonical_text, url_canonical, slug_collisions,
    )
}

ORACLE = {
    "bm25_topk": bm25_sql("benchmark", 20, 1.2, 0.75, CLAMPED),
    "bm25_okapi": f"""WITH c AS (SELECT doc_id * 100000 + chunk AS chunk_id, array_to_string(list_slice(ws, chunk * 275 + 1, chunk * 275 + 350), ' ') AS text
  FROM (SELECT doc_id, ws, unnest(range(0, CAST({COUNT.format(350, 275)} AS BIGINT))) AS chunk FROM (SELECT doc_id, {SPLIT} AS ws, len({SPLIT}) AS n FROM documents WHERE lang = 'en'))),
t AS (SELECT chunk_id, {tok("text")} AS t FROM c),
p AS (SELECT chunk_id, term, count(*) AS tf, any_value(n) AS dl FROM (SELECT chunk_id, len(t) AS n, unnest(t) AS term FROM t) GROUP BY 1, 2),
tot AS (SELECT count(*) AS n, avg(len(t)) AS m FROM t),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, tot GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tok("text")}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / m))), 6) AS score FROM q JOIN idf USING (term) JOIN p USING (term), tot GROUP BY 1, 2)
SELECT item_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    "tokenize_counts": f"SELECT doc_id, len({tok('text')}) AS n_tokens FROM documents",
    "phrase_match": f"""WITH q AS (SELECT item_id, {tok("text")} AS w FROM benchmark),
d AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {tok("text")} AS t FROM documents))
SELECT DISTINCT item_id, doc_id FROM d JOIN q ON d.t[d.i] = q.w[1] WHERE list_slice(d.t, d.i, d.i + len(q.w) - 1) = q.w""",
    "matched_terms": f"WITH {POSTS}, q AS (SELECT DISTINCT unnest({tok('text')}) AS term FROM benchmark) SELECT doc_id, count(*) AS n_terms FROM p JOIN q USING (term) GROUP BY 1",
    "cosine_topk": top_sql(f"SELECT a.vec_id AS query_id, e.vec_id, {COS} AS score FROM embeddings e, embeddings a WHERE a.vec_id % 100 = 0", 10, "query_id", "score DESC, vec_id"),
    "knn_filtered": top_sql(f"SELECT a.vec_id AS query_id, e.vec_id, {COS} AS score FROM embeddings e, embeddings a WHERE a.vec_id % 100 = 0 AND e.label = 1", 5, "query_id", "score DESC, vec_id"),
    "cosine_max_per_group": f"SELECT a.vec_id AS query_id, e.label, max({COS}) AS best FROM embeddings e, embeddings a WHERE a.vec_id % 100 = 0 GROUP BY 1, 2",
    "dense_band": f"SELECT e.vec_id, max({COS}) AS score FROM embeddings e, embeddings a WHERE a.vec_id % 100 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "rrf_fusion": top_sql(FUSED, 10, "query_id", "score DESC, id"),
    "dual_arm": f"SELECT query_id, id, rank, 'lexical' AS arm FROM ({LEX}) WHERE rank <= 5 UNION ALL SELECT query_id, id, rank, 'semantic' FROM ({SEM}) WHERE rank <= 5",
    "hybrid_score": top_sql(f"SELECT query_id, id, round(score + 0.008 / (1 + greatest((3000 - id) / 365.25, 0)), 8) AS score, arms FROM ({FUSED})", 10, "query_id", "score DESC, id"),
    "best_window": f"""WITH w AS (SELECT doc_id, {SPLIT} AS ws FROM documents), h AS (SELECT doc_id, len(ws) AS n, list_transform(ws, lambda x: CASE WHEN contains(lower(x), 'tion') OR contains(lower(x), 'eau') THEN 1 ELSE 0 END) AS hs FROM w WHERE len(ws) > 0),
e AS (SELECT doc_id, n, unnest(hs) AS hit, generate_subscripts(hs, 1) AS i FROM h),
s AS (SELECT doc_id, n, i, sum(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS score FROM e)
SELECT doc_id, CAST(score AS BIGINT) AS score, CASE WHEN n <= 25 THEN 0 ELSE i - 1 END AS at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM s WHERE i <= greatest(n - 24, 1)) WHERE r = 1""",
    "preview_region": """SELECT doc_id, start, md5(substring(text, start, 2000)) AS region_md5, start > 1 AS cut_before, start + 2000 <= length(text) AS cut_after
FROM (SELECT doc_id, text, greatest(1, CASE WHEN a > 0 AND b > 0 THEN least(a, b) ELSE a + b END - 40) AS start FROM (SELECT doc_id, text, instr(lower(text), 'tion') AS a, instr(lower(text), 'eau') AS b FROM documents))""",
    "preview": f"""WITH w AS (SELECT doc_id, {SPLIT} AS ws FROM documents), e AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
s AS (SELECT doc_id, i, n, sum(CASE WHEN contains(lower(x), 'tion') OR contains(lower(x), 'eau') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS score FROM e),
b AS (SELECT doc_id, n, arg_max(i, (score, -i)) - 1 AS begin_ FROM s WHERE i <= greatest(n - 24, 1) GROUP BY 1, 2)
SELECT w.doc_id, md5(CASE WHEN len(ws) = 0 THEN '' ELSE CASE WHEN begin_ > 0 THEN '…' ELSE '' END || array_to_string(list_slice(ws, begin_ + 1, begin_ + 25), ' ') || CASE WHEN begin_ + 25 < n THEN '…' ELSE '' END END) AS preview_md5 FROM w LEFT JOIN b USING (doc_id)""",
    "jaccard_sentence": f"""WITH c AS (SELECT item_id AS claim_id, list_distinct({tok("text")}) AS b FROM benchmark),
s AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '[.;:\\n]') AS ss FROM documents)),
t AS (SELECT doc_id, pos, list_distinct({tok("text")}) AS a FROM s WHERE length(trim(text)) >= 20),
j AS (SELECT doc_id, pos, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS score FROM t JOIN c ON claim_id = doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, score, pos AS at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM j) WHERE r = 1""",
    "chunk_counts": f"SELECT doc_id, {COUNT.format(130, 100)} AS n_index, {COUNT.format(350, 275)} AS n_title FROM (SELECT doc_id, len({SPLIT}) AS n FROM documents)",
    "chunk_index": f"""WITH w AS (SELECT doc_id, ws, unnest(range(0, CAST({COUNT.format(130, 100)} AS BIGINT))) AS chunk FROM (SELECT doc_id, {SPLIT} AS ws, len({SPLIT}) AS n FROM documents))
SELECT doc_id, chunk, len(c) AS n_words, sha256(array_to_string(c, ' ')) AS content_hash FROM (SELECT doc_id, chunk, list_slice(ws, chunk * 100 + 1, chunk * 100 + 130) AS c FROM w)""",
    "titled_chunks": f"""WITH w AS (SELECT doc_id, source, ws, unnest(range(0, CAST({COUNT.format(350, 275)} AS BIGINT))) AS chunk FROM (SELECT doc_id, source, {SPLIT} AS ws, len({SPLIT}) AS n FROM documents))
SELECT doc_id, chunk, md5(source || chr(10) || chr(10) || array_to_string(list_slice(ws, chunk * 275 + 1, chunk * 275 + 350), ' ')) AS text_md5 FROM w""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "snapshot_id": "SELECT sha256(string_agg(h, '' ORDER BY part)) AS snapshot FROM (SELECT doc_id // 1000 AS part, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1)",
    "exact_duplicates": "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "page_furniture": "SELECT source, md5(line) AS line_md5, count(*) AS n FROM (SELECT DISTINCT source, doc_id, unnest([ls[1], ls[-1]]) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE length(line) <= 160 GROUP BY source, line HAVING count(*) >= 3",
    "token_estimates": "SELECT doc_id, greatest(1, (length(text) + 3) // 4) AS up, greatest(1, length(text) // 4) AS down FROM documents",
    "canonical_text": "SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS canonical_md5, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed_md5 FROM documents",
    "url_canonical": "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '^http://', 'https://'), '[/.,;:)]+$', '') AS canonical FROM pages",
    "slug_collisions": """SELECT turn_id, slug || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS handle FROM (SELECT turn_id, slug, row_number() OVER (PARTITION BY lower(slug) ORDER BY turn_id) AS r FROM (
SELECT conv_id * 10000 + turn AS turn_id, regexp_replace(left(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 12), '-+$', '') AS slug FROM conversations))""",
}
