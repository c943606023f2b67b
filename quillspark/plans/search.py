"""Queries of text search over documents, with SQL for each.

A unit is a document; its title is doc-<id>. Nothing is exploded where only a query's few terms count: term
frequencies are taken from each row's own token array, so a ranking needs one scan, a one-row aggregate and a top-k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import spread, stored

QUERY = "the onerth inea tion"
TERMS = T.search_tokens_of(QUERY)

SQL_TOKENS = r"list_filter(regexp_extract_all(lower(text), '[a-z0-9_./=-]+'), lambda x: length(x) >= 2)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, text and the tokens of both."""
    docs = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("title"), "text")
    return docs.withColumn("tokens", T.search_tokens(F.concat_ws("\n", "title", "text")))


def times(tokens: Column, term: str) -> Column:
    return (F.size(tokens) - F.size(F.array_remove(tokens, term))).cast("double")


def bm25(frame: DataFrame, terms: dict[str, int]) -> DataFrame:
    """frame: tokens. Adds bm25 by the statistics of all rows of frame."""
    counted = frame.withColumn("dl", F.size("tokens").cast("double"))
    for k, term in enumerate(sorted(terms)):
        counted = counted.withColumn(f"tf{k}", times(F.col("tokens"), term))
    return bm25_of(counted, terms).select(*frame.columns, "bm25")


def bm25_of(counted: DataFrame, terms: dict[str, int]) -> DataFrame:
    """counted: dl, and tf0, tf1, ... of the terms in order. Adds bm25 by the statistics of all rows."""
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{k}") > 0).cast("double")).alias(f"df{k}") for k in range(len(terms))))
    scored = counted.crossJoin(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for k, term in enumerate(sorted(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        part = idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl"))) * (terms[term] * T.term_weight_of(term))
        total = total + F.when(tf > 0, part).otherwise(0.0)
    return scored.select(*counted.columns, total.alias("bm25"))


def bm25_topk(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    scored = bm25(units(spark, sf_dir), TERMS).filter("bm25 > 0")
    return scored.select("doc_id", "title", F.round("bm25", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def _sql_terms(one: str, glue: str) -> str:
    return glue.join(one.format(k=k, t=t, q=TERMS[t], w=T.term_weight_of(t)) for k, t in enumerate(sorted(TERMS)))


SQL_BM25 = f"""
WITH u AS (
  SELECT doc_id, 'doc-' || doc_id AS title, {SQL_TOKENS.replace('text', "('doc-' || doc_id || chr(10) || text)")} AS tokens FROM documents
), c AS (
  SELECT doc_id, title, len(tokens)::DOUBLE AS dl, {_sql_terms("len(list_filter(tokens, lambda x: x = '{t}'))::DOUBLE AS tf{k}", ", ")} FROM u
), s AS (
  SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {_sql_terms("sum((tf{k} > 0)::INT)::DOUBLE AS df{k}", ", ")} FROM c
), r AS (
  SELECT doc_id, title, {_sql_terms("CASE WHEN tf{k} > 0 THEN ln(1 + (n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) * (tf{k} * 2.2::DOUBLE) / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * ({q} * {w}::DOUBLE) ELSE 0 END", " + ")} AS bm25 FROM c, s
)
SELECT doc_id, title, round(bm25, 6) AS score FROM r WHERE bm25 > 0 ORDER BY score DESC, doc_id LIMIT 20
"""


def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = units(spark, sf_dir).select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n_units"))


SQL_DF = f"""
SELECT term, count(*) AS n_units FROM (
  SELECT unnest(list_distinct({SQL_TOKENS.replace('text', "('doc-' || doc_id || chr(10) || text)")})) AS term FROM documents
) GROUP BY term
"""


def lexical_score(frame: DataFrame, terms: dict[str, int], title: str = "title", sections: str | None = None, leaf: str | None = None) -> Column:
    """Weighted counts (three at most) of the terms, with a bonus where title, last section or sections contain one."""
    total = F.lit(0.0)
    for term in sorted(terms):
        w, tf = T.term_weight_of(term), times(F.col("tokens"), term)
        part = w * F.least(tf, F.lit(3.0)) * terms[term] + F.when(F.lower(F.col(title)).contains(term), w * 1.5).otherwise(0.0)
        if leaf:
            part = part + F.when(F.lower(F.col(leaf)).contains(term), w * 2.5).otherwise(0.0)
        if sections:
            part = part + F.when(F.lower(F.col(sections)).contains(term), w * 1.5).otherwise(0.0)
        total = total + F.when(tf > 0, part).otherwise(0.0)
    return total


def lexical_score_topk(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    frame = units(spark, sf_dir)
    scored = frame.select("doc_id", F.round(lexical_score(frame, TERMS), 6).alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


SQL_LEXICAL = f"""
WITH u AS (
  SELECT doc_id, 'doc-' || doc_id AS title, {SQL_TOKENS.replace('text', "('doc-' || doc_id || chr(10) || text)")} AS tokens FROM documents
), r AS (
  SELECT doc_id, {_sql_terms("CASE WHEN list_contains(tokens, '{t}') THEN {w}::DOUBLE * least(len(list_filter(tokens, lambda x: x = '{t}'))::DOUBLE, 3) * {q} + CASE WHEN contains(title, '{t}') THEN {w}::DOUBLE * 1.5::DOUBLE ELSE 0 END ELSE 0 END", " + ")} AS s FROM u
)
SELECT doc_id, round(s, 6) AS score FROM r WHERE s > 0 ORDER BY score DESC, doc_id LIMIT 20
"""


def match_all(frame: DataFrame, query: str) -> DataFrame:
    """Rows of frame whose tokens have every term of the query, whole or as a beginning."""
    for term, prefix in T.match_terms(query):
        frame = frame.filter(_has_beginning(term) if prefix else F.array_contains("tokens", term))
    return frame


def _has_beginning(term: str) -> Column:
    return F.exists("tokens", lambda t: t.startswith(term))


def prefix_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+"), F.lit(0))
    return match_all(documents(spark, sf_dir).select("doc_id", words.alias("tokens")), "oner ing th").select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


SQL_MATCH = r"""
WITH u AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens FROM u
WHERE len(list_filter(w, lambda x: starts_with(x, 'oner'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'ing'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0
"""


def feature_table(frame: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, feature and weight: the summed sparse features of a text column."""
    return T.feature_weights(frame, key, F.col("text"))


def feature_frequencies(features: DataFrame) -> DataFrame:
    return features.groupBy("feature").agg(F.count("*").alias("df"))


_FEATURES = r"""
  SELECT {key}, feature, sum(w) AS weight FROM (
    SELECT {key}, 'ascii:' || t AS feature, CASE WHEN length(t) >= 12 THEN 2.4::DOUBLE WHEN length(t) >= 6 THEN 1.8::DOUBLE ELSE 1.2::DOUBLE END AS w
    FROM (SELECT {key}, unnest({tokens}) AS t FROM {table})
    UNION ALL
    SELECT {key}, 'ascii:' || p, 0.7::DOUBLE FROM (SELECT {key}, unnest(string_split(t, '_')) AS p FROM (SELECT {key}, unnest({tokens}) AS t FROM {table}) WHERE contains(t, '_')) WHERE length(p) >= 2
  ) GROUP BY ALL
"""


def feature_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_frequencies(feature_table(documents(spark, sf_dir).select("doc_id", "text")))


SQL_FEATURE_DF = f"SELECT feature, count(*) AS df FROM ({_FEATURES.format(key='doc_id', tokens=SQL_TOKENS, table='documents')}) GROUP BY feature"


QUERY_EVERY = 50
#: Features that are sent to every executor with their frequencies, and the characters of the longest of them.
COMMON, LONGEST_COMMON = 100_000, 100
#: Rows in a block of vectors, as queries and as rows searched.
BLOCK = 2048


def _vector_blocks(vectors: DataFrame) -> DataFrame:
    """ids and unit vectors (float64, row by row) of up to BLOCK rows of vec_id and embedding; ids ascend in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                part = whole.slice(at, BLOCK).sort_by("vec_id")
                e = np.array(part.column("embedding").to_pylist(), np.float64)
                u = e / np.maximum(np.sqrt((e * e).sum(axis=1, keepdims=True)), 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([u.tobytes()], pa.binary())], names=["ids", "vectors"])

    return vectors.mapInArrow(run, "ids array<long>, vectors binary")


def _block_hits(pairs: DataFrame, k: int) -> DataFrame:
    """pairs: a block of queries (asked, q) beside a block of rows (ids, vectors). The k best rows of the block for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                asked, ids = np.array(r["asked"], np.int64), np.array(r["ids"], np.int64)
                q, v = np.frombuffer(r["q"]).reshape(len(asked), -1), np.frombuffer(r["vectors"]).reshape(len(ids), -1)
                s = np.round(q @ v.T, 5)
                least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(asked), -2.0)
                row, col = np.nonzero(s >= least[:, None])
                order = np.lexsort((col, -s[row, col], row))
                row, col = row[order], col[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[best], col[best]
                yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(ids[col]), pa.array(s[row, col])], names=["query_id", "vec_id", "similarity"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, similarity double")


def first_of_each(hits: DataFrame, key: str, hit: str, k: int) -> DataFrame:
    """The k most similar hits of each key, ties by hit; Spark limits each group before the shuffle too."""
    best = Window.partitionBy(key).orderBy(F.desc("similarity"), hit)
    return hits.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


def dense_cosine_search(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """For every vector whose number is divisible by 50 the vectors nearest to it, among all, ties by number."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").filter("vec_id is not null and embedding is not null")
    queries = _vector_blocks(v.filter(F.col("vec_id") % QUERY_EVERY == 0)).select(F.col("ids").alias("asked"), F.col("vectors").alias("q"))
    # Either side can be written to a shuffle, so neither is packed anew for each block of the other.
    pairs = _vector_blocks(v).crossJoin(queries.repartition(F.xxhash64("asked")))
    return first_of_each(_block_hits(pairs, k), "query_id", "vec_id", k)


SQL_DENSE_SEARCH = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (
  SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 5) AS similarity FROM embeddings, q WHERE embedding IS NOT NULL AND e IS NOT NULL
)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 10
"""


def sparse_cosine_search(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """For every benchmark item whose number is divisible by 50 the documents most like it by idf-weighted sparse vectors."""
    features = stored(feature_table(documents(spark, sf_dir).select("doc_id", "text")), "features")
    n = documents(spark, sf_dir).count()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter(F.col("item_id") % QUERY_EVERY == 0).select("item_id", "text")
    asked = feature_table(items, "item_id").withColumnRenamed("weight", "a")
    known = asked.groupBy("feature").agg(F.collect_list(F.struct("item_id", "a")).alias("asked"))
    df = feature_frequencies(features).withColumn("idf", F.log(1 + (F.lit(float(n)) + 1) / (F.col("df") + 1)))
    df = stored(df.join(known, "feature", "left"), "frequencies")
    # The commonest features, nearly all rows, meet their frequencies without a shuffle; the other rows by a join that shuffles them.
    common = F.broadcast(df.filter(F.length("feature") <= LONGEST_COMMON).orderBy(F.desc("df"), "feature").limit(COMMON))
    pairs = features.join(common, "feature").unionByName(features.join(common.select("feature"), "feature", "left_anti").join(df, "feature"))
    # A row without an item for each feature of a document sums to its squared length; one pass makes lengths and products.
    itself = F.array(F.struct(F.lit(None).cast("long").alias("item_id"), F.col("weight").alias("a")))
    pairs = pairs.select("doc_id", (F.col("weight") * F.col("idf") * F.col("idf")).alias("w"), F.inline(F.concat(itself, F.coalesce("asked", F.array().cast("array<struct<item_id:bigint,a:double>>")))))
    sums = pairs.groupBy("doc_id", "item_id").agg(F.sum(F.col("w") * F.col("a")).alias("dot"))
    sums = sums.withColumn("ww", F.max(F.when(F.col("item_id").isNull(), F.col("dot"))).over(Window.partitionBy("doc_id"))).filter("item_id is not null and dot > 0")
    norms = asked.join(df.select("feature", "idf"), "feature", "left").groupBy("item_id").agg(F.sum((F.col("a") * F.coalesce("idf", F.lit(1.0))) ** 2).alias("qq"))
    similarity = F.round(F.col("dot") / (F.sqrt("ww") * F.sqrt("qq")), 6).alias("similarity")
    return first_of_each(sums.join(norms, "item_id").select("item_id", "doc_id", similarity), "item_id", "doc_id", k)


SQL_SPARSE_SEARCH = f"""
WITH f AS ({_FEATURES.format(key="doc_id", tokens=SQL_TOKENS, table="documents")}
), df AS (
  SELECT feature, ln(1 + ((SELECT count(*) FROM documents)::DOUBLE + 1) / (count(*) + 1)) AS idf FROM f GROUP BY feature
), b AS ({_FEATURES.format(key="item_id", tokens=SQL_TOKENS, table="(SELECT * FROM benchmark WHERE item_id % 50 = 0)")}
), q AS (
  SELECT item_id, feature, weight * coalesce(idf, 1) AS q FROM b LEFT JOIN df USING (feature)
), w AS (
  SELECT doc_id, feature, weight * idf AS w FROM f JOIN df USING (feature)
), s AS (
  SELECT item_id, doc_id, sum(w * q) AS dot FROM w JOIN q USING (feature) GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, doc_id, round(dot / (sqrt(ww) * sqrt(qq)), 6) AS similarity FROM s
  JOIN (SELECT doc_id, sum(w * w) AS ww FROM w GROUP BY doc_id) USING (doc_id) JOIN (SELECT item_id, sum(q * q) AS qq FROM q GROUP BY item_id) USING (item_id) WHERE dot > 0
)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) <= 10
"""


def rank_bonus(hits: DataFrame, scale: float, weight: Column, extra: Column | None = None) -> DataFrame:
    """hits: variant, id, position (from 1). The largest bonus weight * scale / position**2 of each id over its variants."""
    bonus = weight * scale / (F.col("position") * F.col("position"))
    return hits.groupBy("id").agg(F.max(bonus if extra is None else bonus + extra).alias("bonus"))


def hybrid_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and BM25 ranks (the first 50 of each), turned into bonuses, of which a document has the larger, first 20."""
    frame = bm25(units(spark, sf_dir), TERMS)
    frame = stored(frame.select("doc_id", "bm25", lexical_score(frame, TERMS).alias("lexical")), "scores")
    parts = []
    for variant, (column, scale, weight) in enumerate((("bm25", 72.0, 1.0), ("lexical", 54.0, 2.0))):
        top = frame.filter(F.col(column) > 0).select(F.col("doc_id").alias("id"), F.round(column, 6).alias("s")).orderBy(F.desc("s"), "id").limit(50)
        ranked = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("s"), "id")).cast("double"))  # 50 rows
        parts.append(rank_bonus(ranked.withColumn("variant", F.lit(variant)), scale, F.lit(weight)))
    both = parts[0].unionByName(parts[1]).groupBy("id").agg(F.round(F.max("bonus"), 6).alias("bonus"))
    return both.select(F.col("id").alias("doc_id"), "bonus").orderBy(F.desc("bonus"), "doc_id").limit(20)


SQL_FUSION = f"""
WITH b AS ({SQL_BM25.replace('LIMIT 20', 'LIMIT 50')}), l AS ({SQL_LEXICAL.replace('LIMIT 20', 'LIMIT 50')}), x AS (
  SELECT doc_id, 72.0::DOUBLE / (row_number() OVER (ORDER BY score DESC, doc_id) ** 2) AS bonus FROM b
  UNION ALL SELECT doc_id, 108.0::DOUBLE / (row_number() OVER (ORDER BY score DESC, doc_id) ** 2) FROM l
)
SELECT doc_id, round(max(bonus), 6) AS bonus FROM x GROUP BY doc_id ORDER BY bonus DESC, doc_id LIMIT 20
"""


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.chunk_tokens(F.col("text")).alias("chunk_tokens"), T.pack_tokens(F.col("text")).alias("pack_tokens"))


SQL_ESTIMATES = r"""
WITH c AS (
  SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]', '', 'g')) AS a, length(regexp_replace(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]', '', 'g')) AS b FROM documents
)
SELECT doc_id, greatest(1, (n - a) + a // 4)::BIGINT AS chunk_tokens, floor((n - b) * 1.6::DOUBLE + b / 4.0::DOUBLE)::BIGINT AS pack_tokens FROM c
"""


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("doc-"), F.col("doc_id"))
    ids = documents(spark, sf_dir).select("doc_id", T.stable_id("doc", title, F.col("source"), F.lit(None).cast("string")).alias("document_id"), F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    return ids.withColumn("document_version_id", T.stable_id("docver", F.col("document_id"), F.lit("v1"), F.col("file_hash")))


SQL_IDS = """
WITH d AS (SELECT doc_id, 'doc_' || substr(sha256('doc-' || doc_id || chr(10) || coalesce(source, 'None') || chr(10) || 'None'), 1, 16) AS document_id, sha256(text) AS file_hash FROM documents)
SELECT *, 'docver_' || substr(sha256(document_id || chr(10) || 'v1' || chr(10) || file_hash), 1, 16) AS document_version_id FROM d
"""


def identifier_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+|[A-Za-z0-9.-]+@[A-Za-z0-9.-]+"), F.lit(0))
    return documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(names)).alias("name"))


SQL_NAMES = r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+|[A-Za-z0-9.-]+@[A-Za-z0-9.-]+'))) AS name FROM documents"


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", T.normalize_space(F.col("text")).alias("plain"), T.slugify(F.col("text")).alias("slug"), T.summarize(F.col("text")).alias("summary"))


SQL_NORMALIZED = r"""
WITH n AS (
  SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents
), s AS (
  SELECT *, array_to_string(l, chr(10)) AS plain, array_to_string(l[1:3], ' ') AS line, trim(regexp_replace(text, '[^0-9A-Za-z\x{4E00}-\x{9FFF}]+', '-', 'g'), '-') AS sl FROM n
)
SELECT doc_id, coalesce(plain, '') AS plain, CASE WHEN sl = '' THEN 'item' ELSE sl END AS slug,
       CASE WHEN length(coalesce(line, '')) <= 180 THEN coalesce(line, '') ELSE rtrim(substr(line, 1, 179)) || '…' END AS summary
FROM s
"""


def text_layer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("doc_id", T.text_layer_quality(F.col("text")).alias("q")).select("doc_id", "q.*")
    return found.withColumns({"suspects_per_1k_cjk": F.round("suspects_per_1k_cjk", 6), "latin1_ratio": F.round("latin1_ratio", 6), "reason_codes": F.array_join("reason_codes", ",")})


SQL_LAYER = rf"""
WITH n AS (
  SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') AS p FROM documents
), c AS (
  SELECT doc_id, length(p)::INT AS char_count, (length(p) - length(regexp_replace(p, '[\x{{4E00}}-\x{{9FFF}}]', '', 'g')))::INT AS cjk_count,
         (length(p) - length(regexp_replace(p, '[{T.LATIN1_MOJIBAKE}]', '', 'g')))::INT AS l, (length(p) - length(regexp_replace(p, '[\x{{3040}}-\x{{30FF}}]', '', 'g')))::INT AS k FROM n
), r AS (
  SELECT *, l + k AS suspect_count, CASE WHEN cjk_count > 0 THEN (l + k) * 1000.0::DOUBLE / cjk_count ELSE 0 END AS s, CASE WHEN char_count > 0 THEN l::DOUBLE / char_count ELSE 0 END AS q FROM c
)
SELECT doc_id, char_count, cjk_count, suspect_count, round(s, 6) AS suspects_per_1k_cjk, round(q, 6) AS latin1_ratio,
       concat_ws(',', CASE WHEN char_count < 40 THEN 'text_too_short' END, CASE WHEN cjk_count >= 20 AND suspect_count >= 3 AND s > 50 THEN 'mojibake_suspect_ratio_high' END,
                 CASE WHEN char_count >= 40 AND cjk_count < 20 AND q > 0.12 THEN 'latin1_mojibake_ratio_high' END) AS reason_codes
FROM r
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "bm25_topk": (bm25_topk, SQL_BM25),
    "term_document_frequency": (term_document_frequency, SQL_DF),
    "lexical_score_topk": (lexical_score_topk, SQL_LEXICAL),
    "prefix_and_match": (prefix_and_match, SQL_MATCH),
    "feature_document_frequency": (feature_document_frequency, SQL_FEATURE_DF),
    "dense_cosine_search": (dense_cosine_search, SQL_DENSE_SEARCH),
    "sparse_cosine_search": (sparse_cosine_search, SQL_SPARSE_SEARCH),
    "hybrid_rank_fusion": (hybrid_rank_fusion, SQL_FUSION),
    "token_estimates": (token_estimates, SQL_ESTIMATES),
    "stable_ids": (stable_ids, SQL_IDS),
    "identifier_extraction": (identifier_extraction, SQL_NAMES),
    "normalized_text": (normalized_text, SQL_NORMALIZED),
    "text_layer_quality": (text_layer_quality, SQL_LAYER),
}
