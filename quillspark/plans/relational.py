"""Joins, windows, aggregates and quality queries over the driver's tables, with SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import spread, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def filter_metadata(frame: DataFrame, filters: dict[str, list[str]], allowed: tuple[str, ...]) -> DataFrame:
    """Rows that have one of the values, whatever its case, of every key; an unknown key is an error."""
    for key, values in filters.items():
        if key not in allowed:
            raise ValueError(f"unknown filter {key}")
        frame = frame.filter(F.lower(F.trim(key)).isin(*(v.strip().lower() for v in values)))
    return frame


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return filter_metadata(docs, {"lang": ["EN", "fr "], "source": ["SRC1", "src2", "Src3"]}, ("lang", "source"))


SQL_FILTER = "SELECT doc_id, lang, source FROM documents WHERE lower(trim(lang)) IN ('en', 'fr') AND lower(trim(source)) IN ('src1', 'src2', 'src3')"


def latest(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order: a grouped maximum, so rows are combined before the shuffle."""
    rest = [c for c in frame.columns if c not in keys and c not in order]
    top = frame.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return top.select(*keys, *(f"m.{c}" for c in [*order, *rest]))


def latest_version_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


SQL_LATEST = "SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


def block_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return docs.filter("line <> ''").select("doc_id", "ord", F.length("line").alias("n_chars"), F.sha2(F.col("line").cast("binary"), 256).alias("text_hash"))


SQL_BLOCKS = "SELECT doc_id, i::INT AS ord, length(line)::INT AS n_chars, sha256(line) AS text_hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE line <> ''"


def windows_of(lengths, least: int = 2, most: int = 7, chars: int = 2800):
    """(first, k, n_chars) of the runs of least to most neighbours whose lengths sum to chars at most."""
    n = F.size(lengths)
    runs = F.transform(
        F.sequence(F.lit(least), F.least(F.lit(most), n)),
        lambda k: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.alias("first"), k.alias("k"), F.aggregate(F.slice(lengths, i + 1, k), F.lit(0), lambda a, x: a + x).alias("n_chars"))),
    )
    return F.when(n >= least, F.filter(F.flatten(runs), lambda r: r["n_chars"] <= chars))


def neighbor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(lines, lambda x: F.length(x)).alias("lengths")).filter(F.size("lengths") <= 1200)
    return docs.select("doc_id", F.inline(windows_of(F.col("lengths"))))


SQL_WINDOWS = """
WITH b AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: length(x)) AS l FROM documents), c AS (
  SELECT doc_id, l, unnest(range(2, least(7, len(l)) + 1)) AS k FROM b WHERE len(l) BETWEEN 2 AND 1200
), r AS (SELECT doc_id, l, k, unnest(range(0, len(l) - k + 1)) AS i FROM c)
SELECT doc_id, i::INT AS first, k::INT AS k, list_sum(l[i + 1:i + k])::INT AS n_chars FROM r WHERE list_sum(l[i + 1:i + k]) <= 2800
"""


def duplicates(frame: DataFrame, key: str, content: str) -> DataFrame:
    """key, first: rows whose content an earlier key has. The first keys are a table of their own that joins the rows."""
    firsts = frame.groupBy(content).agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return frame.join(firsts, content).filter(F.col(key) > F.col("first")).select(key, "first")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are normalised and hashed once; the table of hashes is grouped and joined."""
    plain = F.lower(T.normalize_space(F.col("text")))
    return duplicates(stored(table(spark, sf_dir, "documents").select("doc_id", F.sha2(plain.cast("binary"), 256).alias("content")), "contents"), "doc_id", "content")


SQL_DUPLICATES = r"""
WITH d AS (SELECT doc_id, sha256(lower(coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), ''))) AS h FROM documents)
SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM d) WHERE doc_id > first
"""


def duplicate_ids_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")).filter("n > 1")


SQL_HAVING = "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def orphan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label refers to, and customers without an order."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    one = docs.join(labels, "doc_id", "left_anti").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    return one.unionByName(customers.join(orders, "c_custkey", "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")))


SQL_ORPHANS = "SELECT 'document' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"


def traceable_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("hit", F.lit(1))
    joined = docs.join(labels, "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("n_traceable"), F.bround(F.count("hit") / F.count("*"), 8).alias("ratio"))


SQL_TRACEABLE = "SELECT source, count(*) AS n, count(l.doc_id) AS n_traceable, round_even(count(l.doc_id) / count(*), 8) AS ratio FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source"

#: reason code, hard or soft, recommended action.
POLICY = (("document.content.too_short", "soft", "warn"), ("document.content.too_long", "soft", "warn"), ("document.content.duplicate", "soft", "quarantine"), ("document.quality.low", "hard", "quarantine"), ("document.toxicity.flagged", "hard", "reject"))


def _signals(spark: SparkSession, sf_dir: str, copies: DataFrame | None = None) -> DataFrame:
    copies = exact_duplicates(spark, sf_dir) if copies is None else copies
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    labels = table(spark, sf_dir, "labels")
    parts = [
        (docs.filter("n < 40"), 0, F.col("n").cast("string")),
        (docs.filter("n > 8000"), 1, F.col("n").cast("string")),
        (copies, 2, F.col("first").cast("string")),
        (labels.filter("quality = 0"), 3, F.lit("0")),
        (labels.filter("toxic = 1"), 4, F.lit("1")),
    ]
    rows = [p.select("doc_id", F.lit(POLICY[k][0]).alias("reason_code"), v.alias("actual_value")) for p, k, v in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def quality_signals_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).withColumn("signal_id", T.stable_id("signal", F.col("doc_id"), F.col("reason_code"), F.col("actual_value")))


SQL_SIGNALS_BODY = f"""
  SELECT doc_id, 'document.content.too_short' AS reason_code, length(text)::VARCHAR AS actual_value FROM documents WHERE length(text) < 40
  UNION ALL SELECT doc_id, 'document.content.too_long', length(text)::VARCHAR FROM documents WHERE length(text) > 8000
  UNION ALL SELECT doc_id, 'document.content.duplicate', first::VARCHAR FROM ({SQL_DUPLICATES})
  UNION ALL SELECT doc_id, 'document.quality.low', '0' FROM labels WHERE quality = 0
  UNION ALL SELECT doc_id, 'document.toxicity.flagged', '1' FROM labels WHERE toxic = 1
"""
SQL_SIGNALS = f"SELECT *, 'signal_' || substr(sha256(doc_id || chr(10) || reason_code || chr(10) || actual_value), 1, 16) AS signal_id FROM ({SQL_SIGNALS_BODY})"


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY, "reason_code string, severity string, recommended_action string")


def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals meet the policy's few rows; in observe mode an action takes effect as warn or allow."""
    joined = _signals(spark, sf_dir).join(F.broadcast(policy_table(spark)), "reason_code")
    effective = F.when(F.col("recommended_action") == "warn", "warn").otherwise("allow")
    return joined.groupBy("severity", "recommended_action", effective.alias("effective_action")).agg(F.count("*").alias("n_decisions"), F.countDistinct("doc_id").alias("n_documents"))


_SQL_POLICY = "(VALUES " + ", ".join(map(str, POLICY)) + ") p(reason_code, severity, recommended_action)"
SQL_DECISIONS = f"SELECT severity, recommended_action, CASE WHEN recommended_action = 'warn' THEN 'warn' ELSE 'allow' END AS effective_action, count(*) AS n_decisions, count(DISTINCT doc_id) AS n_documents FROM ({SQL_SIGNALS_BODY}) JOIN {_SQL_POLICY} USING (reason_code) GROUP BY ALL"


def quarantine_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a hard signal, and the duplicates of such, each once; a direct decision wins."""
    found = stored(exact_duplicates(spark, sf_dir), "copies")
    hard = _signals(spark, sf_dir, found).join(F.broadcast(policy_table(spark)), "reason_code").filter("recommended_action <> 'warn'").select("doc_id").distinct()
    copies = found.join(hard.withColumnRenamed("doc_id", "first"), "first").select("doc_id", F.lit(1).alias("source"))
    rows = hard.withColumn("source", F.lit(0)).unionByName(copies)
    return rows.groupBy("doc_id").agg(F.when(F.min("source") == 0, "direct").otherwise("propagated").alias("via"))


SQL_QUARANTINE = f"""
WITH h AS (SELECT DISTINCT doc_id FROM ({SQL_SIGNALS_BODY}) JOIN {_SQL_POLICY} USING (reason_code) WHERE recommended_action <> 'warn'), r AS (
  SELECT doc_id, 0 AS source FROM h UNION ALL SELECT doc_id, 1 FROM ({SQL_DUPLICATES}) WHERE first IN (SELECT doc_id FROM h)
)
SELECT doc_id, CASE WHEN min(source) = 0 THEN 'direct' ELSE 'propagated' END AS via FROM r GROUP BY doc_id
"""


def page_char_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters on each page of 1000 that a document's lines touch: every line counts on all its pages."""
    starts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    running = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = starts.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(running), F.lit(0)))
    first, last = F.floor(F.col("start") / 1000), F.floor((F.col("start") + F.greatest(F.length("line"), F.lit(1)) - 1) / 1000)
    pages = placed.select("doc_id", F.explode(F.sequence(first, last)).alias("page"), F.length("line").cast("long").alias("n"))
    return pages.groupBy("doc_id", "page").agg(F.sum("n").alias("n_chars"))


SQL_PAGES = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), p AS (
  SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l
), x AS (SELECT doc_id, unnest(range(start // 1000, (start + greatest(length(line), 1) - 1) // 1000 + 1)) AS page, length(line) AS n FROM p)
SELECT doc_id, page, sum(n)::BIGINT AS n_chars FROM x GROUP BY ALL
"""


def per_document_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    best = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return lines.withColumn("position", F.row_number().over(best)).filter("position <= 2")


SQL_CAP = "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)::INT AS position FROM lineitem) WHERE position <= 2"


def last_turns(turns: DataFrame, keep: int = 6, cut: int = 500) -> DataFrame:
    """The last messages of each conversation; what the assistant said is cut short."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    text = F.when(F.col("role") == "assistant", F.substring("text", 1, cut)).otherwise(F.col("text"))
    return turns.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= keep).select("conv_id", "turn", "role", text.alias("text"))


def conversation_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_turns(table(spark, sf_dir, "conversations"))


SQL_TURNS = "SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN substr(text, 1, 500) ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6"


def section_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive events of one type of each user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    ev = ev.withColumn("new", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(order))).cast("int"))
    ev = ev.withColumn("island", F.sum("new").over(order))
    return ev.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


SQL_ISLANDS = """
WITH a AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS new FROM events), b AS (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM a
)
SELECT user_id, island, event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM b GROUP BY user_id, island, event_type
"""


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left's rows with the value of right's last row of the key at or before at: a union and one window, no inequality join."""
    rest = [c for c in left.columns if c not in (key, at)]
    both = left.select(key, at, F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), *rest)
    both = both.unionByName(right.select(key, at, F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(before))
    return found.filter("_side = 1").select(key, at, *rest, F.col("_found").alias(value))


def asof_section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click at or before it."""
    ev = table(spark, sf_dir, "events")
    return as_of(ev.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), ev.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id")), "user_id", "ts", "click_id")


SQL_ASOF = """
SELECT p.user_id, p.ts, p.event_id, (SELECT max_by(c.event_id, (c.ts, c.event_id)) FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts) AS click_id
FROM events p WHERE p.event_type = 'purchase'
"""


def corpus_term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that the corpus covers, whatever the language: weighted share of known terms of 0.6, and enough of them."""
    known = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("term")).distinct().withColumn("hit", F.lit(1))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("term"))
    w = T.term_weight(F.col("term"))
    per = items.join(known, "term", "left").groupBy("item_id").agg(F.count("*").alias("n_terms"), F.count("hit").alias("n_known"), F.round(F.coalesce(F.sum(F.when(F.col("hit") == 1, w)), F.lit(0.0)) / F.sum(w), 6).alias("coverage"))
    enough = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("n_terms") / 2)))
    return per.withColumn("covered", (F.col("coverage") >= 0.6) & (F.col("n_known") >= enough))


SQL_GAP = r"""
WITH k AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_./=-]+'), lambda x: length(x) >= 2)) AS term FROM documents), i AS (
  SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_./=-]+'), lambda x: length(x) >= 2))) AS term FROM benchmark
), w AS (
  SELECT i.*, k.term IS NOT NULL AS hit, CASE WHEN length(i.term) >= 12 THEN 4.2::DOUBLE WHEN length(i.term) >= 6 THEN 2.6::DOUBLE ELSE 1.6::DOUBLE END AS w FROM i LEFT JOIN k USING (term)
), p AS (SELECT item_id, count(*) AS n_terms, count(*) FILTER (WHERE hit) AS n_known, round(coalesce(sum(w) FILTER (WHERE hit), 0) / sum(w), 6) AS coverage FROM w GROUP BY item_id)
SELECT *, coverage >= 0.6 AND n_known >= greatest(1, least(3, n_terms // 2)) AS covered FROM p
"""

#: Cue words of each intent, in order of precedence.
CUES = (("troubleshooting", ("error", "fail", "pas ", "nicht", "wh")), ("api", ("()", "api", "ou ")), ("inventory", ("all ", "list", "que ")), ("mechanism", ("how", "why", "tion")))


def detect_intent(text, cues=CUES):
    low = F.lower(text)
    out = F.lit("general")
    for name, words in reversed(cues):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def intent_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", detect_intent(F.col("text")).alias("intent"))


SQL_INTENT = "SELECT conv_id, turn, CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in words)} THEN '{name}'" for name, words in CUES) + " ELSE 'general' END AS intent FROM conversations WHERE role = 'user'"

PHRASES = ("the that", "de la", "und die", "Licensed under", "on with the")


def phrase_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that a document holds, exactly or by all their words; the phrases are a fixed short list."""
    low = F.lower(T.normalize_space(F.col("text")))
    docs = table(spark, sf_dir, "documents").select("doc_id", low.alias("low"))
    found = F.array_compact(F.array(*(F.when(T.contains_phrase(F.col("low"), F.lit(p)), p) for p in PHRASES)))
    return docs.select("doc_id", F.explode(found).alias("phrase"))


SQL_PHRASES = (
    r"WITH d AS (SELECT doc_id, lower(coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '')) AS low FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS phrase FROM d WHERE contains(low, '{p.lower()}') OR ({' AND '.join(f'''contains(low, '{w}')''' for w in p.lower().split())})" for p in PHRASES)
)


def ab_stats_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups paired by customer in one grouped pass, without a self-join: means, wins and relative reduction."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    price = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.round(F.col("o_totalprice") * 100).cast("long")))
    pairs = orders.groupBy("o_custkey").agg(price("F").alias("a"), price("O").alias("b")).filter("a is not null and b is not null")
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("b") < F.col("a")).alias("n_wins"), F.count_if(F.col("a") == F.col("b")).alias("n_ties"), F.round((F.sum("a") - F.sum("b")) / F.sum("a"), 6).alias("reduction"))


SQL_AB = """
WITH p AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT) FILTER (WHERE o_orderstatus = 'F') AS a, sum(round(o_totalprice * 100)::BIGINT) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey)
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE b < a) AS n_wins, count(*) FILTER (WHERE a = b) AS n_ties, round((sum(a) - sum(b))::DOUBLE / sum(a)::DOUBLE, 6) AS reduction FROM p WHERE a IS NOT NULL AND b IS NOT NULL
"""


def parser_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    cents = lambda c: F.avg(F.round(F.col(c) * 100).cast("long"))
    card = lines.groupBy(F.col("l_returnflag").alias("parser")).agg(F.countDistinct("l_orderkey").alias("n_documents"), cents("l_quantity").alias("q"), cents("l_discount").alias("d"), cents("l_tax").alias("t"), F.count_if(F.col("l_discount") > 0.09).alias("n_failures"))
    score = F.round((F.col("q") + F.col("d") + F.col("t")) / 300, 6)
    return card.select("parser", "n_documents", "n_failures", score.alias("score"), ((F.col("n_documents") >= 100) & (F.col("n_failures") < 2000)).alias("passed"))


SQL_SCORECARD = """
WITH c AS (SELECT l_returnflag AS parser, count(DISTINCT l_orderkey) AS n_documents, avg(round(l_quantity * 100)::BIGINT) AS q, avg(round(l_discount * 100)::BIGINT) AS d, avg(round(l_tax * 100)::BIGINT) AS t, count(*) FILTER (WHERE l_discount > 0.09::DOUBLE) AS n_failures FROM lineitem GROUP BY 1)
SELECT parser, n_documents, n_failures, round((q + d + t) / 300, 6) AS score, n_documents >= 100 AND n_failures < 2000 AS passed FROM c
"""


def traceable_pairs_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    side = lambda s: orders.filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderpriority")
    return side("F").intersect(side("O"))


SQL_INTERSECT = "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'"


def evidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by line: its id, document, and the number of documents that share its text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).filter("line <> ''")
    lines = lines.select("doc_id", "ord", F.sha2(F.col("line").cast("binary"), 256).alias("text_hash"))
    shared = lines.groupBy("text_hash").agg(F.countDistinct("doc_id").alias("n_documents")).filter("n_documents > 1")
    traced = lines.join(shared, "text_hash")
    return traced.select(T.stable_id("span", F.col("doc_id"), F.col("ord"), F.col("text_hash")).alias("evidence_id"), "doc_id", "n_documents")


SQL_TRACE = """
WITH l AS (SELECT * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE line <> ''), s AS (
  SELECT sha256(line) AS h, count(DISTINCT doc_id) AS n_documents FROM l GROUP BY 1 HAVING count(DISTINCT doc_id) > 1
)
SELECT 'span_' || substr(sha256(doc_id || chr(10) || i || chr(10) || h), 1, 16) AS evidence_id, doc_id, n_documents FROM l JOIN s ON sha256(l.line) = s.h
"""


def diff_state(now: DataFrame, state: DataFrame, key: str, content: str) -> DataFrame:
    """key and status: new, changed, unchanged or gone, by a full outer join of content hashes."""
    joined = now.select(key, F.col(content).alias("_n")).join(state.select(key, F.col(content).alias("_s")), key, "full_outer")
    status = F.when(F.col("_s").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("_n") == F.col("_s"), "unchanged").otherwise("changed")
    return joined.select(key, status.alias("status"))


def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents against a state that knows labelled ones alone, with stale contents where quality is 0."""
    now = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    state = table(spark, sf_dir, "labels").join(now, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "stale").otherwise(F.col("h")).alias("h"))
    return diff_state(now, state, "doc_id", "h")


SQL_DIFF = "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)"


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


SQL_JSON = "SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL"


def document_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts joined with small dimensions: revenue by region and segment."""
    c, o, n, r = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation", "region"))
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(geo, c.c_nationkey == geo.n_nationkey)
    return j.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n_orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


SQL_DIMENSIONS = "SELECT r_name, c_mktsegment, count(*) AS n_orders, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and gate status, with means of lengths."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels")
    status = F.when(F.col("quality").isNull(), "unknown").when((F.col("quality") == 0) | (F.col("toxic") == 1), "blocked").otherwise("ok")
    j = docs.join(labels, "doc_id", "left").withColumn("status", status)
    return j.groupBy("lang", "status").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


SQL_ROLLUP = "SELECT lang, CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 0 OR toxic = 1 THEN 'blocked' ELSE 'ok' END AS status, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, min(n_chars) AS least, max(n_chars) AS most FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "metadata_filter": (metadata_filter, SQL_FILTER),
    "latest_version_per_key": (latest_version_per_key, SQL_LATEST),
    "block_explode": (block_explode, SQL_BLOCKS),
    "neighbor_windows": (neighbor_windows, SQL_WINDOWS),
    "exact_duplicates": (exact_duplicates, SQL_DUPLICATES),
    "duplicate_ids_having": (duplicate_ids_having, SQL_HAVING),
    "orphan_references": (orphan_references, SQL_ORPHANS),
    "traceable_ratio": (traceable_ratio, SQL_TRACEABLE),
    "quality_signals_union": (quality_signals_union, SQL_SIGNALS),
    "policy_decisions": (policy_decisions, SQL_DECISIONS),
    "quarantine_propagation": (quarantine_propagation, SQL_QUARANTINE),
    "page_char_sums": (page_char_sums, SQL_PAGES),
    "per_document_cap": (per_document_cap, SQL_CAP),
    "conversation_last_turns": (conversation_last_turns, SQL_TURNS),
    "section_islands": (section_islands, SQL_ISLANDS),
    "asof_section_lookup": (asof_section_lookup, SQL_ASOF),
    "corpus_term_coverage": (corpus_term_coverage, SQL_GAP),
    "phrase_containment": (phrase_containment, SQL_PHRASES),
    "ab_stats_pairing": (ab_stats_pairing, SQL_AB),
    "parser_scorecard": (parser_scorecard, SQL_SCORECARD),
    "traceable_pairs_intersect": (traceable_pairs_intersect, SQL_INTERSECT),
    "intent_cues": (intent_cues, SQL_INTENT),
    "evidence_trace": (evidence_trace, SQL_TRACE),
    "incremental_diff": (incremental_diff, SQL_DIFF),
    "json_props": (json_props, SQL_JSON),
    "document_dimensions": (document_dimensions, SQL_DIMENSIONS),
    "status_rollup": (status_rollup, SQL_ROLLUP),
}
