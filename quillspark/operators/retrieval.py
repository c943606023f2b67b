"""Hybrid retrieval: units and merged windows, indexes, scoring, diversified selection, and budgeted packs.

Everything up to a query's candidates is a DataFrame plan over whole tables: filters, statistics, one wide
projection, and a top-k. What is sequential by nature (a selection whose every step depends on the earlier
ones) runs over at most `pool` candidates of one query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.search import bm25, bm25_of, match_all
from ..slices import in_slices, schema_of, tidied
from ..storage import stored
from .documents import MOST_CHUNKS, runs, section_titles

# Fixed values.
FTS_SCALE, VECTOR_SCALE, VECTOR_LIKENESS, SHARED = 72.0, 54.0, 32.0, 0.95
NORMATIVE = ("应", "不应", "不得", "必须", "shall", "must", "requires", "required")
DIRECT = ("应采取", "不应直接", "应对", "应不可", "必须", "不得", "shall", "must")


def any_of(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


# --- units ---


def merged_windows(chunks: DataFrame) -> DataFrame:
    """Runs of 2 to 7 neighbouring chunks of a document with MOST_CHARS characters at most, as units of their own (see runs()).

    chunks: document_version_id, chunk_ord, chunk_id, text, section_path, section_titles, evidence_ids. A task reads
    documents as a sorted stream and holds the chunks of one, MOST_CHUNKS + 1 at most.
    """
    frame = chunks.select("document_version_id", "chunk_ord", "chunk_id", "text", "section_path", "section_titles", "evidence_ids")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**c, "document_version_id": version} for c in found], schema)

        version, held, schema, known = None, [], None, False
        for whole in batches:
            schema = whole.schema
            for batch in in_slices(whole, 3):
                for c in batch.to_pylist():
                    if not known or c["document_version_id"] != version:
                        if held:
                            yield made(runs(version, held))
                        version, held, known = c["document_version_id"], [], True
                    if len(held) <= MOST_CHUNKS:
                        held.append(c)
        if held:
            yield made(runs(version, held))

    return frame.repartition("document_version_id").sortWithinPartitions("document_version_id", "chunk_ord").mapInArrow(run, schema_of(frame))


def search_units(chunks: DataFrame, sections: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks and merged windows with titles, metadata, gate and tokens; all but tokens is as stored."""
    maps = sections.filter("title <> 'Document'").groupBy("document_version_id").agg(F.map_from_entries(F.collect_list(F.struct(F.array_join("section_path", "."), "title"))).alias("_titles"))
    named = chunks.join(maps, "document_version_id", "left")
    titles = F.when(F.col("_titles").isNotNull(), section_titles(F.col("section_path"), F.col("_titles"))).otherwise(F.array().cast("array<string>"))
    base = named.select("document_version_id", "chunk_ord", "chunk_id", "text", "section_path", titles.alias("section_titles"), "evidence_ids")
    units = base.unionByName(merged_windows(base)).join(versions, "document_version_id")
    whole = F.concat_ws("\n", "title", F.array_join("section_titles", "\n"), "text")
    return units.withColumn("tokens", T.search_tokens(whole))


# --- indexes ---


def postings(units: DataFrame) -> DataFrame:
    """term, chunk_id and tf: the full-text index as a table."""
    terms = units.select("chunk_id", F.explode("tokens").alias("term"))
    return terms.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def sparse_index(units: DataFrame, concepts: tuple = ()) -> DataFrame:
    return T.feature_weights(units, "chunk_id", F.concat_ws("\n", "title", F.array_join("section_titles", "\n"), "text"), concepts)


def sparse_hits(index: DataFrame, n_units: int, query: str, limit: int, concepts: tuple = ()) -> DataFrame:
    """chunk_id, similarity: the nearest units by idf-weighted cosine; frequencies count every unit."""
    spark = index.sparkSession
    idf = index.groupBy("feature").agg(F.log(1 + (F.lit(float(n_units)) + 1) / (F.count("*") + 1)).alias("idf"))
    asked = T.feature_weights(spark.createDataFrame([(0, query)], "id int, text string"), "id", F.col("text"), concepts)
    asked = asked.withColumnRenamed("weight", "q").join(idf, "feature", "left").select("feature", (F.col("q") * F.coalesce("idf", F.lit(1.0))).alias("q"))
    scored = index.join(idf, "feature").join(F.broadcast(asked), "feature", "left").withColumn("w", F.col("weight") * F.col("idf"))
    sums = scored.groupBy("chunk_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    length = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    found = sums.filter("dot > 0").crossJoin(F.broadcast(length)).select("chunk_id", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("similarity"))
    return found.orderBy(F.desc("similarity"), "chunk_id").limit(limit)


def fts_hits(units: DataFrame, query: str, limit: int) -> DataFrame:
    """chunk_id, position: units with all the query's terms by BM25, ties by id."""
    if not T.match_terms(query):
        return units.select("chunk_id", F.lit(1.0).alias("position")).limit(0)
    found = match_all(bm25(units, T.search_tokens_of(query)), query).select("chunk_id", "bm25").orderBy(F.desc("bm25"), "chunk_id").limit(limit)
    return found.withColumn("position", F.row_number().over(Window.orderBy(F.desc("bm25"), "chunk_id")).cast("double")).drop("bm25")  # limit rows


def ranked_hits(facts: DataFrame, variant: int, terms: dict[str, int], places: dict[str, int], limit: int) -> DataFrame:
    """chunk_id, position: units with all the terms that a variant must match, by BM25, ties by id. facts: as facts() gives them."""
    found = bm25_of(counted(facts, terms, places), terms).filter(F.array_contains("matched", variant))
    found = found.select("chunk_id", "bm25").orderBy(F.desc("bm25"), "chunk_id").limit(limit)
    return found.withColumn("position", F.row_number().over(Window.orderBy(F.desc("bm25"), "chunk_id")).cast("double")).drop("bm25")  # limit rows


def bonuses(facts: DataFrame, variants: Sequence[tuple[str, float]], places: dict[str, int], limit: int, vectors: DataFrame | None = None) -> DataFrame:
    """chunk_id, bonus: the best of all variants' rank bonuses and of the vector index, shared by common evidence."""
    parts = []
    for n, (text, weight) in enumerate(variants):
        hits = ranked_hits(facts, n, T.search_tokens_of(text), places, limit)
        parts.append(hits.select("chunk_id", (F.lit(FTS_SCALE * weight) / (F.col("position") ** 2)).alias("bonus")))
    if vectors is not None:
        ranked = vectors.withColumn("_p", F.row_number().over(Window.orderBy(F.desc("similarity"), "chunk_id")).cast("double"))
        parts.append(ranked.select("chunk_id", (VECTOR_SCALE / (F.col("_p") ** 2) + VECTOR_LIKENESS * F.col("similarity")).alias("bonus")))
    own = parts[0]
    for p in parts[1:]:
        own = own.unionByName(p)
    own = own.groupBy("chunk_id").agg(F.max("bonus").alias("bonus"))
    spans = facts.select("chunk_id", F.explode("evidence_ids").alias("evidence_id"))
    strong = spans.join(own, "chunk_id").groupBy("evidence_id").agg((F.max("bonus") * SHARED).alias("bonus"))
    shared = spans.join(strong, "evidence_id").select("chunk_id", "bonus")
    return own.unionByName(shared).groupBy("chunk_id").agg(F.max("bonus").alias("bonus"))


# --- scores ---


def coherence(text: Column) -> Column:
    plain = T.normalize_space(text)
    early = F.length(F.substring(plain, 1, 12)) - F.length(F.replace(F.substring(plain, 1, 12), F.lit(" "), F.lit("")))
    parts = F.when(plain.rlike(r"^[#0-9一-鿿]"), 1.2).otherwise(0.0) + F.when(plain.rlike(r"^[a-z]"), -2.0).otherwise(0.0) + F.when(plain.rlike(r"^[`_\-.,]"), -1.5).otherwise(0.0) + F.when(early > 4, -0.5).otherwise(0.0)
    return F.when(plain == "", -3.0).otherwise(parts)


def structure(text: Column) -> Column:
    low = F.lower(T.normalize_space(text))
    bullets = F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"^\s*[-*]")))
    rules = (
        (any_of(low, ("get /", "post /")), 1.6),
        (low.contains("runtime_"), 1.2),
        (any_of(low, ("默认策略", "默认创建", "第一版必须坚持", "禁止")), 1.0),
        (any_of(low, ("验收", "回滚", "灰度", "feature flag")), 0.8),
        (any_of(low, ("应", "不应", "必须", "不得", "shall", "must")), 1.4),
        (text.rlike(r"(?:^|\n)\s*\d+(?:\.\d+){1,4}\s*[一-鿿A-Za-z]"), 1.6),
        (bullets >= 3, 0.8),
    )
    total = F.lit(0.0)
    for hit, value in rules:
        total = total + F.when(hit, value).otherwise(0.0)
    return F.when(low == "", 0.0).otherwise(total)


def contents_list(text: Column) -> Column:
    """A table of contents: its marker early, five heading-like lines or more, mostly short lines, and no rule."""
    lines = F.filter(F.split(T.normalize_space(text), "\n"), lambda x: ~F.lower(x).rlike(r"^page\s+\d+$"))
    headed = F.size(F.filter(lines, lambda x: x.rlike(r"^(?:(?:\d+(?:\.\d+){0,4}|[A-Z]\.\d+(?:\.\d+)*)\s*[一-鿿A-Za-z]|附录|[Aa]ppendix|(?:前言|范围|规范性引用文件|术语和定义)$)")))
    brief = F.size(F.filter(lines, lambda x: (F.length(x) <= 32) & ~x.rlike("[。.；;]$")))
    marked = F.exists(F.slice(lines, 1, 6), lambda x: x.isin("目录", "目次", "contents"))
    return marked & (headed >= 5) & (brief >= 0.6 * F.size(lines)) & ~any_of(text, DIRECT)


def evidence_quality(text: Column, titles: Column) -> Column:
    """What the text is worth as evidence: rules and direct answers add, lists of contents and appendices take away."""
    plain = T.normalize_space(text)
    appendix = F.exists(titles, lambda t: t.rlike(r"^(?:附录|[Aa]ppendix)")) | plain.rlike(r"^(?:附录|[Aa]ppendix)\s*[A-Z0-9]")
    rules = F.size(F.filter(F.split(plain, "\n"), lambda line: any_of(line, NORMATIVE)))
    body = F.least(F.lit(28.0), rules * 5.5) + F.when(any_of(plain, DIRECT), 8.0).otherwise(0.0)
    marker = plain.rlike(r"(?i)^(?:page\s+)?\d+$")
    score = F.when(contents_list(plain), -34.0).otherwise(0.0) + F.when(appendix, -16.0).otherwise(body) + F.when(marker, -12.0).otherwise(0.0)
    return F.when(plain == "", -8.0).otherwise(score)


def thinness(text: Column, title: Column, titles: Column, tokens: Column) -> Column:
    plain = F.lower(T.normalize_space(text))
    leaf = F.lower(T.normalize_space(F.coalesce(F.try_element_at(titles, F.lit(-1)), F.lit(""))))
    few = ~plain.contains("\n") & (F.size(F.array_distinct(T.search_tokens(text))) <= 4)
    return F.when(plain == "", -2.0).when(plain == F.lower(T.normalize_space(title)), -4.0).when((leaf != "") & (plain == leaf), -3.0).when(few, -2.0).otherwise(0.0)


# The same of one text in Python: a unit's facts are made in one pass.


def holds_any(text: str, words: Sequence[str]) -> bool:
    return any(w in text for w in words)


def coherence_of(plain: str) -> float:
    """plain, here and below: a text as T.normalized gives it."""
    if not plain:
        return -3.0
    first = plain[0]
    begins = (1.2 if first in "#0123456789" or "一" <= first <= "鿿" else 0.0) + (-2.0 if "a" <= first <= "z" else 0.0) + (-1.5 if first in "`_-.," else 0.0)
    return begins + (-0.5 if plain.count(" ", 0, 12) > 4 else 0.0)


BULLET, NUMBERED = re.compile(r"^\s*[-*]", re.ASCII), re.compile(r"(?:^|\n)\s*\d+(?:\.\d+){1,4}\s*[一-鿿A-Za-z]", re.ASCII)
HEADED = re.compile(r"(?:\d+(?:\.\d+){0,4}|[A-Z]\.\d+(?:\.\d+)*)\s*[一-鿿A-Za-z]|附录|[Aa]ppendix|(?:前言|范围|规范性引用文件|术语和定义)\Z", re.ASCII)
APPENDIX, APPENDIX_TITLE = re.compile(r"(?:附录|[Aa]ppendix)\s*[A-Z0-9]", re.ASCII), re.compile(r"附录|[Aa]ppendix")
PAGE_LINE, MARKER = re.compile(r"page\s+\d+", re.ASCII), re.compile(r"(?:page\s+)?\d+", re.ASCII | re.IGNORECASE)


def structure_of(text: str, low: str) -> float:
    """low: the plain text in lower case."""
    if not low:
        return 0.0
    rules = (
        (holds_any(low, ("get /", "post /")), 1.6),
        ("runtime_" in low, 1.2),
        (holds_any(low, ("默认策略", "默认创建", "第一版必须坚持", "禁止")), 1.0),
        (holds_any(low, ("验收", "回滚", "灰度", "feature flag")), 0.8),
        (holds_any(low, ("应", "不应", "必须", "不得", "shall", "must")), 1.4),
        ("." in text and NUMBERED.search(text) is not None, 1.6),
        (text.count("-") + text.count("*") >= 3 and sum(BULLET.match(line) is not None for line in text.split("\n")) >= 3, 0.8),
    )
    return sum(value for hit, value in rules if hit)


def contents_list_of(plain: str) -> bool:
    """A table of contents: its marker early, five heading-like lines or more, mostly short lines, and no rule."""
    lines = [x for x in plain.split("\n") if not PAGE_LINE.fullmatch(x.lower())]
    if not any(x in ("目录", "目次", "contents") for x in lines[:6]) or holds_any(plain, DIRECT):
        return False
    brief = sum(len(x) <= 32 and x[-1:] not in ("。", ".", "；", ";") for x in lines)
    return sum(HEADED.match(x) is not None for x in lines) >= 5 and brief >= 0.6 * len(lines)


def evidence_quality_of(plain: str, titles: Sequence[str]) -> float:
    """What the text is worth as evidence: rules and direct answers add, lists of contents and appendices take away."""
    if not plain:
        return -8.0
    if any(APPENDIX_TITLE.match(t) for t in titles if t) or APPENDIX.match(plain):
        body = -16.0
    else:
        rules = sum(holds_any(line, NORMATIVE) for line in plain.split("\n")) if holds_any(plain, NORMATIVE) else 0
        body = min(28.0, rules * 5.5) + (8.0 if holds_any(plain, DIRECT) else 0.0)
    return (-34.0 if contents_list_of(plain) else 0.0) + body + (-12.0 if MARKER.fullmatch(plain) else 0.0)


def thinness_of(text: str, plain: str, low: str, title: str | None, leaf: str) -> float:
    """low: plain in lower case; title and leaf (the last section's title) likewise."""
    if not plain:
        return -2.0
    if low == title:
        return -4.0
    if leaf and low == leaf:
        return -3.0
    return -2.0 if "\n" not in plain and few_tokens(text) else 0.0


def few_tokens(text: str, most: int = 4) -> bool:
    """Whether a text has so many distinct search tokens at most; reading ends once it has more."""
    seen: set[str] = set()
    return not any(len(seen) > most for t in T.search_tokens_in(text) if seen.add(t) is None)


def term_score(counts: dict[str, int], terms: dict[str, int], title: str, sections: str, leaf: str) -> float:
    """plans.search.lexical_score of one unit; titles in lower case, counts of its tokens."""
    total = 0.0
    for term in sorted(terms):
        if n := counts.get(term):
            w = T.term_weight_of(term)
            total += w * min(n, 3.0) * terms[term] + (w * 1.5 if term in title else 0.0) + (w * 2.5 if term in leaf else 0.0) + (w * 1.5 if term in sections else 0.0)
    return total


def gate_penalty(allowed: Column, score: Column) -> Column:
    """0 where the gate lets a document through, else the more the lower its parse score is."""
    return F.when(allowed, 0.0).when(score.isNull(), -24.0).when(score >= 40, -4.0).when(score >= 25, -42.0).when(score >= 10, -56.0).otherwise(-80.0)


@dataclass
class Query:
    text: str
    top_k: int = 8
    per_document: int = 3
    variants: list[tuple[str, float]] = field(default_factory=list)

    @property
    def clauses(self) -> list[str]:
        return T.clauses_of(T.normalized(self.text))

    @property
    def probe_limit(self) -> int:
        return max(20, self.top_k * max(4, self.per_document))

    @property
    def pool(self) -> int:
        return max(30 * self.top_k, 300)


def facts(units: DataFrame, query: Query, texts: Sequence[str], places: dict[str, int]) -> DataFrame:
    """units without tokens, with what a query's scores need of each, made in one pass over the texts.

    Added: dl (its tokens), tf (by places, of the terms of all texts), matched (numbers of the texts all of whose terms
    it has), parts (the terms of the score that other units don't change) and clause_hits. Tokens are those of title,
    section titles and text, or of a column tokens where there is one.
    """
    names = [c for c in units.columns if c != "tokens"]
    given = "tokens" in units.columns
    terms, clauses = T.search_tokens_of(query.text), [T.search_tokens_of(c) for c in query.clauses]
    wanted, matches = sorted({*places, *terms, *(t for c in clauses for t in c)}), [T.match_terms(t) for t in texts]

    def of(row: dict, tokens: list[str] | None) -> tuple[int, list[float], list[int], float, list[int]]:
        text, titles, title = row["text"] or "", row["section_titles"] or [], row["title"]
        whole = "\n".join([*([] if title is None else [title]), *(t for t in titles if t is not None), text]).lower()
        words = list(T.search_tokens_in(whole)) if tokens is None else tokens
        counts = {t: n for t in wanted if (tokens is not None or t in whole) and (n := words.count(t))}
        matched = []
        for n, asked in enumerate(matches):
            # A token's beginning stands in the text that the tokens are of.
            if asked and all((tokens is not None or t in whole) and (any(w.startswith(t) for w in words) if prefix else t in words) for t, prefix in asked):
                matched.append(n)
        plain = T.normalized(text)
        low, last = plain.lower(), (titles[-1] or "") if titles else ""
        heads = ((title or "").lower(), "\n".join(t for t in titles if t is not None).lower(), last.lower())
        part = term_score(counts, terms, *heads) + coherence_of(plain) + structure_of(text, low) + evidence_quality_of(plain, titles)
        part += thinness_of(text, plain, low, None if title is None else T.normalized(title).lower(), T.normalized(last).lower())
        hits = []
        for n, asked in enumerate(clauses):
            score = term_score(counts, asked, *heads) if counts else 0.0
            if score >= 2.0 or (score > 0 and len(asked) <= 3):
                hits.append(n)
        return len(words), [float(counts.get(t, 0)) for t in places], matched, part, hits

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.float64(), pa.list_(pa.int32()))
        for whole in batches:
            for batch in in_slices(whole, names.index("text")):
                rows = batch.select(["text", "section_titles", "title"]).to_pylist()
                tokens = batch.column(len(names)).to_pylist() if given else [None] * len(rows)
                found = [*zip(*map(of, rows, tokens), strict=True)] or [()] * 5
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(v, t) for v, t in zip(found, kinds, strict=True))], names=[*names, "dl", "tf", "matched", "parts", "clause_hits"])

    added = "dl double, tf array<double>, matched array<int>, parts double, clause_hits array<int>"
    return units.select(*names, *(["tokens"] if given else [])).mapInArrow(run, f"{schema_of(units.select(*names))}, {added}")


def counted(found: DataFrame, terms: dict[str, int], places: dict[str, int]) -> DataFrame:
    """facts with a column of frequencies for each of the terms in order, as bm25_of reads them."""
    return found.withColumns({f"tf{k}": F.element_at("tf", places[term] + 1) for k, term in enumerate(sorted(terms))})


def scored(units: DataFrame, query: Query, vectors: DataFrame | None = None) -> DataFrame:
    """units with score and clause_hits: the sum of lexical, BM25, bonus, text and gate terms."""
    terms = T.search_tokens_of(query.text)
    best: dict[str, float] = {}
    for text, weight in [(query.text, 1.0), *query.variants]:
        best[text] = max(weight, best.get(text, 0.0))
    variants = sorted(best.items())
    places = {t: k for k, t in enumerate(sorted({t for text in best for t in T.search_tokens_of(text)}))}
    # Statistics, hits and scores read the table of facts, not the texts; only candidates' texts are read again.
    found = stored(facts(units, query, [text for text, _ in variants], places), "facts")
    extra = bonuses(found, variants, places, query.probe_limit, vectors)
    rows = bm25_of(counted(found, terms, places), terms).join(extra, "chunk_id", "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    # The gate is soft: what an index found passes, and if nothing would pass, all does.
    rows = rows.withColumn("_pass", F.coalesce("allowed", F.lit(True)) | (F.col("bonus") > 0))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.bool_or("_pass").alias("_some")))).filter("_pass or not _some")
    total = F.col("parts") + F.col("bm25") + F.col("bonus") + gate_penalty(F.coalesce("allowed", F.lit(True)), F.col("quality_score"))
    return rows.select(*(c for c in units.columns if c != "tokens"), F.round(total, 6).alias("score"), "clause_hits")


def candidates(units: DataFrame, query: Query, vectors: DataFrame | None = None) -> DataFrame:
    rows = scored(units, query, vectors)
    return rows.orderBy(F.desc("score"), F.desc(F.size("clause_hits")), "title", F.array_join("section_path", "."), "chunk_id").limit(query.pool)


# --- selection ---

#: What a clause, a topic and a subfacet that nothing chosen has, and a document without a choice, add to a candidate's score; what an earlier choice of its document takes.
NEW_CLAUSE, NEW_TOPIC, NEW_SUBFACET, NEW_DOCUMENT, SAME_DOCUMENT, ANY_CLAUSE = 18.0, 12.0, 8.0, 6.0, 5.0, 1.5


@dataclass(frozen=True)
class Topic:
    """A subject that a question may ask for: words that speak of it, and subfacets by name with their words."""

    name: str
    words: tuple[str, ...]
    subfacets: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def asked(self, text: str) -> bool:
        return any(w in text for w in self.words)

    def facets(self, text: str) -> set[tuple[str, str]]:
        return {(self.name, facet) for facet, words in self.subfacets if any(w in text for w in words)}


class Candidate:
    """A candidate with what comparisons need, made once."""

    def __init__(self, row: dict, place: int, topics: Sequence[Topic]):
        self.row, self.place, self.document = row, place, row["document_version_id"]
        self.text = T.normalized(row["text"]).lower()
        self.clauses, self.evidence, self.tokens = frozenset(row["clause_hits"]), frozenset(row["evidence_ids"]), frozenset(T.search_tokens_of(self.text))
        whole = "\n".join([*row.get("section_titles", ()), row["text"]]).lower()
        self.topics = frozenset(t.name for t in topics if t.asked(whole))
        self.facets = frozenset().union(*(t.facets(whole) for t in topics if t.name in self.topics))

    def repeats(self, other: Candidate) -> bool:
        """Within one document: equal text, like words in one section, containment of longer texts, or mostly shared evidence."""
        if self.document != other.document:
            return False
        short, long = sorted((self.text, other.text), key=len)
        rules = (
            lambda: short == long,
            lambda: len(short) >= 40 and short in long,
            lambda: self.row["section_path"] == other.row["section_path"] and overlap(self.tokens, other.tokens) >= 0.8,
            lambda: overlap(self.evidence, other.evidence) >= 0.7,
        )
        return any(rule() for rule in rules)


def overlap(a: Collection, b: Collection) -> float:
    a, b = set(a), set(b)
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def is_duplicate(one: dict, other: dict) -> bool:
    return Candidate(one, 0, ()).repeats(Candidate(other, 1, ()))


class Selection:
    """Choices so far, and the candidates that are still open: each choice closes those that repeat it."""

    def __init__(self, pool: list[dict], query: Query, topics: Sequence[Topic]):
        self.query, low = query, query.text.lower()
        self.topics = [t for t in topics if t.asked(low)]
        self.missing = {f for t in self.topics for f in t.facets(low)}
        self.open = [Candidate(row, n, self.topics) for n, row in enumerate(pool)]
        self.repeating: set[int] = set()
        self.chosen: list[Candidate] = []
        self.clauses: set[int] = set()
        self.covered: set[str] = set()
        self.facets: set[tuple[str, str]] = set()
        self.per_document: Counter[str] = Counter()

    def admits(self, c: Candidate) -> bool:
        """A document's limit and repeats hold unless the candidate alone brings a subfacet that was asked for."""
        if c.facets & self.missing:
            full = self.per_document[c.document] >= self.query.per_document
            return not full or not any(o.facets & self.missing and self.per_document[o.document] < self.query.per_document for o in self.open)
        return c.place not in self.repeating and self.per_document[c.document] < self.query.per_document

    def worth(self, c: Candidate) -> float:
        seen = self.per_document[c.document]
        new = NEW_CLAUSE * len(c.clauses - self.clauses) + NEW_TOPIC * len(c.topics - self.covered) + NEW_SUBFACET * len(c.facets - self.facets)
        return c.row["score"] + new + (-SAME_DOCUMENT * seen if seen else NEW_DOCUMENT) + ANY_CLAUSE * len(c.clauses)

    def order(self, c: Candidate) -> tuple:
        """Of equal worth the first of the pool; once all clauses are covered, documents without a choice come first."""
        if len(self.clauses) < len(self.query.clauses):
            return (c.place,)
        return (bool(self.per_document[c.document]), -c.row["score"], -len(c.clauses), c.place)

    def take(self, options: list[Candidate]) -> bool:
        if not options:
            return False
        best = min(options, key=lambda c: (-self.worth(c), self.order(c)))
        self.open.remove(best)
        self.chosen.append(best)
        self.per_document[best.document] += 1
        self.clauses |= best.clauses
        self.covered |= best.topics
        self.facets |= best.facets
        self.missing -= best.facets
        self.repeating |= {c.place for c in self.open if c.place not in self.repeating and c.repeats(best)}
        return True

    def run(self) -> list[dict]:
        for topic in self.topics:  # a seed for each topic that the question asks for
            if len(self.chosen) < self.query.top_k and topic.name not in self.covered:
                self.take([c for c in self.open if topic.name in c.topics and self.admits(c)])
        while len(self.chosen) < self.query.top_k:
            options = [c for c in self.open if self.admits(c)]
            if not self.take([c for c in options if c.facets & self.missing] or options):
                break
        return [c.row for c in self.chosen]


def select(pool: list[dict], query: Query, topics: Sequence[Topic] = ()) -> list[dict]:
    """Greedy choice of top_k: scores with rewards for what is new and a charge for documents chosen before; the pool's beginning if nothing is admitted."""
    return Selection(pool, query, topics).run() or pool[: query.top_k]


# --- packs ---


def render(query: str, rows: list[dict], warnings: Sequence[str] = ()) -> str:
    """A pack as Markdown: a section for each run of chunks of one section, each chunk with its evidence."""
    out = [f"# {query}", *(f"> {w}" for w in warnings)]
    heading = None
    for n, r in enumerate(rows, 1):
        own = " / ".join([r["title"], *r["section_titles"]])
        if own != heading:
            out.append(f"\n## {own}")
            heading = own
        out.append(f"\n[{n}] {r['text']}\n\nevidence: {', '.join(r['evidence_ids'])}")
    return "\n".join(out)


def within_tokens(query: str, rows: list[dict], budget: int | None, warnings: Sequence[str] = ()) -> tuple[list[dict], list[str]]:
    """The longest beginning of rows whose rendering fits the budget, one row at least, and the warnings."""
    notes = list(warnings)
    if budget is None or not rows:
        return rows, notes
    keep = 1
    while keep < len(rows) and T.pack_tokens_of(render(query, rows[: keep + 1], notes)) <= budget:
        keep += 1
    if keep < len(rows):
        notes.append(f"token_budget_exceeded:dropped={len(rows) - keep}:budget={budget}")
    if keep == 1 and T.pack_tokens_of(render(query, rows[:1], notes)) > budget:
        notes.append("token_budget_too_small:kept_single_best_chunk")
    return rows[:keep], notes


@dataclass
class ContextPack:
    query: str
    chunks: list[dict]
    warnings: list[str]
    markdown: str


def context_pack(units: DataFrame, query: Query, *, budget: int | None = None, vectors: DataFrame | None = None, rerank: Callable[[list[dict]], list[dict]] | None = None, topics: Sequence[Topic] = ()) -> ContextPack:
    pool = [r.asDict(recursive=True) for r in candidates(units, query, vectors).collect()]  # at most query.pool rows
    rows = select(pool, query, topics)
    rows = rerank(rows) if rerank else rows
    notes = list(dict.fromkeys(f"quality_gate_bypassed:{r['document_version_id']}" for r in rows if r.get("allowed") is False))
    rows, notes = within_tokens(query.text, rows, budget, notes)
    return ContextPack(query.text, rows, notes, render(query.text, rows, notes))


def trace(evidence: DataFrame, chunks: DataFrame, versions: DataFrame, evidence_id: str) -> DataFrame:
    """The evidence with its document and the chunks that cite it."""
    found = evidence.filter(F.col("evidence_id") == evidence_id).select("evidence_id", "document_version_id", "block_id", F.col("text").alias("evidence_text"))
    citing = chunks.filter(F.array_contains("evidence_ids", evidence_id)).select("document_version_id", "chunk_id", "section_path")
    return found.join(versions, "document_version_id", "left").join(citing, "document_version_id", "left").orderBy("chunk_id")


def gap_report(items: DataFrame, pack: ContextPack) -> DataFrame:
    """items: item. covered and coverage by the pack's text: containment, or enough of the terms by weight."""
    body = T.normalized("\n".join(r["text"] for r in pack.chunks)).lower()
    known = items.sparkSession.createDataFrame([(t,) for t in sorted(T.search_tokens_of(body))], "term string")
    terms = items.select("item", F.explode_outer(F.array_distinct(T.search_tokens(F.col("item")))).alias("term"))
    w = T.term_weight(F.col("term"))
    per = terms.join(F.broadcast(known.withColumn("hit", F.lit(1))), "term", "left").groupBy("item").agg(F.count("term").alias("n"), F.count("hit").alias("m"), F.coalesce(F.sum(F.when(F.col("hit") == 1, w)) / F.sum(w), F.lit(0.0)).alias("coverage"))
    within = F.contains(F.lit(body), F.lower(T.normalize_space(F.col("item"))))
    enough = (F.col("coverage") >= 0.6) & (F.col("m") >= F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("n") / 2))))
    return per.select("item", F.round("coverage", 6).alias("coverage"), (within | enough).alias("covered"))


# --- planning ---

# Cues of each intent, in order of precedence.
INTENTS = (
    ("troubleshooting", ("报错", "失败", "异常", "崩溃", "error", "failed", "crash", "timeout")),
    ("api", ("函数", "接口", "api", "()", "参数", "返回值")),
    ("inventory", ("有哪些", "列出", "清单", "全部", "list all", "which")),
    ("mechanism", ("原理", "机制", "如何", "为什么", "how", "why")),
)


def intent_of(query: str, cues: Sequence[tuple[str, Sequence[str]]] = INTENTS) -> str:
    low = query.lower()
    return next((name for name, words in cues if any(w in low for w in words)), "general")


def remembered(memory: DataFrame, query: str, threshold: float = 0.5) -> DataFrame:
    """Entries of a retrieval memory whose patterns overlap the query; weight = 1 + 2 * score * confidence within 0.1 and 3."""
    spark = memory.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(T.memory_tokens(F.col("q")).alias("q"))
    rows = memory.withColumn("p", F.explode("user_patterns")).withColumn("p", T.memory_tokens(F.col("p"))).crossJoin(F.broadcast(asked))
    share = F.size(F.array_intersect("p", "q")) / F.greatest(F.lit(1), F.size("p"))
    best = rows.groupBy("memory_id", "confidence", "expanded_queries").agg(F.max(share).alias("score")).filter(F.col("score") >= threshold)
    weight = F.greatest(F.lit(0.1), F.least(F.lit(3.0), 1 + 2 * F.col("score") * F.col("confidence")))
    return best.withColumn("weight", weight).orderBy(F.desc(F.col("score") * F.greatest("confidence", F.lit(0.01))), "memory_id")


def plain_query(query: str) -> str:
    """A question without Markdown: heading marks, list marks and numbering go, lines stay."""
    lines = (re.sub(r"^(?:[-*]|\d+[.)])\s+", "", re.sub(r"^#+\s*", "", line.strip())) for line in query.splitlines())
    return T.normalized("\n".join(re.sub(r"[`*#>]", "", line) for line in lines)) or query.strip()


def reference_items(markdown: str) -> list[str]:
    """The list items of a reference answer, without marks and notes on evidence."""
    found = (re.match(r"(?:[-*]|\d+\.)\s+(.*)", line.strip()) for line in markdown.splitlines())
    items = (T.normalized(re.sub(r"[（(]\s*(?:证据|evidence)[^)）]*[)）]", "", m[1])) for m in found if m)
    return list(dict.fromkeys(i for i in items if i))


def query_variants(text: str, expansions: Sequence[tuple[str, float]] = (), planner: Callable[[str, str], Sequence[str]] | None = None) -> list[tuple[str, float]]:
    """The question and its expansions with the largest weight of each text, heaviest first; a planner's count 0.8."""
    best: dict[str, float] = {}
    extra = [(t, 0.8) for t in planner(text, intent_of(text))] if planner else []
    for t, w in [(text, 1.0), *expansions, *extra]:
        if t.strip():
            best[t.strip()] = max(w, best.get(t.strip(), 0.0))
    return sorted(best.items(), key=lambda x: -x[1])


def reranked(rows: list[dict], signals: Sequence[str]) -> list[dict]:
    """Stable order by how many of the signals a chunk's titles hold."""
    bonus = lambda r: sum(s in " ".join([r["title"], *r["section_titles"]]).lower() for s in signals)
    return sorted(rows, key=lambda r: -bonus(r))
