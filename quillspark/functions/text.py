"""Text expressions: normalising, identifiers, token estimates, tokenizers and weights.

Most are Column expressions, so they stay in the JVM; the same rules in Python serve queries, which are few
and short, on the driver. Sparse features are counted in Python, row by row in Arrow batches, which saves their shuffle.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..slices import in_slices, tidied

# Fixed values.
PLACEHOLDERS = ("", "待提供", "待填写", "待确认", "unknown", "none", "null", "n/a")
STOPGRAMS = ("如果", "哪些", "什么", "这个", "那个", "一下", "一个", "如何", "需要", "应该", "请综", "综合", "说明")
SYNONYMS = (("出境", "跨境", "境外", "海外"), ("审批", "评估", "审核", "批准"), ("限制", "约束", "要求", "规则"), ("风险", "隐患", "问题"))
BREAKS, BLANKS = r"\n\r\x0B\x0C\x1C-\x1E\x85", r" \t\x1F\xA0"
RARE_BREAKS, RARE_BLANKS = r"\x{2028}\x{2029}", r"\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
ASCII_TOKEN = r"[a-z0-9_./=-]+"
MEMORY_TOKEN = r"[a-z0-9_./-]+"
CJK_RUN = r"[一-鿿]+"
ALNUM = string.digits + string.ascii_letters
CLAUSE_BREAK = r"[，,。；;：:\n]+"


def normalize_space(text: Column) -> Column:
    """Lines with their blanks collapsed and ends trimmed, without empty lines."""

    def flat(breaks: str, blanks: str) -> Column:
        even = F.regexp_replace(text, f"[{blanks}]{{2,}}|[{blanks.removeprefix(' ')}]", " ")
        return F.trim(F.regexp_replace(even, f" ?[{breaks}][ {breaks}]*", "\n"), F.lit(" \n"))

    # Classes below 256 are bit sets to the regex engine; others are met only where a text has such characters.
    rare = text.rlike(r"[\x{1680}-\x{3000}]")
    return F.when(rare, flat(BREAKS + RARE_BREAKS, BLANKS + RARE_BLANKS)).otherwise(flat(BREAKS, BLANKS))


def normalized(text: str) -> str:
    lines = (" ".join(line.split()) for line in text.splitlines())
    return "\n".join(line for line in lines if line)


def slugify(value: Column, fallback: str = "item") -> Column:
    """Each run of other characters than ASCII letters, digits and CJK as one dash, none at either end; null stays null."""

    def dashed(kept: str) -> Column:
        return F.trim(F.regexp_replace(value, f"[^{kept}]+", "-"), F.lit("-"))

    # Single characters are a bit set to the regex engine, ranges aren't; the fallback's test ends at the first one kept.
    return F.when(value.rlike(CJK_RUN), dashed(ALNUM + "一-鿿")).when(value.rlike("[0-9A-Za-z]"), dashed(ALNUM)).when(value.isNotNull(), fallback)


def as_text(part: Column | str | bool | int | None, kind: str = "string") -> Column:
    """A part of an id as it is written in one: None, True and False by these words."""
    if not isinstance(part, Column):
        return F.lit(str(part))
    if kind == "boolean":
        return F.when(part, "True").when(~part, "False").otherwise("None")
    return F.coalesce(part.cast("string"), F.lit("None"))


def stable_id(prefix: str, *parts: Column | str, length: int = 16) -> Column:
    raw = F.concat_ws("\n", *(as_text(p) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(raw.cast("binary"), 256), 1, length))


def stable_id_of(prefix: str, *parts: object, length: int = 16) -> str:
    return f"{prefix}_{hashlib.sha256(chr(10).join(map(str, parts)).encode()).hexdigest()[:length]}"


def is_placeholder(value: Column) -> Column:
    return value.isNull() | F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")).isin(*PLACEHOLDERS)


def count_class(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def chunk_tokens(text: Column) -> Column:
    """Estimate for chunk budgets: one a CJK, kana or Hangul character, one for four others, one at least."""
    wide = count_class(text, r"一-鿿぀-ヿ가-힯")
    return F.greatest(F.lit(1), wide + F.floor((F.length(text) - wide) / 4)).cast("long")


def wide_chars(text: str) -> int:
    return 0 if text.isascii() else len(re.findall("[一-鿿぀-ヿ가-힯]", text))


def chunk_tokens_of(text: str) -> int:
    wide = wide_chars(text)
    return max(1, wide + (len(text) - wide) // 4)


def pack_tokens(text: Column) -> Column:
    """Estimate for pack budgets: 1.6 a CJK character or mark, a quarter for others, cut to a whole number."""
    wide = count_class(text, r"一-鿿㐀-䶿　-〿＀-￯")
    return F.floor(wide * F.lit(1.6) + (F.length(text) - wide) / F.lit(4.0)).cast("long")


def pack_tokens_of(text: str) -> int:
    wide = len(re.findall("[一-鿿㐀-䶿　-〿＀-￯]", text))
    return int(wide * 1.6 + (len(text) - wide) / 4)


def cjk_grams(run: Column, stop: tuple[str, ...], longest: int = 4, whole: int = 8) -> Column:
    """Runs of 2 to longest characters in a CJK run, and the run itself where it has whole characters at most."""
    n = F.length(run)
    sizes = F.sequence(F.lit(2), F.least(F.lit(longest), n))
    grams = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), n - s + 1), lambda i: F.substring(run, i, s))))
    grams = F.when(n <= whole, F.concat(grams, F.array(run))).otherwise(grams)
    return F.filter(grams, lambda g: ~g.isin(*stop)) if stop else grams


def _runs(low: Column, pattern: str) -> Column:
    """Runs of two characters or more of a class; blanks end a run, so text needn't be normalised first."""
    return F.regexp_extract_all(low, F.lit(f"{pattern.rstrip('+')}{{2,}}"), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Tokens, repeats kept, of text that is lower-cased here."""
    low = F.lower(text)
    return F.concat(_runs(low, ASCII_TOKEN), F.flatten(F.transform(_runs(low, CJK_RUN), lambda r: cjk_grams(r, STOPGRAMS))))


def grams_of(run: str, longest: int = 4, whole: int = 8) -> Iterator[str]:
    """As cjk_grams: pieces of 2 to longest characters, then the run itself if it is short."""
    for size in range(2, longest + 1):
        yield from map("".join, zip(*(run[k:] for k in range(size)), strict=False))
    if len(run) <= whole:
        yield run


def search_tokens_in(text: str) -> Iterator[str]:
    """The tokens of search_tokens: ASCII ones, then those of CJK runs."""
    low = text.lower()
    yield from ASCII_RUN.findall(low)
    for run in () if low.isascii() else CJK_RUN_OF_TWO.findall(low):
        yield from (g for g in grams_of(run) if g not in STOPGRAMS)


def search_tokens_of(text: str) -> Counter[str]:
    """The tokens of search_tokens, counted."""
    return Counter(search_tokens_in(text))


def memory_tokens(text: Column) -> Column:
    """Distinct tokens of a remembered pattern: ASCII ones, and pairs of CJK characters."""
    low = F.lower(text)
    pairs = F.flatten(F.transform(_runs(low, CJK_RUN), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))
    return F.array_distinct(F.concat(_runs(low, MEMORY_TOKEN), pairs))


def _by_length(term: Column, plain: tuple[float, float, float], other: tuple[float, float, float]) -> Column:
    n = F.length(term)
    ascii_ = F.when(n >= 12, plain[0]).when(n >= 6, plain[1]).otherwise(plain[2])
    wide = F.when(n >= 4, other[0]).when(n == 3, other[1]).otherwise(other[2])
    return F.when(term.rlike(f"^{ASCII_TOKEN}$"), ascii_).otherwise(wide)


def term_weight(term: Column) -> Column:
    return _by_length(term, (4.2, 2.6, 1.6), (2.3, 1.7, 1.0))


def term_weight_of(term: str) -> float:
    if re.fullmatch(ASCII_TOKEN, term):
        return 4.2 if len(term) >= 12 else 2.6 if len(term) >= 6 else 1.6
    return 2.3 if len(term) >= 4 else 1.7 if len(term) == 3 else 1.0


def feature_weight(token: Column) -> Column:
    return _by_length(token, (2.4, 1.8, 1.2), (1.6, 1.25, 1.0))


def features_of(low: str, marks: list[tuple[re.Pattern, str, float]]) -> dict[str, float]:
    """The summed sparse features of a lower-cased text: tokens, parts of tokens with _, CJK runs, and marks that it holds."""
    tokens = Counter(ASCII_RUN.findall(low))
    out = {"ascii:" + t: n * (2.4 if len(t) >= 12 else 1.8 if len(t) >= 6 else 1.2) for t, n in tokens.items()}
    for t, n in tokens.items() if "_" in low else ():
        for part in t.split("_") if "_" in t else ():
            if len(part) >= 2:
                out["ascii:" + part] = out.get("ascii:" + part, 0.0) + n * 0.7
    wide = [] if low.isascii() else CJK_RUN_OF_TWO.findall(low)
    for g, n in Counter(g for run in wide for g in grams_of(run, whole=0)).items():
        out["cjk:" + g] = n * wide_weight(g)
    for run in wide:
        if len(run) <= 8:
            out["cjk:" + run] = out.get("cjk:" + run, 0.0) + wide_weight(run) + 0.4
    for pattern, name, weight in marks:
        # Synonyms are CJK words: none is in a text without a run of two.
        if (wide or not name.startswith("syn:")) and pattern.search(low):
            out[name] = out.get(name, 0.0) + weight
    return out


def wide_weight(gram: str) -> float:
    return 1.6 if len(gram) >= 4 else 1.25 if len(gram) == 3 else 1.0


ASCII_RUN, CJK_RUN_OF_TWO = re.compile(f"{ASCII_TOKEN.rstrip('+')}{{2,}}"), re.compile(f"{CJK_RUN.rstrip('+')}{{2,}}")


def feature_weights(frame: DataFrame, key: str, text: Column, concepts: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = ()) -> DataFrame:
    """key, feature and weight: the summed sparse features of each row's text; keys are unique.

    A text's features are summed within its row, so nothing is shuffled to make them.
    """
    marks = [("|".join(g), "syn:" + "|".join(g), 1.2) for g in SYNONYMS]
    marks += [("|".join([*wide, *(r"(?<![a-z0-9])" + re.escape(a) for a in ascii_)]), f"concept:{name}", 1.4) for name, wide, ascii_ in concepts]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(re.compile(p), name, w) for p, name, w in marks]
        for whole in batches:
            for batch in in_slices(whole, 1):
                counts, names, weights = [], [], []
                for low in batch.column(1).to_pylist():
                    found = features_of(low or "", patterns)
                    counts.append(len(found))
                    names += found
                    weights += found.values()
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(names, pa.string()), pa.array(weights, pa.float64())], names=[key, "feature", "weight"])

    rows = frame.select(key, F.lower(text).alias("low"))
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, feature string, weight double")


def clauses_of(query: str) -> list[str]:
    parts = [p.strip() for p in re.split(CLAUSE_BREAK, query) if p.strip()]
    return [p for p in parts if len(normalized(p)) >= 4] or [query.strip()]


def match_terms(query: str) -> list[tuple[str, bool]]:
    """Terms that a full-text match must all have, and whether a term is a prefix.

    A term with a dot or CJK characters but no letter is matched whole; others match as prefixes.
    """
    out: dict[tuple[str, bool], None] = {}
    for token in normalized(query).lower().replace("\n", " ").split(" "):
        if re.search("[a-z_一-鿿]", token) or any(c.isdigit() for c in token):
            clean = "".join(c for c in token if c.isalnum() or c in "_./-")
            if len(clean) >= 2:
                letter = re.search("[a-z]", clean)
                exact = not letter and ("." in clean or re.search("[一-鿿]", clean))
                out[clean, not exact] = None
    return list(out)


def summarize(text: Column, max_chars: int = 180) -> Column:
    """The first three lines as one, cut with an ellipsis."""
    line = F.array_join(F.slice(F.split(normalize_space(text), "\n"), 1, 3), " ")
    return F.when(F.length(line) <= max_chars, line).otherwise(F.concat(F.regexp_replace(F.substring(line, 1, max_chars - 1), " +$", ""), F.lit("…")))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether normalised, lower-cased text has the phrase, or all of its words of two characters or more."""
    low = F.lower(normalize_space(phrase))
    words = F.filter(F.split(low, r"[\s,.;:!?()]+"), lambda w: F.length(w) >= 2)
    return (low != "") & (F.contains(text, low) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(text, w))))


def identifiers(text: Column) -> Column:
    """Distinct names of functions and constants: words with _ or before (), in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+|[A-Za-z_][A-Za-z0-9_]*(?=\(\))"), F.lit(0)))


# Characters that stand in text that was decoded wrongly, and bounds of a trusted text layer.
LATIN1_MOJIBAKE = "ÃÂÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ¡¢£¤¥¦§¨ª«¬®¯±²³´µ¶¸¹º»¼½¾¿"
LEAST_LAYER_CHARS, LEAST_CJK, LEAST_SUSPECTS, MOST_SUSPECTS_PER_1K, MOST_LATIN1 = 40, 20, 3, 50.0, 0.12


def layer_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, normalised: its characters, CJK ones, Latin ones of wrong decoding and kana."""
    plains = [normalized(t) for t in texts]
    ends = np.cumsum([0, *map(len, plains)])
    whole = "".join(plains)
    if whole.isascii():
        none = np.zeros(len(texts), np.int64)
        return np.diff(ends), none, none, none
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    latin1 = np.isin(np.arange(257), [ord(c) for c in LATIN1_MOJIBAKE])[np.minimum(points, 256)]
    within = lambda first, last: (points >= ord(first)) & (points <= ord(last))
    counts = (np.diff(np.concatenate(([0], np.cumsum(mask)))[ends]) for mask in (within("一", "鿿"), latin1, within("\u3040", "\u30ff")))
    return np.diff(ends), *counts


def text_layer_quality(text: Column) -> Column:
    """Of a page's text layer: char_count, cjk_count, suspect_count, suspects_per_1k_cjk, latin1_ratio and reason_codes.

    Characters are counted in one pass in Python, all texts of a slice together.
    """
    names = ("n", "cjk", "latin1", "kana")

    @F.arrow_udf("struct<n:int,cjk:int,latin1:int,kana:int>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            parts = [layer_counts(s.column(0).to_pylist()) for s in in_slices(pa.RecordBatch.from_arrays([whole], names=["text"]), 0)]
            columns = [np.concatenate([p[k] for p in parts] or [[]]).astype(np.int32) for k in range(4)]
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(names))

    found = counted(F.coalesce(text, F.lit("")))
    n, cjk, latin1, kana = (found[name] for name in names)
    suspects = latin1 + kana
    per_1k = F.when(cjk > 0, suspects * 1000 / cjk).otherwise(0.0)
    ratio = F.when(n > 0, latin1 / n).otherwise(0.0)
    reasons = F.array_compact(
        F.array(
            F.when(n < LEAST_LAYER_CHARS, "text_too_short"),
            F.when((cjk >= LEAST_CJK) & (suspects >= LEAST_SUSPECTS) & (per_1k > MOST_SUSPECTS_PER_1K), "mojibake_suspect_ratio_high"),
            F.when((n >= LEAST_LAYER_CHARS) & (cjk < LEAST_CJK) & (ratio > MOST_LATIN1), "latin1_mojibake_ratio_high"),
        )
    )
    return F.struct(n.alias("char_count"), cjk.alias("cjk_count"), suspects.alias("suspect_count"), per_1k.alias("suspects_per_1k_cjk"), ratio.alias("latin1_ratio"), reasons.alias("reason_codes"))
