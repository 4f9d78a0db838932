"""Text: routing, identifiers, tagged facts, signals, entity names, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import (
    AGGREGATION_PATTERNS,
    BLOB_NUMBER_WORDS,
    CHUNK_BREAKS,
    CHUNK_CHARS,
    CHUNK_OVERLAP,
    DEAD_LETTER_PERMANENT_HINTS,
    FINANCIAL_HINTS,
    GRAPH_INGEST_EXTRA_PATTERNS,
    GRAPH_SIGNAL_PATTERNS,
    IDENTIFIER_PATTERNS,
    INDIAN_PATTERNS,
    PERMANENT_PATTERNS,
    RETRYABLE_PATTERNS,
    ROUTER_MIN_MARGIN,
    ROUTER_MIN_SCORE,
    ROUTER_RULES,
    SCALE_FOOTNOTES,
    STOP_ENTITIES,
    US_PATTERNS,
)
from .hof import BLANKS, any_pattern, let, map_last_wins, presence, strip


def _hits(text: Column, patterns: list[str]) -> Column:
    total = F.lit(0)
    for pattern in patterns:
        total = total + text.rlike("(?iU)" + pattern).cast("int")
    return total


def _plain_text(text: Column) -> Column:
    """Lower case with every kind of blank turned into a space."""
    return F.lower(F.regexp_replace(text, r"[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", " "))


def _plain_pattern(pattern: str) -> str:
    """Patterns with word borders or digits keep the Unicode meaning."""
    return ("(?U)" + pattern) if ("\\b" in pattern or "\\d" in pattern) else pattern


def _gated_hits(plain: Column, patterns: list[str]) -> Column:
    """Number of patterns found; one alternation decides whether to count at all."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + plain.rlike(_plain_pattern(pattern)).cast("int")
    gate = "|".join(f"(?:{p})" for p in patterns)
    return F.when(plain.rlike(_plain_pattern(gate)), total).otherwise(0)


# --- classification ----------------------------------------------------------


def schema_scores(text: Column, allowed: list[str] | None = None) -> Column:
    """``array<struct<score, rank, schema>>`` of all schemas hit, best first."""

    def scored(plain: Column) -> Column:
        entries = [
            F.struct(
                (_gated_hits(plain, patterns) * F.lit(weight)).alias("score"),
                F.lit(-rank).alias("rank"),
                F.lit(schema).alias("schema"),
            )
            for rank, (schema, weight, patterns) in enumerate(ROUTER_RULES)
            if allowed is None or schema in allowed
        ]
        return F.sort_array(F.filter(F.array(*entries), lambda s: s["score"] > 0), asc=False)

    return let(_plain_text(text), scored)


def route_schema(text: Column, allowed: list[str] | None = None, min_score: float = ROUTER_MIN_SCORE) -> Column:
    """``struct<schema, score>``; the schema is empty when weak or too close a call."""

    def decide(ranked: Column) -> Column:
        best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        close = F.coalesce(best["score"] < second["score"] + F.lit(ROUTER_MIN_MARGIN), F.lit(False))
        clear = (best["score"] >= min_score) & ~close
        return F.struct(
            F.when(clear, best["schema"]).otherwise("").alias("schema"),
            F.coalesce(best["score"], F.lit(0.0)).alias("score"),
        )

    return let(schema_scores(F.coalesce(text, F.lit("")), allowed), decide)


def jurisdiction(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    side = F.signum(_hits(text, INDIAN_PATTERNS) - _hits(text, US_PATTERNS)).cast("int")
    return F.element_at(F.array(F.lit("US"), F.lit("GLOBAL"), F.lit("IND")), side + 2)


def identifiers(text: Column) -> Column:
    """``struct<cin, cik, ticker, nse_symbol>``; upper case, null when absent."""
    return F.struct(
        *[presence(F.upper(F.regexp_extract(text, p, 1))).alias(name) for name, p in IDENTIFIER_PATTERNS.items()]
    )


def scale_footnote(text: Column) -> Column:
    """First scale footnote in the order of the patterns, lower case."""
    return F.lower(F.coalesce(*[presence(F.regexp_extract(text, "(?iU)" + p, 0)) for p in SCALE_FOOTNOTES]))


def is_aggregation_question(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(any_pattern(AGGREGATION_PATTERNS))


def looks_financial(text: Column) -> Column:
    words = "|".join(w.replace("&", r"\&") for w in FINANCIAL_HINTS)
    return F.coalesce(text, F.lit("")).rlike("(?iU)" + words)


def has_numeric_matrix(text: Column) -> Column:
    """At least two non-blank lines hold a number."""
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(r"(?U)\b\d+[\d,]*\.?\d*\b"))
    return F.coalesce(F.size(lines) >= 2, F.lit(False))


def graph_signal(text: Column, min_length: int = 0, ingest: bool = False) -> Column:
    """Text worth a look for entity relations."""
    patterns = GRAPH_SIGNAL_PATTERNS + (GRAPH_INGEST_EXTRA_PATTERNS if ingest else [])
    text = F.coalesce(text, F.lit(""))
    return (F.length(strip(text)) >= min_length) & text.rlike(any_pattern(patterns))


# --- names -------------------------------------------------------------------


def canonical_entity(name: Column) -> Column:
    """Upper case without trailing blanks, dots and commas; null for noise names."""
    clean = F.upper(F.regexp_replace(name, f"^[{BLANKS}]+|[{BLANKS}.,]+$", ""))
    return let(clean, lambda c: F.when(~c.isin(STOP_ENTITIES) & (F.length(c) >= 3), c))


def canonical_predicate(name: Column) -> Column:
    return F.upper(F.translate(name, " -", "__"))


def column_name(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(label, r"[^a-zA-Z0-9_]+", "_"), r"^_+|_+$", ""))


def file_slug(value: Column, longest: int | None = None) -> Column:
    """A name for files; cut only if asked, as cut names may meet."""
    clean = F.regexp_replace(strip(F.coalesce(presence(value), F.lit("correction"))), r"[^a-zA-Z0-9_-]+", "_")
    clean = F.lower(F.regexp_replace(clean, r"^_+|_+$", ""))
    clean = clean if longest is None else F.substring(clean, 1, longest)
    return F.coalesce(presence(clean), F.lit("correction"))


# --- failures ----------------------------------------------------------------


def failure_class(error: Column, status: Column, table: Column) -> Column:
    """``permanent``, ``retryable`` or ``unknown``."""
    error, status, table = (F.coalesce(c, F.lit("")) for c in (error, status, table))
    text = F.concat_ws(" ", error, status, table)
    no_error = error == ""
    return (
        F.when(no_error & status.isin("FAILED", "NEEDS_REVIEW") & (table == ""), "permanent")
        .when(no_error & (status == "FAILED"), "permanent")
        .when(text.rlike(any_pattern(PERMANENT_PATTERNS)), "permanent")
        .when(text.rlike(any_pattern(RETRYABLE_PATTERNS)), "retryable")
        .when(status == "FAILED_VERIFICATION", "retryable")
        .when((status == "FAILED") | table.isin("", "UNKNOWN_TABLE"), "permanent")
        .otherwise("unknown")
    )


def attempt_tier(attempt: Column) -> Column:
    return (
        F.when(attempt <= 0, "initial")
        .when(attempt == 1, "repair")
        .when(attempt == 2, "focused_repair")
        .otherwise("escalated_repair")
    )


def is_permanent_dead_letter(error: Column, status: Column, failure: Column, exhausted: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(error, F.lit("")), F.coalesce(status, F.lit(""))))
    hints = "|".join(DEAD_LETTER_PERMANENT_HINTS)
    return (
        F.coalesce(failure == "permanent", F.lit(False))
        | F.coalesce(exhausted, F.lit(False))
        | text.rlike(hints)
    )


# --- facts and numbers inside text -------------------------------------------


def blob_numbers(text: Column) -> Column:
    """Quoted finance keys and their numbers in JSON text, as ``map<string,double>``."""
    pattern = r'"([a-zA-Z0-9_]{3,40})"\s*:\s*"?([$-]?[\d,]+\.?\d*)"?'
    keys = F.regexp_extract_all(text, F.lit(pattern), 1)
    values = F.regexp_extract_all(text, F.lit(pattern), 2)
    entries = F.transform(
        F.arrays_zip(keys.alias("k"), values.alias("v")),
        lambda e: F.struct(
            F.lower(e["k"]).alias("key"), F.translate(e["v"], "$,", "").try_cast("double").alias("value")
        ),
    )
    finance = "|".join(BLOB_NUMBER_WORDS)
    return map_last_wins(F.filter(entries, lambda e: e["key"].rlike(finance) & e["value"].isNotNull()))


def page_number(page: Column, text: Column) -> Column:
    """Page named in the text when the stored page is missing or the default 1."""
    named = F.regexp_extract(text, r"(?iU)\b(?:page|pg)\.?\s*(\d{1,3})\b", 1).try_cast("int")
    default = page.isNull() | (page <= 1)
    return F.when(default & named.between(1, 500), named).otherwise(page)


def _tag_pattern(tag: str) -> str:
    return rf"(?is)<ix:{tag}\s+[^>]*name=[\"'](?:[a-zA-Z0-9_-]+:)?([a-zA-Z0-9_-]+)[\"'][^>]*>(.*?)</ix:{tag}>"


def _tagged(df: DataFrame, key: str, text: str, kind: str, pattern: str) -> DataFrame:
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), 1).alias("concept"),
        F.regexp_extract_all(text, F.lit(pattern), 2).alias("raw"),
    )
    return df.select(key, F.posexplode(pairs)).select(
        key,
        F.lit(kind).alias("kind"),
        F.col("pos"),
        strip(F.col("col.concept")).alias("concept"),
        strip(F.regexp_replace("col.raw", "<[^>]+>", "")).alias("value"),
    ).where("concept <> '' AND value <> ''")


def tag_facts(df: DataFrame, key: str, text: str, tag_pattern: str, first_wins: bool = True) -> DataFrame:
    """(key, concept, value) of every tag the pattern (concept, body) finds."""
    found = _tagged(df, key, text, "tag", tag_pattern)
    pick = F.min_by if first_wins else F.max_by
    return found.groupBy(key, "concept").agg(pick("value", "pos").alias("value"))


def ixbrl_facts(df: DataFrame, key: str, text: str, text_chars: int | None = None) -> DataFrame:
    """Inline facts: numbers (last wins), then texts of other concepts (first wins, cut only if asked)."""
    rows = df.where(F.col(text).rlike(r"(?i)<ix:non"))
    found = _tagged(rows, key, text, "number", _tag_pattern("nonFraction")).unionByName(
        _tagged(rows, key, text, "text", _tag_pattern("nonNumeric"))
    )
    number = F.max_by("value", F.when(F.col("kind") == "number", F.col("pos")))
    words = F.min_by("value", F.when(F.col("kind") == "text", F.col("pos")))
    words = words if text_chars is None else F.substring(words, 1, text_chars)
    return found.groupBy(key, "concept").agg(F.coalesce(number, words).alias("value"))


IND_AS_PATTERN = (
    r"(?is)<(?:ind-as|in-gaap):([a-zA-Z0-9_-]+)\s*[^>]*>(.*?)</(?:ind-as|in-gaap):[a-zA-Z0-9_-]+>"
)


def ind_as_facts(df: DataFrame, key: str, text: str) -> DataFrame:
    return tag_facts(df, key, text, IND_AS_PATTERN)


# --- chunks ------------------------------------------------------------------


def chunk_spans(text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[int, int]]:
    """(begin, end) of overlapping windows; a window ends at a break unless none lies past the overlap.

    The break is the last one in the window of the first kind of mark that has any.
    """
    begin, end = 0, 0
    while end < len(text):
        reach = begin + size
        if reach >= len(text):
            end = len(text)
        else:
            places = ((text.rfind(mark, begin + overlap + 1, reach), mark) for mark in CHUNK_BREAKS)
            end = next((at + len(mark) for at, mark in places if at >= 0), reach)
        yield begin, end
        begin = max(begin + 1, end - overlap)


def chunk_list(text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """The windows without surrounding blanks; blank ones are left out, but one chunk always remains."""
    cut = (text[begin:end].strip() for begin, end in chunk_spans(text, size, overlap))
    return list(filter(None, cut)) or [""]


CHUNK_ROWS, CHUNK_BATCH_CHARS = 4096, 1 << 20  # what a task holds of its output


def chunk_text(df: DataFrame, text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: (…, chunk_index, chunk_count, chunk_text) without ``text``.

    Each start depends on the break before, so a text is read in one go; texts
    are taken from their Arrow batch one at a time and chunks leave in small batches.
    """
    others = [f for f in df.schema if f.name != text]
    kind = T.StructType([
        *others, T.StructField("chunk_count", T.IntegerType(), False), T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("chunk_text", T.StringType(), False),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            rest = batch.select([f.name for f in others])

            def out(chunks: list[tuple]) -> pa.RecordBatch:
                rows, counts, places, cut = zip(*chunks)
                columns = [*rest.take(pa.array(rows, pa.int64())).columns, pa.array(counts, pa.int32()), pa.array(places, pa.int32()), pa.array(cut, texts.type)]
                return pa.RecordBatch.from_arrays(columns, names=kind.fieldNames())

            held, chars = [], 0
            for row in range(batch.num_rows):
                chunks = chunk_list(texts[row].as_py() or "", size, overlap)
                for place, chunk in enumerate(chunks):
                    held.append((row, len(chunks), place, chunk))
                    chars += len(chunk)
                    if len(held) >= CHUNK_ROWS or chars >= CHUNK_BATCH_CHARS:
                        yield out(held)
                        held, chars = [], 0
            if held:
                yield out(held)

    return df.mapInArrow(run, kind)
