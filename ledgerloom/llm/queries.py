"""The operators' registered queries and, where SQL can say it, their oracles."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_root
from . import (
    decontaminate, language, licenses, lines, near, packing, periodic, phrases, quality, tokens, toxicity, vectors, warc,
)
from .common import crc_bucket

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@registered
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document before and after cleaning edits, only edited regions encoded again."""
    done = tokens.recount_cleaned(table(spark, folder, "documents").select("doc_id", "text"))
    leaves = F.size("characters") / 2
    return done.select(
        "doc_id", F.col("n_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"),
        F.length("text").cast("long").alias("n_chars_after"), "n_reencoded", "n_touched", leaves.cast("long").alias("n_leaves"),
    )


@registered
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by a factorisation machine."""
    docs, held = table(spark, folder, "documents"), crc_bucket("doc_id", 4) == 2
    machine = quality.train(docs, table(spark, folder, "labels").where(~held))
    scored = quality.score_quality(docs, machine)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@registered
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of at least 20 code points found in at least 3 documents stay only in the largest of them."""
    done = lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op3_line_dedup"] = """
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, coalesce(f.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@registered
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every tokenised document with its place in a sequence of at most 1024 tokens."""
    return packing.packed_digest(table(spark, folder, "documents"))


@registered
def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest vectors of every fiftieth vector."""
    points = table(spark, folder, "embeddings")
    return vectors.nearest(points, points.where("vec_id % 50 = 0"), 5)


ORACLES["op5_nearest"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
             AND list_bool_or([x <> 0 FOR x IN embedding])),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@registered
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document after noisy-channel decoding."""
    docs, held = table(spark, folder, "documents"), crc_bucket("doc_id", 5) == 0
    scorer = toxicity.train(docs, table(spark, folder, "labels").where(~held))
    scored = toxicity.score_toxicity(docs, scorer)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@registered
def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near.near_duplicates(table(spark, folder, "documents"))


@registered
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from the rows that are not held out."""
    docs = table(spark, folder, "documents")
    model = language.train(docs.where(crc_bucket("doc_id", 5) != 0))
    found = language.identify(docs, model)
    return found.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@registered
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and templates in every document."""
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    base = F.sort_array(F.array_distinct(F.col("base.label")))
    every = F.sort_array(F.array_union(F.col("base.label"), F.col("matches.label")))
    whole = F.least(F.lit(1.0), F.aggregate("matches", F.lit(0.0), lambda t, m: t + (m["end"] - m["start"]) / 20.0))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(whole)
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"), F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", every).alias("labels"), score.alias("score"),
    )


@registered
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain a benchmark item, with the item and the share of its shingles."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def planted_places(doc: int | None, n: int) -> np.ndarray | None:
    """One document in ten repeats a stretch of its words up to its end."""
    mark, rest = divmod(zlib.crc32(str(doc).encode()), 10)[::-1]
    if doc is None or mark:
        return None
    begin = rest % n
    period = 1 + (n - begin) // (3 + rest % 8)
    places = np.arange(n)
    return np.where(places < begin, places, begin + (places - begin) % period)


@registered
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal periodic runs of words of every document, and its text without repetitions."""
    found = periodic.find_runs(table(spark, folder, "documents"), planted_places)
    # longest first, then smallest start, then period
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines_ = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines_, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.s").alias("start"), (-F.col("longest.l")).alias("length"),
        F.col("longest.p").alias("period"), F.expr("1000 * -longest.l div longest.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


@registered
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC records, equal payloads as revisits, and read back."""
    path = f"{scratch_root(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return warc.round_trip(table(spark, folder, "pages"), path)


ORACLES["op12_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keeper FROM p),
r AS (SELECT *, keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AS revisit FROM m)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN keeper END AS refers_to FROM r
"""


@registered
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Each language's 2000 firmest phrases of 2 to 5 words."""
    return phrases.collocations(table(spark, folder, "documents"))


ORACLES["op13_collocations"] = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
s AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM s),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, list_slice(words, i, i + k - 1) AS words
      FROM w, unnest(range(1, 6)) AS kk(k), unnest(range(1, len(words) - k + 2)) AS ii(i)),
f AS (SELECT lang, k, array_to_string(words, ' ') AS phrase, any_value(words) AS words, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
u AS (SELECT lang, array_to_string(list_slice(words, j, j + k - 2), ' ') AS phrase, max(f) AS longer
      FROM f, unnest([1, 2]) AS jj(j) WHERE k >= 3 GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN u ON f.lang = u.lang AND f.phrase = u.phrase WHERE f.k >= 2 AND coalesce(100 * u.longer < 100 * f.f, true)),
x AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, j,
             CAST((1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM c, unnest(range(1, c.k)) AS jj(j), f AS l, f AS r, n
      WHERE l.lang = c.lang AND r.lang = c.lang AND n.lang = c.lang AND l.phrase = array_to_string(list_slice(c.words, 1, j), ' ')
        AND r.phrase = array_to_string(list_slice(c.words, j + 1, c.k), ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""


@registered
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
