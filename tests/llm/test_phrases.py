import re
from collections import Counter
from fractions import Fraction
from math import floor

import duckdb
import numpy as np

from ledgerloom.llm import phrases
from ledgerloom.llm.queries import ORACLES, QUERIES
from tests.llm.samples import awkward, documents, empty, lower


def brute(rows, least, longest=5, top=None):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    frequent = {k: v for k, v in counts.items() if v >= least}
    around = Counter()
    for (lang, words), a in frequent.items():
        for n in range(1, len(words)):
            for i in range(len(words) - n + 1):
                around[lang, words[i : i + n]] = max(around[lang, words[i : i + n]], a)
    scored = {}
    for (lang, words), a in frequent.items():
        n = len(words)
        if n < 2 or around[lang, words] >= a:
            continue
        cuts = []
        for k in range(1, n):
            left, right = frequent[lang, words[:k]], frequent[lang, words[k:]]
            cuts.append((floor(Fraction(1000 * a * totals[lang], left * right)), k, left, right))
        score, _, left, right = min(cuts)
        scored.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, own in scored.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_counting(spark):
    rows = documents()
    for least, top in ((3, None), (10, 7)):
        assert got(phrases.collocations(frame(spark, rows), least, top=top)) == brute(rows, least, top=top)


def test_collisions_are_settled_by_text(spark):
    """With fingerprints of a few bits nearly everything collides; the result is the same."""
    rows = documents()[:60]
    want = brute(rows, 4)
    assert len(want) > 50
    for width in (6, 14):
        assert got(phrases.collocations(frame(spark, rows), 4, top=None, width=width)) == want


def test_ties_and_pieces(spark):
    rows = [(1, "A b. a B, a b\na b\tc", "x"), (2, "a b c a a a a", "x"), (2, "a b c a a a a", "x"), (None, "q r q r", "y"), (None, "q r", "y"), (3, "a b", None)]
    assert got(phrases.collocations(frame(spark, rows), 2, top=None)) == brute(rows, 2)


def test_documents_without_ids(spark):
    rows = [(None, t, lang) for _, t, lang in documents()[:30]]
    assert got(phrases.collocations(frame(spark, rows), 4, top=None)) == brute(rows, 4)


def test_repeated_ids_with_other_texts(spark):
    rows = [(d % 3, t, lang) for d, t, lang in documents()[:40]]
    assert got(phrases.collocations(frame(spark, rows), 4, top=None)) == brute(rows, 4)


def test_awkward(spark):
    docs, rows = awkward(spark)
    langs = [r.lang for r in docs.select("lang").collect()]
    short = [(d, t, lang) for (d, t), lang in zip(rows, langs) if len(t or "") < 1000]
    assert got(phrases.collocations(docs.where("length(text) < 1000 OR text IS NULL"), 2, top=None)) == brute(short, 2)
    assert phrases.collocations(docs).count() > 0  # texts of 20,000 sentences
    assert phrases.collocations(empty(spark)).collect() == []


def test_fingerprints():
    """Equal n-grams have equal values wherever they stand, in batches of any size."""
    one = phrases.Grams(b"en", [(1, b"x y. a b c d"), (2, b"q a b c")])
    two = phrases.Grams(b"en", [(3, b"a b c")])
    assert one.left.tolist() == [2, 1, 4, 3, 2, 1, 4, 3, 2, 1]
    for check in (False, True):
        values = one.values(np.array([2, 7]), 3, check).tolist() + two.values(np.array([0]), 3, check).tolist()
        assert len(set(values)) == 1
    assert one.pointers(np.array([0, 5, 6, 9]))[1].tolist() == [0, 5, 0, 3]
    other = phrases.Grams(b"de", [(3, b"a b c")])
    assert other.values(np.array([0]), 3)[0] != two.values(np.array([0]), 3)[0]


def test_sieve(spark):
    keys = [hash(str(i)) for i in range(5000)]
    sieve = phrases.Sieve.of(spark.createDataFrame([(k,) for k in keys], "key long"), "key")
    assert sieve.holds(np.array(keys, dtype=np.int64).view(np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert sieve.holds(others).mean() < 0.05


def test_oracle(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(ORACLES["op13_collocations"]).fetchall())
    assert got(QUERIES["op13_collocations"](spark, folder)) == want and want


def test_rows_of_a_task_are_added_up():
    """One row for each n-gram however many batches it comes in, within the rows that may be held; nothing is lost."""
    import pyarrow as pa

    texts = [b"a b c", b"a b d. a b", b"e a b c"] * 4
    batches = [phrases._checked(g, np.arange(len(g)), 1) for g in (phrases.Grams(b"en", [(i if i % 3 else None, t)]) for i, t in enumerate(texts))]
    want = Counter()
    for b in batches:
        for r in b.to_pylist():
            want[r["key"]] += r["count"]
    for held in (1 << 20, 30, 8, 1):
        rows = pa.Table.from_batches(list(phrases.added_up(iter(batches), held))).to_pylist()
        sums = Counter()
        for r in rows:
            sums[r["key"]] += r["count"]
        assert sums == want
        if held == 1 << 20:
            assert len(rows) == len(want) and all(r["doc_id"] is not None and r["low"] == r["high"] for r in rows)
    assert list(phrases.added_up(iter([]))) == []
    apart = pa.RecordBatch.from_pylist([{"key": 1, "n": 2, "count": 3, "low": 5, "high": 5, "doc_id": None, "start": 9}], batches[0].schema)
    other = pa.RecordBatch.from_pylist([{"key": 1, "n": 1, "count": 4, "low": 4, "high": 6, "doc_id": 7, "start": 8}], batches[0].schema)
    (row,) = phrases._merged([apart, other]).to_pylist()
    assert row == {"key": 1, "n": 1, "count": 7, "low": 4, "high": 6, "doc_id": 7, "start": 8}


def test_tasks_send_one_row_for_each_phrase(spark):
    rows = [(i, "red green blue " * 700, "en") for i in range(1500)]
    docs = phrases.slim(frame(spark, rows).coalesce(1))
    assert sum(len(t) for _, t, _ in rows) > 2 * phrases._BATCH
    counted = phrases.phrase_counts(docs, [], 2, 64).collect()
    assert len(counted) == 7 and {r["count"] for r in counted if r["n"] == 0} == {1500 * 2100}


def test_rows_do_not_rise_with_splits(spark):
    """Many splits that all hold the same n-grams: one row for each n-gram and core, not for each split."""
    rows = [(i, "red green blue " * 5, "en") for i in range(400)]
    cores = spark.sparkContext.defaultParallelism
    docs = phrases.slim(frame(spark, rows).repartition(8 * cores))
    assert docs.rdd.getNumPartitions() == 8 * cores
    counted = phrases.phrase_counts(docs, [], 2, 64).collect()
    assert len(counted) <= 7 * cores and sum(r["count"] for r in counted if r["n"] == 0) == 400 * 15


def test_rows_are_merged_early(monkeypatch):
    """A task holds about twice its different n-grams, not all rows that it may hold."""
    most, merged = [], phrases._merged
    monkeypatch.setattr(phrases, "_merged", lambda kept: most.append(sum(b.num_rows for b in kept)) or merged(kept))
    grams = phrases.Grams(b"en", [(1, b"a b c d")])
    batch = phrases._checked(grams, np.arange(4), 1)
    (out,) = phrases.added_up(iter([batch] * 100), 64)
    assert out.num_rows == 4 and set(out.column("count").to_pylist()) == {100} and max(most) <= 20
