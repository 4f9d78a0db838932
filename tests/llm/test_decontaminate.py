import random

import duckdb

from ledgerloom.llm import decontaminate
from ledgerloom.llm.queries import QUERIES
from tests.llm.samples import LONG, SMALL, awkward, documents, empty, shingles


def brute(rows, items, threshold=75):
    out = []
    for d, t in rows:
        own = shingles(t)
        for i, text in items:
            want = shingles(text)
            shared = len(own & want)
            if d is not None and i is not None and want and 100 * shared >= threshold * len(want):
                out.append((d, i, shared, len(want)))
    return sorted(out)


def found(frame):
    return sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in frame.collect())


def test_small_table(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    want = brute([(d, t) for d, t, _ in documents()], items)
    assert want and found(QUERIES["op10_decontamination"](spark, SMALL)) == want


def test_awkward_and_blocks(spark):
    frame, rows = awkward(spark)
    items = [(1, " ".join(LONG.split()[5000:5040])), (2, None), (3, ""), (None, "Only three words"), (4, "Only three words"),
             (5, "one line that is long enough to count"), (6, " ".join(LONG.split()[7:2000]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert len(want) >= 5
    assert found(decontaminate.contaminated(frame, benchmark)) == want
    assert found(decontaminate.contaminated(frame, benchmark, block_items=2)) == want
    assert found(decontaminate.contaminated(empty(spark), benchmark)) == []
    assert found(decontaminate.contaminated(frame, benchmark.limit(0))) == []


def test_broken_passages_in_long_documents(spark):
    """Items of many sizes, changed here and there, anywhere in long documents."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([6, 12, 30, 64, 65, 200, 900])))) for i in range(120)]
    rows = []
    for i, text in items:
        own = text.split()
        if len(own) > 40:
            own[len(own) // 2 : len(own) // 2] = rng.choices(vocabulary, k=30)
        rows.append((i, " ".join(rng.choices(vocabulary, k=rng.randrange(4000)) + own + rng.choices(vocabulary, k=rng.randrange(4000)))))
    want = brute(rows, items)
    assert len(want) >= 100
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == want


def test_short_items_are_never_missed(spark):
    """Items of 1 to 8 shingles, whole or with one end changed, inside other text."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=5 + i % 8))) for i in range(240)]
    rows = []
    for i, text in items:
        own = text.split()
        own = own[:-1] + ["changed"] if len(own) >= 8 and i % 3 == 0 else own
        rows.append((i, " ".join(rng.choices(vocabulary, k=40) + own + rng.choices(vocabulary, k=40))))
    want = brute(rows, items)
    assert len(want) == 240
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == want
