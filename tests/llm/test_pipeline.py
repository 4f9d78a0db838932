import re

import corpus_pipeline
from ledgerloom.llm import language
from ledgerloom.llm.common import crc_bucket
from tests.llm import test_decontaminate, test_lines, test_near, test_packing
from tests.llm.samples import SMALL, awkward, empty


def brute(spark, rows, benchmark, model):
    """The stages one after the other in plain Python."""
    rows = [(d, t) for d, t in rows if model.predict((t or "").encode())[0] != "und"]
    rows = [(d, t) for d, t, _, _ in test_lines.brute(rows)]
    groups = test_near.brute(rows)
    rows = [(d, t) for d, t in rows if d is None or groups[d][1] == d]
    leaks = {d for d, *_ in test_decontaminate.brute(rows, benchmark)}
    return [(d, t) for d, t in rows if d not in leaks]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs.where(crc_bucket("doc_id", 5) != 0))
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = brute(spark, [(r.doc_id, r.text) for r in docs.collect()], benchmark, model)
    assert 100 < len(rows) < docs.count()
    test_packing.check(rows, corpus_pipeline.run(spark, SMALL).collect())


def test_awkward(spark):
    frame, rows = awkward(spark)
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == frame.columns, name
        docs = corpus_pipeline.written(docs, "test")
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {None, 4, 5, 7, 8, 9, 10}  # 1, 2, 3, 6 have no letters; 11 is a near copy of 4
    none = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SMALL)
    assert none.collect() == []


def test_stage_names():
    assert [re.sub(r"\W", "", n) for n, _ in corpus_pipeline.STAGES] == [
        "languageID", "linededup", "MinHashneardedup", "benchmarkdecontamination", "packing"
    ]
