"""Keyed tables: every way of cutting, replaying, folding and cleaning gives the newest rows."""

import glob
import os
import random

import pytest

from ledgerloom.sources import sinks
from ledgerloom.sources.keyed import KeyedTable

SCHEMA = "k int, name string, v string, seq int, deleted boolean"


def random_batches(rng):
    seqs = list(range(60))
    rng.shuffle(seqs)  # rows come late
    rows = [(rng.randint(0, 9), rng.choice([None, None, f"n{s}"]), rng.choice([None, f"v{s}"]), s, rng.random() < 0.15) for s in seqs]
    return [rows[i : i + 10] for i in range(0, 60, 10)]


def newest(rows):
    out = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[3])
        names = [r[1] for r in own if r[1] is not None]
        out[k] = (names[-1] if names else None, own[-1][2], own[-1][3], own[-1][4])
    return out


def stored(table):
    return {r.k: (r.name, r.v, r.seq, r.deleted) for r in table.read().collect()}


def files(folder):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/t/**/*.parquet", recursive=True)}


def test_any_order_of_writes_folds_and_replays(spark, folder):
    rng = random.Random(4)
    batches = random_batches(rng)
    table = KeyedTable(spark, f"{folder}/t", ["k"], ["seq"], ["name"])
    assert table.read() is None and table.live() is None
    seen = []
    for number, rows in enumerate(batches):
        before = files(folder)
        assert table.upsert(spark.createDataFrame(rows, SCHEMA), number // 2, "ab"[number % 2])
        after = files(folder)
        assert {f: t for f, t in after.items() if f in before} == before  # nothing stored was written again
        seen += rows
        if number in (1, 3, 4):
            assert table.fold() is not None
            assert {f: t for f, t in files(folder).items() if f in after} == after
        assert stored(table) == newest(seen)
        for old in range(number + 1):  # replays of stored and of folded batches
            assert not table.upsert(spark.createDataFrame(batches[old], SCHEMA), old // 2, "ab"[old % 2])
        assert stored(table) == newest(seen)
    assert table.fold(least=5) is None
    live = {r.k for r in table.live().collect()}
    assert live == {k for k, row in newest(seen).items() if not row[3]}


def test_reader_beside_fold_and_clean(spark, folder):
    batches = random_batches(random.Random(9))
    table = KeyedTable(spark, f"{folder}/t", ["k"], ["seq"], ["name"])
    for rows in batches[:2]:
        table.upsert(spark.createDataFrame(rows, SCHEMA))
    reading = table.read()
    want = newest(batches[0] + batches[1])
    table.fold()
    table.upsert(spark.createDataFrame(batches[2], SCHEMA))
    table.clean()
    assert {r.k: (r.name, r.v, r.seq, r.deleted) for r in reading.collect()} == want
    reading = table.read()
    table.fold()
    table.clean()
    assert table.batches("main") == [2]  # the two batches of the first fold are gone
    assert {r.k: (r.name, r.v, r.seq, r.deleted) for r in reading.collect()} == newest(sum(batches[:3], [])) == stored(table)
    table.upsert(spark.createDataFrame(batches[3], SCHEMA))  # numbers go on after cleaning
    assert table.batches("main") == [2, 3] and stored(table) == newest(sum(batches[:4], []))


def test_broken_writes_are_invisible(spark, folder):
    batches = random_batches(random.Random(2))
    table = KeyedTable(spark, f"{folder}/t", ["k"], ["seq"], ["name"])
    table.upsert(spark.createDataFrame(batches[0], SCHEMA), 0)
    part = spark.createDataFrame(batches[1], SCHEMA)
    part.write.parquet(f"{folder}/t/deltas/writer=main/batch=1")
    os.remove(f"{folder}/t/deltas/writer=main/batch=1/_SUCCESS")
    part.write.parquet(f"{folder}/t/base/version=1")  # a fold that never came to its marks
    assert stored(table) == newest(batches[0])
    assert table.upsert(part, 1)
    assert stored(table) == newest(batches[0] + batches[1])
    assert table.fold() == 2 and stored(table) == newest(batches[0] + batches[1])


def test_columns_may_come_and_settings_stay(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", ["k"], ["seq"])
    table.upsert(spark.createDataFrame([(1, 1), (None, 1)], "k int, seq int"))
    table.upsert(spark.createDataFrame([(1, 2, "x"), (None, 2, "y")], "k int, seq int, more string"))
    got = {r.k: (r.seq, r.more) for r in KeyedTable(spark, f"{folder}/t").read().collect()}
    assert got == {1: (2, "x"), None: (2, "y")}
    with pytest.raises(ValueError, match="is stored with"):
        sinks.upsert(spark.createDataFrame([(1, 1)], "k int, seq int"), f"{folder}/t", ["seq"], ["k"])
    with pytest.raises(ValueError, match="no keyed table"):
        KeyedTable(spark, f"{folder}/nothing")


def test_filters_on_keys_reach_the_files(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", ["k"], ["seq"], ["name"])
    table.upsert(spark.createDataFrame(random_batches(random.Random(1))[0], SCHEMA))
    plan = table.read().where("k = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan
