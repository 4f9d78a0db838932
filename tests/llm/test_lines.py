import duckdb

from ledgerloom.llm import lines
from ledgerloom.llm.queries import ORACLES, QUERIES
from tests.llm.samples import SMALL, awkward, empty, lower

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(rows):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(SPACES))
            if len(key) >= 20 and d is not None:
                holders.setdefault(key, set()).add(d)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if d is None or len(holders.get(lower(x.strip(SPACES)), ())) < 3 or max(holders[lower(x.strip(SPACES))]) == d]
        out.append((d, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


def test_awkward(spark):
    frame, rows = awkward(spark)
    done = lines.dedup_lines(frame)
    assert done.columns == [c for c in frame.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in done.collect()), key=str)
    assert got == brute(rows)
    assert lines.dedup_lines(empty(spark)).collect() == []


def test_runs_agree_with_counts(spark):
    """However many batches and levels, the runs hold the same sums."""
    rows = [(d, d % 7, d % 3) for d in range(60)] + [(d, 5, 5) for d in range(100, 140)]
    for fanout in (2, 3):
        store = lines.LineRuns(fanout)
        fresh = 0
        for batch in range(5):
            own = [r for r in rows if r[0] % 5 == batch]
            fresh += store.add(spark.createDataFrame(own, "doc_id long, hi long, lo long")).count()
        assert all(len(level) <= fanout for level in store.levels) and len(store.levels) > 1
        assert store.runs().where("fresh").groupBy("hi", "lo").count().where("count > 1").count() == 0
        got = {(r.hi, r.lo): (r.documents, r.keeper) for r in store.totals().collect()}
        want = {}
        for d, hi, lo in rows:
            n, keeper = want.get((hi, lo), (0, -1))
            want[(hi, lo)] = (n + 1, max(keeper, d))
        assert got == want and fresh == len(want)


def test_keys_that_stay_in_one_batch_need_no_sum(spark):
    """Additions hold exactly the keys that the anti-join found in an earlier run."""
    store = lines.LineRuns(2)
    assert store.totals() is None
    schema = "doc_id long, hi long, lo long"
    first = store.add(spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, 2), (3, 2, 2)], schema))
    second = store.add(spark.createDataFrame([(9, 1, 1), (7, 3, 3)], schema))
    assert sorted(map(tuple, first.collect())) == [(1, 1, 2, 2), (2, 2, 1, 3)]
    assert [tuple(r) for r in second.collect()] == [(3, 3, 1, 7)]
    assert [tuple(r)[:4] for r in store.runs().where("NOT fresh").collect()] == [(1, 1, 1, 9)]
    assert sorted(map(tuple, store.totals().collect())) == [(1, 1, 3, 9), (2, 2, 1, 3), (3, 3, 1, 7)]


def test_bytes_that_are_no_text(spark):
    """Undecodable bytes pass through; a line that holds them is compared byte by byte."""
    frame = spark.range(1, 5).selectExpr("id AS doc_id", "CAST(concat(encode('the same long line with ', 'utf-8'), X'FF80', X'0A', encode(id, 'utf-8')) AS STRING) AS text")
    got = {r.doc_id: r.raw for r in lines.dedup_lines(frame).selectExpr("doc_id", "hex(CAST(text AS BINARY)) AS raw").collect()}
    whole = b"the same long line with \xff\x80\n4".hex().upper()
    assert got == {1: b"1".hex(), 2: b"2".hex(), 3: b"3".hex(), 4: whole}


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.execute(ORACLES["op3_line_dedup"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op3_line_dedup"](spark, SMALL).collect())
    assert got == want
