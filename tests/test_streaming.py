"""Streams from files, run to the end with the available data."""

import json
import os
import time

from pyspark.sql import functions as F

from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import assembly, branches, changes, jobs, retries, triage


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))


def source(spark, folder, schema):
    return readers.stream(spark, {"format": "json", "path": folder, "schema": schema})


def run(df, folder, mode="append"):
    """Run to the end of the available data; rows land in a folder."""
    def write(batch, _):
        batch.write.mode("append").parquet(f"{folder}/out")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()


def out(spark, folder):
    return spark.read.parquet(f"{folder}/out").collect() if os.path.isdir(f"{folder}/out") else []


def run_until(spark, df, folder, enough, then=None):
    """A query with processing-time timers never runs dry: poll its output, then stop it.

    ``then`` is called once the first condition holds, before the second.
    """
    def write(batch, _):
        batch.write.mode("append").parquet(f"{folder}/out")

    q = df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/cp").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        for condition in enough:
            while time.time() < end:
                try:
                    if condition(out(spark, folder)):
                        break
                except Exception:  # noqa: BLE001 - a file of the running batch
                    pass
                assert q.exception() is None
                time.sleep(0.3)
            if then:
                then()
                then = None
    finally:
        q.stop()
    return out(spark, folder)


CHUNK = "tenant_id string, document_id string, chunk_index int, chunk_total int"


def test_chunk_barrier(spark, folder):
    chunk = lambda d, i, n: {"tenant_id": "t", "document_id": d, "chunk_index": i, "chunk_total": n}
    put(f"{folder}/in", "1", [chunk("a", 2, 3), chunk("a", 0, 3), chunk("a", 0, 3), chunk("b", 0, 1), chunk("c", 0, 2)])
    more = lambda: put(f"{folder}/in", "2", [chunk("a", 1, 3)])
    stream = assembly.ready_documents(source(spark, f"{folder}/in", CHUNK), timeout_seconds=25)
    rows = run_until(spark, stream, folder, [lambda r: len(r) >= 1, lambda r: len(r) >= 3], more)
    got = {r.document_id: (r.reason, list(r.chunk_indexes)) for r in rows}
    assert got == {"b": ("single", [0]), "a": ("complete", [0, 1, 2]), "c": ("timeout", [0])}


def test_assemble_orders_nodes_and_takes_newest_chunk(spark):
    ready = spark.createDataFrame([("t", "a", [0, 1])], "tenant_id string, document_id string, chunk_indexes array<int>")
    rows = [
        ("t", "a", 1, 1, "n3", 2, [0.0, 5.0, 1.0, 6.0]), ("t", "a", 0, 1, "old", 1, [0.0, 5.0, 1.0, 6.0]),
        ("t", "a", 0, 2, "n2", 1, [0.0, 9.0, 1.0, 6.0]), ("t", "a", 0, 2, "n1", 1, [0.0, 1.0, 1.0, 6.0]), ("t", "b", 0, 1, "x", 1, None),
    ]
    staged = spark.createDataFrame(rows, "tenant_id string, document_id string, chunk_index int, received_at int, node_id string, page int, bbox array<float>")
    got = sorted((r.ord, r.node_id) for r in assembly.assemble(ready, staged).collect())
    assert got == [(0, "n1"), (1, "n2"), (2, "n3")]


def test_job_stream_equals_batch(spark, folder):
    from ledgerloom.operators.jobs import fold_jobs

    base = dict(tenant_id="t", filename=None, current_stage="s", error_message="")
    events = [
        dict(base, seq=1, document_id="a", filename="a.pdf", status="IN_PROGRESS", sql_nodes_total=2, graph_nodes_total=0),
        dict(base, seq=2, document_id="a", sql_node_completed=True),
        dict(base, seq=3, document_id="b", status="FAILED", filename="unknown"),
        dict(base, seq=4, document_id="a", sql_node_completed=True),
        dict(base, seq=5, document_id="b", graph_node_completed=True),
    ]
    schema = "seq int, document_id string, tenant_id string, filename string, current_stage string, status string, error_message string, sql_nodes_total int, graph_nodes_total int, sql_node_completed boolean, graph_node_completed boolean"
    put(f"{folder}/in", "1", events[:2])
    start = lambda: jobs.start_job_table(source(spark, f"{folder}/in", schema), ["seq"], f"{folder}/jobs", f"{folder}/cp", availableNow=True)
    start().awaitTermination()
    first = {r.document_id: r.current_stage for r in sinks.read_live(spark, f"{folder}/jobs").collect()}
    assert first == {"a": "Ingesting (SQL: 1/2, Graph: 0/0)"}
    put(f"{folder}/in", "2", events[2:])
    start().awaitTermination()
    stored = sinks.read_live(spark, f"{folder}/jobs")
    batch = fold_jobs(spark.read.schema(schema).json(f"{folder}/in"), ["seq"])
    assert sorted(stored.select(batch.columns).collect()) == sorted(batch.collect())
    done = {r.document_id: r for r in stored.collect()}
    assert (done["a"].status, done["a"].current_stage, done["a"].filename) == ("COMPLETED", "Completed", "a.pdf")
    assert (done["b"].status, done["b"].graph_nodes_completed) == ("IN_PROGRESS", 1)


def test_triage_stream_dedups_over_batches(spark, folder):
    def event(i, h, version="false"):
        return {"event_id": f"e{i}", "tenant_id": "t", "s3_uri": f"s3://b/{i}", "file_hash_sha256": h, "metadata": {"is_version_update": version, "original_filename": f"{i}.pdf"}, "seq": i}

    schema = "seq int, " + readers.INGEST_EVENT
    start = lambda: triage.start_triage(source(spark, f"{folder}/in", schema), folder, f"{folder}/cp", ["seq"], availableNow=True)
    put(f"{folder}/in", "1", [event(1, "h1"), event(2, "h1"), event(3, "h2", "true")])
    start().awaitTermination()
    put(f"{folder}/in", "2", [event(4, "h2"), event(5, "h3")])
    start().awaitTermination()
    got = {r.event_id: r.result for r in spark.read.parquet(f"{folder}/routed").collect()}
    assert got == {"e1": "NEW_DOCUMENT", "e2": "EXACT_DUPLICATE", "e3": "VERSION_UPDATE", "e4": "EXACT_DUPLICATE", "e5": "NEW_DOCUMENT"}
    assert sorted(r.s3_uri for r in spark.read.parquet(f"{folder}/cleanup").collect()) == ["s3://b/2", "s3://b/4"]
    again = spark.read.schema(schema).json(f"{folder}/in/2.json")
    triage.write_triaged(again, folder, ["seq"], 1)  # the second batch once more routes the same and adds nothing
    assert {r.event_id: r.result for r in spark.read.parquet(f"{folder}/routed").collect()} == got
    assert spark.read.parquet(f"{folder}/routed").count() == 5


def test_discovery_keeps_new_etags(spark, folder):
    rows = [{"tenant_id": "t", "bucket": "b", "key": k, "etag": e} for k, e in (("k1", "e1"), ("k2", "e1"), ("k3", "e2"))]
    put(f"{folder}/in", "1", rows)
    start = lambda: triage.start_discovery(source(spark, f"{folder}/in", readers.DISCOVERY_EVENT), folder, f"{folder}/cp", availableNow=True)
    start().awaitTermination()
    put(f"{folder}/in", "2", [dict(rows[0], key="k9"), dict(rows[0], key="k8", etag="e3")])
    start().awaitTermination()
    got = sorted((r.etag, r.key) for r in spark.read.parquet(f"{folder}/new_objects").collect())
    assert got == [("e1", "k1"), ("e2", "k3"), ("e3", "k8")]


FAIL = "document_id string, event_time timestamp, permanent boolean"


def retry_reference(times, limit=3, ttl=3600):
    count, last, routes = 0, None, []
    for t in times:
        if last is not None and t >= last + ttl:
            count, last = 0, None
        if count < limit:
            count, last = count + 1, t
            routes.append("retry")
        else:
            routes.append("review")
    return routes


def test_retry_budget(spark, folder):
    minutes = [0, 10, 20, 30, 79, 81, 90, 200, 201]
    stamp = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"
    put(f"{folder}/in", "1", [{"document_id": "a", "event_time": stamp(m), "permanent": False} for m in minutes[:5]])
    stream = lambda: retries.route_retries(source(spark, f"{folder}/in", FAIL))
    run(stream(), folder)
    put(f"{folder}/in", "2", [{"document_id": "a", "event_time": stamp(m), "permanent": False} for m in minutes[5:]] + [{"document_id": "p", "event_time": stamp(1), "permanent": True}])
    run(stream(), folder)
    rows = sorted(out(spark, folder), key=lambda r: r.event_time)
    assert [r.route for r in rows if r.document_id == "a"] == retry_reference([m * 60 for m in minutes])
    assert [r.route for r in rows if r.document_id == "p"] == ["review"]


def test_review_clock(spark, folder):
    schema = "document_id string, event_time timestamp, kind string"
    put(f"{folder}/in", "1", [{"document_id": d, "event_time": "2024-01-01T00:00:00Z", "kind": "opened"} for d in ("a", "b")] + [{"document_id": "b", "event_time": "2024-01-01T00:01:00Z", "kind": "resolved"}])
    stream = retries.review_timeouts(source(spark, f"{folder}/in", schema), timeout_seconds=1)
    rows = run_until(spark, stream, folder, [lambda r: len(r) >= 4])
    got = sorted((r.document_id, r.status) for r in rows)
    assert got == [("a", "FAILED_PERMANENT"), ("a", "PENDING"), ("b", "PENDING"), ("b", "RESOLVED")]


def test_bounded_failures(spark, folder):
    put(f"{folder}/in", "1", [{"event_id": "a"}] * 2 + [{"event_id": "b"}])
    stream = lambda: retries.bounded_failures(source(spark, f"{folder}/in", "event_id string"))
    run(stream(), folder)
    put(f"{folder}/in", "2", [{"event_id": "a"}] * 2)
    run(stream(), folder)
    got = sorted((r.event_id, r.attempt, r.route) for r in out(spark, folder))
    assert got == [("a", 1, "retry"), ("a", 2, "retry"), ("a", 3, "dead_letter"), ("a", 4, "dead_letter"), ("b", 1, "retry")]


def test_etag_claims_with_watermark(spark, folder):
    put(f"{folder}/in", "1", [{"etag": "x", "event_time": "2024-01-01T00:00:00Z"}, {"etag": "x", "event_time": "2024-01-01T00:02:00Z"}, {"etag": "y", "event_time": "2024-01-01T00:00:00Z"}])
    run(triage.claimed_once(source(spark, f"{folder}/in", "etag string, event_time timestamp")), folder)
    assert sorted(r.etag for r in out(spark, folder)) == ["x", "y"]


def test_chunk_sync(spark, folder):
    def change(op, node, text, seq):
        state = {"tenant_id": "t", "document_id": "d", "node_id": node, "content": text, "source_page": 1}
        return {"value": json.dumps({"payload": {"op": op, "before": state, "after": None if op == "d" else state}}), "seq": seq}

    put(f"{folder}/in", "1", [change("c", "n1", "word " * 700, 1), change("c", "n2", "short", 2), change("c", "n3", "gone", 3)])
    feed = lambda: readers.cdc(source(spark, f"{folder}/in", "value string, seq int"), readers.ROW_STATE)
    start = lambda: changes.start_chunk_sync(feed(), f"{folder}/chunks", f"{folder}/cp", ["seq"], availableNow=True)
    start().awaitTermination()
    ids = {r.node_id for r in sinks.read_live(spark, f"{folder}/chunks").collect()}
    assert ids == {"n1_0", "n1_1", "n1_2", "n2", "n3"}
    put(f"{folder}/in", "2", [change("u", "n1", "now short", 4), change("d", "n3", "gone", 5)])
    start().awaitTermination()
    rows = {r.node_id: r.text for r in sinks.read_live(spark, f"{folder}/chunks").collect()}
    assert rows == {"n1": "now short", "n2": "short"}


def test_auto_promote(spark, folder):
    stored = spark.createDataFrame(
        [(1, "t", "d1", "UNKNOWN_TABLE", "NEEDS_REVIEW", {"a": "1"}, {"a": "2", "b": "3"}), (2, "t", "d2", "invoices", "NEEDS_REVIEW", {}, {"x": "1"}), (3, "t", "d3", "invoices", "MAPPED", {}, {})],
        "id bigint, tenant_id string, document_id string, target_table string, mapping_status string, strict map<string,string>, unmapped map<string,string>",
    )
    stored.write.parquet(f"{folder}/rows")
    put(f"{folder}/in", "1", [{"value": json.dumps({"payload": {"op": "u", "after": {"target_table": "invoices", "columns": {}}}})}])
    feed = readers.cdc(source(spark, f"{folder}/in", "value string"), readers.SCHEMA_STATE)
    changes.start_auto_promote(feed, f"{folder}/rows", f"{folder}/out", f"{folder}/cp", availableNow=True).awaitTermination()
    got = {r.row_id: (r.target_table, r.extracted_data) for r in out(spark, folder)}
    assert got == {1: ("invoices", {"a": "2", "b": "3"}), 2: ("invoices", {"x": "1"})}


def test_staging_and_forward(spark, folder):
    put(f"{folder}/in", "1", [{"key": "k", "value": "v"}])
    triage.forward(source(spark, f"{folder}/in", "key string, value string"), "json", {"path": f"{folder}/copy"}, f"{folder}/cp", availableNow=True).awaitTermination()
    assert [(r.key, r.value) for r in spark.read.json(f"{folder}/copy").collect()] == [("k", "v")]
    put(f"{folder}/nodes", "1", [{"tenant_id": "t", "node_id": "n"}])
    assembly.start_staging(source(spark, f"{folder}/nodes", "tenant_id string, node_id string"), f"{folder}/staged", f"{folder}/cp2", availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{folder}/staged").count() == 1
    feed = jobs.tenant_feed(spark.createDataFrame([("t",), ("u",)], "tenant_id string"), "t")
    assert feed.count() == 1


def test_upsert_keeps_named_fields_and_other_rows(spark, folder):
    rows = lambda data: spark.createDataFrame(data, "document_id string, filename string, status string, seq int")
    sinks.upsert_jobs(rows([(f"d{i}", f"f{i}", "OLD", 1) for i in range(20)]), f"{folder}/j", ["seq"])
    sinks.upsert_jobs(rows([("d3", "unknown", "NEW", 2), ("d99", "n", "NEW", 2)]), f"{folder}/j", ["seq"])
    got = {r.document_id: (r.filename, r.status) for r in sinks.read_live(spark, f"{folder}/j").collect()}
    assert len(got) == 21 and got["d3"] == ("f3", "NEW") and got["d4"] == ("f4", "OLD") and got["d99"] == ("n", "NEW")
    keys = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    sinks.insert_ignore(keys, f"{folder}/k", ["k"])
    sinks.insert_ignore(spark.createDataFrame([("b",), ("c",)], "k string"), f"{folder}/k", ["k"])
    assert sorted(r.k for r in spark.read.parquet(f"{folder}/k").collect()) == ["a", "b", "c"]
    current = spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], "id int, user_id string, s string")
    new = spark.createDataFrame([(1, None, "z")], "id int, user_id string, s string")
    assert sorted((r.id, r.user_id, r.s) for r in sinks.update_by_id(current, new).collect()) == [(1, "u", "z"), (2, "v", "y")]
    assert F is not None


def test_replayed_batches_add_nothing(spark, folder):
    """The same batch number writes the same rows again; other numbers add."""
    event = lambda i, h: (i, f"e{i}", "t", f"s3://b/{i}", h, {"is_version_update": "false", "original_filename": "f"})
    schema = "seq int, event_id string, tenant_id string, s3_uri string, file_hash_sha256 string, metadata map<string,string>"
    batches = [spark.createDataFrame([event(1, "a"), event(2, "a")], schema), spark.createDataFrame([event(3, "a"), event(4, "b")], schema)]
    count = lambda name: spark.read.parquet(f"{folder}/{name}").count()
    for number, batch in enumerate(batches):
        triage.write_triaged(batch, folder, ["seq"], number)
    before = [count(n) for n in ("routed", "status", "cleanup", "hashes")]
    for number, batch in enumerate(batches):
        triage.write_triaged(batch, folder, ["seq"], number)
    assert [count(n) for n in ("routed", "status", "cleanup", "hashes")] == before and before[0] == 4
    found = spark.createDataFrame([("t", "b", "k", "x")], "tenant_id string, bucket string, key string, etag string")
    for _ in range(2):
        triage.write_discovered(found, f"{folder}/d", number=5)
    assert spark.read.parquet(f"{folder}/d/new_objects").count() == 1
    rows = spark.createDataFrame([(1, "pass"), (2, "fail")], "k int, route string")
    for number in (0, 0, 1):
        sinks.fan_out(rows, f"{folder}/routes", batch=number)
    assert spark.read.parquet(f"{folder}/routes").count() == 4


def test_upsert_and_raising_what_cannot_be_read(spark, folder):
    import pytest

    rows = lambda r: spark.createDataFrame(r, "id int, v string, seq int")
    sinks.upsert(rows([(i, "old", 1) for i in range(40)]), f"{folder}/t", ["id"], ["seq"])
    sinks.upsert(rows([(3, "new", 2), (99, "new", 2)]), f"{folder}/t", ["id"], ["seq"])
    got = {r.id: r.v for r in sinks.read_live(spark, f"{folder}/t").collect()}
    assert len(got) == 41 and got[3] == got[99] == "new" and got[4] == "old"
    assert sinks.read_or_none(spark, f"{folder}/nothing") is None
    rows([(1, "a", 1)]).write.parquet(f"{folder}/c/x=1/y=1")
    rows([(1, "a", 1)]).write.parquet(f"{folder}/c/z=1")
    with pytest.raises(Exception):
        sinks.read_or_none(spark, f"{folder}/c").collect()


def poll(query, condition, seconds=45):
    """Wait until the running query has done enough."""
    end = time.time() + seconds
    while time.time() < end:
        assert query.exception() is None
        try:
            if condition():
                return
        except Exception:  # noqa: BLE001 - a file of the running batch
            pass
        time.sleep(0.3)
    raise AssertionError("not enough output in time")


LETTER = (
    "document_id string, event_time timestamp, tenant_id string, node_id string, target_table string, extracted_data map<string,string>, "
    "strict_columns array<map<string,string>>, critic_error string, mapping_status string, failure_class string, exhausted boolean"
)


def letter(document, minute, **more):
    stamp = f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"
    base = {"document_id": document, "event_time": stamp, "tenant_id": "t", "node_id": f"n{minute}", "extracted_data": {"a": str(minute)}, "critic_error": "does not add up"}
    return {**base, **more}


def test_retry_loop_equals_batch_replay(spark, folder):
    """Every attempt has a log row and a message with its payload; the rest goes to review."""
    minutes = [0, 10, 20, 30, 79, 81, 90, 200, 201]
    first = [letter("a", m) for m in minutes[:5]] + [letter("p", 1, failure_class="PERMANENT", exhausted=True), letter("x", 3, critic_error="", mapping_status="MAPPED")]
    second = [letter("a", m) for m in minutes[5:]]
    put(f"{folder}/in", "1", first)
    count = lambda name: spark.read.parquet(f"{folder}/{name}").count()
    q = retries.start_retry_loop(
        retries.retry_letters(source(spark, f"{folder}/in", LETTER)), folder, f"{folder}/cp", processingTime="200 milliseconds")
    try:
        poll(q, lambda: count("retry_log") + count("reviews") == 6)
        put(f"{folder}/in", "2", second)
        poll(q, lambda: count("retry_log") + count("reviews") == 10 and count("retries") == count("retry_log"))
    finally:
        q.stop()
    want = retry_reference([m * 60 for m in minutes])
    tried = [m for m, route in zip(minutes, want) if route == "retry"]
    messages = [json.loads(r.value) for r in spark.read.parquet(f"{folder}/retries").collect()]
    assert sorted(int(m["extracted_data"]["a"]) for m in messages) == tried
    assert all(m["reflexion_error"] == "does not add up" and m["document_id"] == "a" and json.loads(m["previous_extraction"]) == m["extracted_data"] for m in messages)
    by_time = {int(m["extracted_data"]["a"]): m["reflexion_attempt"] for m in messages}
    assert [by_time[m] for m in tried][:3] == [1, 2, 3]
    log = spark.read.parquet(f"{folder}/retry_log").collect()
    assert len(log) == len({r.task_id for r in log}) == len(tried) and {r.tenant_id for r in log} == {"t"}
    reviews = sorted((r.document_id, json.loads(r.payload)["node_id"]) for r in spark.read.parquet(f"{folder}/reviews").collect())
    assert reviews == sorted([("a", f"n{m}") for m, route in zip(minutes, want) if route == "review"] + [("p", "n1")])
    # a replayed batch replaces its rows
    frame = spark.createDataFrame([("d", None, k, 1, "e", "{}") for k in ("log", "retry", "review")], retries.LOOP)
    for _ in range(2):
        retries.write_retries(frame, f"{folder}/again", 4)
    assert [spark.read.parquet(f"{folder}/again/{n}").count() for n in ("retries", "retry_log", "reviews")] == [1, 1, 1]


def test_retries_wait_until_they_are_due(spark, folder):
    put(f"{folder}/in", "1", [letter("a", m) for m in (0, 1)] + [letter("b", 5)])
    letters = retries.retry_letters(source(spark, f"{folder}/in", LETTER))
    seen = []
    rows = run_until(
        spark, retries.retry_loop(letters, delay_seconds=6), folder,
        [lambda r: len(r) >= 3, lambda r: len(r) >= 6], lambda: seen.extend(r.kind for r in out(spark, folder)))
    assert seen == ["log"] * 3
    got = sorted((r.document_id, r.attempt, json.loads(r.payload)["node_id"]) for r in rows if r.kind == "retry")
    assert got == [("a", 1, "n0"), ("a", 2, "n1"), ("b", 1, "n5")]


def test_claims_expire_and_confirmations_last(spark, folder):
    """Against a replay in plain Python; every kind within and over batches."""
    import datetime as dt
    import random

    rng = random.Random(6)
    begin = dt.datetime(2024, 1, 1)
    events = []
    for etag in "abcdef":
        at = 0
        for i in range(14):
            at += rng.choice([10, 100, 200, 299, 300, 4000, 90_000])
            events.append({"etag": etag, "object": f"{etag}{i}", "event_time": (begin + dt.timedelta(seconds=at)).strftime("%Y-%m-%dT%H:%M:%SZ"), "kind": rng.choice(["found"] * 4 + ["confirmed", "released"])})
    want, until = {}, {}
    for e in events:
        at = dt.datetime.strptime(e["event_time"], "%Y-%m-%dT%H:%M:%SZ")
        status = e["kind"]
        if status == "confirmed":
            until[e["etag"]] = at + dt.timedelta(hours=24)
        elif status == "released":
            until.pop(e["etag"], None)
        elif e["etag"] in until and at < until[e["etag"]]:
            status = "known"
        else:
            until[e["etag"]], status = at + dt.timedelta(minutes=5), "claimed"
        want[e["object"]] = status
    schema = "etag string, object string, event_time timestamp, kind string"
    cut = [[e for e in events if int(e["object"][1:]) in part] for part in (range(0, 5), range(5, 9), range(9, 14))]
    put(f"{folder}/in", "0", cut[0])
    stream = triage.etag_claims(source(spark, f"{folder}/in", schema))
    q = stream.writeStream.outputMode("append").foreachBatch(lambda batch, _: batch.write.mode("append").parquet(f"{folder}/out")).option(
        "checkpointLocation", f"{folder}/cp").trigger(processingTime="200 milliseconds").start()
    try:
        for name, part in enumerate(cut):
            if name:
                put(f"{folder}/in", str(name), part)
            poll(q, lambda: len(out(spark, folder)) == sum(map(len, cut[: name + 1])))  # noqa: B023
    finally:
        q.stop()
    assert {r.object: r.status for r in out(spark, folder)} == want
    assert {"claimed", "known", "confirmed", "released"} == set(want.values())


NODE = (
    "tenant_id string, document_id string, node_id string, type string, content string, parent_section_text string, "
    "source_page int, source_bbox array<float>, complete boolean, divert_to_rag boolean, seq int"
)


def test_branches_split_every_node_once(spark, folder):
    def node(i, kind, complete=False, divert=None):
        return {"tenant_id": "t", "document_id": f"d{i % 3}", "node_id": f"n{i}", "type": kind, "content": f"| c{i} |", "parent_section_text": "Notes" if i % 2 else "", "source_page": 1, "complete": complete, "divert_to_rag": divert, "seq": i}

    parts = [
        [node(0, "TABLE"), node(1, "TEXT"), node(2, "KEY_VALUE"), node(3, "TABLE", True)],
        [node(4, "TABLE", False, True), node(5, "TABLE", True, True), node(6, "TEXT", True), node(7, None)],
    ]
    start = lambda: branches.start_branches(source(spark, f"{folder}/in", NODE), folder, f"{folder}/cp", ["seq"], availableNow=True)
    for name, part in enumerate(parts):
        put(f"{folder}/in", str(name), part)
        start().awaitTermination()
    ids = lambda name: sorted(r.node_id for r in spark.read.parquet(f"{folder}/{name}").collect())
    chunks = lambda: {r.node_id: r.text for r in sinks.read_live(spark, f"{folder}/chunks").collect()}

    def check():
        assert ids("raw_tables") == ["n0", "n2"] and ids("resolved") == ["n4", "n5"]
        staged = {r.node_id: r.sent_early for r in spark.read.parquet(f"{folder}/staged").collect()}
        assert staged == {"n0": True, "n1": False, "n2": True, "n3": False, "n6": False, "n7": False}
        assert chunks() == {"n4": "| c4 |", "n5": "Notes\n| c5 |"}

    check()
    for name, part in enumerate(parts):  # replays
        batch = spark.read.schema(NODE).json(f"{folder}/in/{name}.json")
        branches.write_branches(batch, folder, ["seq"], name)
    check()


def test_admission_is_bounded(spark, folder):
    import pytest

    for i in range(6):
        put(f"{folder}/in", str(i), [{"a": j} for j in range(250)])
    sizes = []
    stream = readers.bounded_stream(spark, {"format": "json", "path": f"{folder}/in", "schema": "a int"}, messages_per_file=250)
    q = stream.writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sizes == [500, 500, 500]
    own = readers.bounded_stream(spark, {"format": "json", "path": f"{folder}/in", "schema": "a int", "options": {"maxBytesPerTrigger": "1k"}})
    assert own.isStreaming
    with pytest.raises(ValueError, match="no bound"):
        readers.bounded_stream(spark, {"format": "socket"})


def test_late_rows_meet_the_dictionary_of_their_time(spark, folder):
    from ledgerloom.registry import default_registry

    def change(op, column, day, seq):
        state = {"id": "1", "tenant_id": "t", "target_table": "standardized_income_statement", "raw_label": "Umsatz", "mapped_column": column, "updated_at": f"2024-01-{day:02d}T00:00:00Z"}
        return {"value": json.dumps({"payload": {"op": op, "before": state, "after": None if op == "d" else state}}), "seq": seq}

    def row(i, day):
        return {"id": i, "tenant_id": "t", "target_table": "standardized_income_statement", "event_time": f"2024-01-{day:02d}T12:00:00Z", "strict": {}, "drift": {"umsatz ": f"v{i}"}}

    schema = "id int, tenant_id string, target_table string, event_time timestamp, strict map<string,string>, drift map<string,string>"
    feed = lambda: readers.cdc(source(spark, f"{folder}/in", "value string, seq bigint"), readers.SYNONYM_STATE)
    tell = lambda: changes.start_dictionary(feed(), f"{folder}/labels", f"{folder}/cp", availableNow=True).awaitTermination()
    map_ = lambda: changes.start_remapping(source(spark, f"{folder}/rows", schema), f"{folder}/labels", f"{folder}/out", f"{folder}/cp2", default_registry(), availableNow=True).awaitTermination()
    put(f"{folder}/in", "1", [change("c", "total_revenue", 1, 1), change("u", "other_income", 10, 2)])
    tell()
    put(f"{folder}/rows", "1", [row(1, 5), row(2, 15)])
    map_()
    put(f"{folder}/in", "2", [change("d", "other_income", 20, 3)])
    tell()
    put(f"{folder}/rows", "2", [row(3, 5), row(4, 15), row(5, 25), row(6, 1)])  # late rows, and one after the deletion
    map_()
    got = {r.id: (dict(r.strict), dict(r.drift)) for r in out(spark, folder)}
    assert {i: s for i, (s, _) in got.items() if s} == {
        1: {"total_revenue": "v1"}, 2: {"other_income": "v2"}, 3: {"total_revenue": "v3"}, 4: {"other_income": "v4"}, 6: {"total_revenue": "v6"}}
    assert got[5] == ({}, {"umsatz ": "v5"})
