"""Operators against brute force: segmented windows, stitching, rules, corrections."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import alignment, catalog, critic, documents, evaluate, layout, rules, segmented, stitching, vector, views  # noqa: F401
from ledgerloom.registry import apply_schema_changes, catalog as view_catalog, default_registry, load_registry, struct_type


def hot_rows(spark, n=300):
    """One key holds most rows; values have gaps."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randint(1, 9) if rng.random() < 0.3 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i long, v int")


@pytest.mark.parametrize("width", [7, 64, 1 << 20])
def test_segmented_windows(spark, width):
    rows, df = hot_rows(spark)
    got = {(r.k, r.i): (r.p, r.s, r.n) for r in segmented.row_number(
        segmented.running_total(segmented.carry_last(df, ["k"], "i", {"v": "p"}, width=width), ["k"], "i", F.col("v"), "s", width=width),
        ["k"], "i", out="n", width=width).collect()}
    last, total, number = {}, {}, {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + (v or 0)
        number[k] = number.get(k, -1) + 1
        assert got[(k, i)] == (last.get(k), total[k], number[k])
        last[k] = v if v is not None else last.get(k)


@pytest.mark.parametrize("width", [3, 5, 1000])
def test_neighbours(spark, width):
    df = spark.createDataFrame([(k, i, f"{k}{i}") for k in "ab" for i in range(23)], "k string, i long, v string")
    out = segmented.neighbours(df, ["k"], "i", {"p": ("v", -1), "n2": ("v", 2)}, width)
    for r in out.collect():
        assert r.p == (f"{r.k}{r.i - 1}" if r.i else None) and r.n2 == (f"{r.k}{r.i + 2}" if r.i < 21 else None)
    assert out.count() == 46


def stitch_reference(nodes):
    heads, buf = {}, {}
    for d, o, kind, content, page in nodes:
        if kind == "TABLE":
            keys = {h.lower() for h in json.loads(content)}
            b = buf.get(d)
            ok = False
            if b:
                near = b[1] <= 0 or page <= 0 or page in (b[1], b[1] + 1)
                ok = near and (b[2] == keys or len(b[2] & keys) >= max(2, int(0.8 * min(len(b[2]), len(keys)))))
            if not ok:
                buf[d] = (o, page, keys)
            heads[(d, o)] = buf[d][0]
        elif not (kind == "TEXT" and 0 < len(content.strip()) < 160):
            buf.pop(d, None)
    return heads


@pytest.mark.parametrize("width", [1, 4, 4096])
def test_stitching_in_blocks(spark, width):
    rng, nodes = random.Random(8), []
    for d in range(12):
        page = 1
        for o in range(rng.randint(1, 50)):
            page += rng.random() < 0.25
            pick = rng.random()
            if pick < 0.7:
                headers = rng.choice([["A", "B", "C"], ["a", "b", "D"], ["A", "B"], ["X", "Y"]])
                nodes.append((f"d{d}", o, "TABLE", json.dumps({h: [f"{h}{o}"] for h in headers}), 0 if rng.random() < 0.05 else page))
            else:
                nodes.append((f"d{d}", o, "TEXT", "short" if pick < 0.9 else "x" * 200, page))
    df = spark.createDataFrame(nodes, "document_id string, ord long, type string, content string, page int")
    parsed = stitching.parsed_tables(df, ["document_id"])
    got = {(r.document_id, r.ord): r.head for r in stitching.table_heads(parsed, ["document_id"], width=width).collect()}
    assert got == stitch_reference(nodes)
    merged = stitching.stitched_tables(df, ["document_id"], width=width)
    assert merged.count() == len(set((d, h) for (d, _), h in got.items()))
    assert merged.agg(F.sum(F.size("table.rows"))).first()[0] == len(got)


def random_tables(rng, n):
    """Signatures (page, separators, usable, headers) of a document's tables in order."""
    out, page, sep = [], 1, 0
    for _ in range(n):
        page += rng.choice([0, 0, 0, 1, 1, 3, -1])
        sep += rng.random() < 0.06
        headers = rng.choice(["abc", "abd", "abce", "ab", "xy", "abcdefgh", "abcdefgi"])
        out.append((rng.choice([page, page, page, 0]), sep, rng.random() < 0.97, tuple(headers)))
    return out


@pytest.mark.parametrize("mode", ["assembly", "page"])
def test_composed_maps(mode):
    """Maps of blocks, composed in any grouping, lead every entering head where the plain fold leads it."""
    rng = random.Random(11)
    continues = stitching.MODES[mode]
    for _ in range(400):
        n = rng.randint(1, 40)
        tables = random_tables(rng, n)
        cut = rng.randint(0, n)
        parts = [(range(0, cut), tables[:cut]), (range(cut, n), tables[cut:])]
        left, right = (stitching.block_map(list(p), t, mode) for p, t in parts)
        both = stitching.composed(left, right, mode)
        heads = [None] + [(-1, (p, s, u, h)) for p, s, u, h in random_tables(rng, 12)] + [(-1, tables[0]), (-1, (0, *tables[0][1:]))]
        for head in heads:
            end = head
            for at, sig in enumerate(tables):
                if end is None or not continues(end[1], sig):
                    end = (at, sig)
            assert stitching.left_by(both, head, mode) == end
            assert stitching.left_by(right, stitching.left_by(left, head, mode), mode) == end


def test_composed_maps_stay_short():
    """A document without separators: the map of all its blocks is no longer than two pages' tables."""
    rng = random.Random(5)
    tables = [(1 + i // 6, 0, True, tuple(rng.choice(["abc", "abd", "xyz"]))) for i in range(3000)]
    maps = [stitching.block_map(list(range(i, i + 30)), tables[i : i + 30], "assembly") for i in range(0, 3000, 30)]
    while len(maps) > 1:
        maps = [stitching.composed(maps[i], maps[i + 1] if i + 1 < len(maps) else [], "assembly") for i in range(0, len(maps), 2)]
        assert max(map(len, maps)) <= 12


def reading_reference(ys, epsilon=15.0):
    lines, current = [], []
    for y in sorted(ys):
        if current and abs(y - sum(current) / len(current)) <= epsilon:
            current.append(y)
        else:
            current = [y]
            lines.append(current)
    return [line[0] for line in lines]


def test_line_starts(spark):
    rng = random.Random(4)
    pages = {p: [float(rng.randint(0, 200)) for _ in range(rng.randint(1, 60))] for p in range(20)}
    df = spark.createDataFrame([(p, y) for p, ys in pages.items() for y in ys], "page int, y0 double")
    for r in layout.line_starts(df, ["page"]).collect():
        assert r.starts == reading_reference(pages[r.page])


def plan_reference(flags, size):
    out, start, n = [], 0, len(flags)
    while start < n:
        end = min(start + size - 1, n - 1)
        while end < n - 1 and flags[end][0]:
            end += 1
            if not flags[end][1]:
                break
        out.append((start, end))
        start = end + 1
    return out


def test_page_plan(spark):
    rng = random.Random(6)
    files = {d: [(rng.random() < 0.4, rng.random() < 0.6) for _ in range(rng.randint(1, 40))] for d in range(25)}
    df = spark.createDataFrame([(d, p, s, c) for d, f in files.items() for p, (s, c) in enumerate(f)], "d int, page int, spans_bottom boolean, continues_top boolean")
    got = {}
    for r in layout.plan_chunks(df, ["d"]).orderBy("d", "chunk_index").collect():
        got.setdefault(r.d, []).append((r.start_page, r.end_page))
    assert got == {d: plan_reference(f, 5) for d, f in files.items()}


def test_flatten_tree(spark):
    leaf = "struct<node_id:string,type:string,content:string>"
    schema = f"document_id string, nodes array<struct<node_id:string,type:string,content:string,children:array<{leaf}>>>"
    df = spark.createDataFrame([("d", [("a", "TITLE", "T", [("b", "TEXT", "x"), ("c", "TABLE", "{}")]), ("e", "TEXT", "y", [])])], schema)
    got = sorted((r.node_id, r.parent_id, r.depth, r.ord) for r in layout.flatten_tree(df, ["document_id"]).collect())
    assert got == [("a", None, 0, 0), ("b", "a", 1, 0), ("c", "a", 1, 1), ("e", None, 0, 1)]


def check(spark, schema, **cells):
    df = spark.createDataFrame([({k: str(v) for k, v in cells.items()},)], "data map<string,string>")
    r = rules.with_verdict(rules.check_rows(df, schema, bag="data")).first()
    return r.row_status, r.hard_failures


def test_rules_pass_break_and_fail_closed(spark):
    good = dict(total_assets="1.000,00", total_liabilities="600", total_shareholders_equity="(−400)".replace("−", "-"))
    assert check(spark, "standardized_balance_sheet", total_assets="1.000,50", total_liabilities="600", total_shareholders_equity="$400.50") == ("MAPPED", [])
    assert check(spark, "standardized_balance_sheet", **good)[0] == "FAILED_VERIFICATION"
    assert "is.completeness.gross_profit" in check(spark, "standardized_income_statement", gross_profit=5)[1]
    df = spark.createDataFrame([({"a": "1"},)], "data map<string,string>")
    closed = rules.check_rows(df, "bank_statement_transactions", bag="data", packs={}, rules=None).first()
    assert closed.violations == [] or closed.violations[0].rule_id


def test_missing_rules_never_pass(spark):
    df = spark.createDataFrame([({"a": "1"},)], "data map<string,string>")
    keep = rules.KEYWORD_RULES.copy()
    rules.KEYWORD_RULES.clear()
    try:
        r = rules.with_verdict(rules.check_rows(df, "bank_statement_transactions", bag="data", packs={})).first()
    finally:
        rules.KEYWORD_RULES.update(keep)
    assert r.hard_failures == ["critic.missing_registration"]


def test_golden_validation(spark):
    rows = [("g1", "vendor_invoice_headers", [{"total_amount": "110", "subtotal_amount": "100", "tax_amount": "10"}]),
            ("g2", "vendor_invoice_headers", [{"total_amount": "150", "subtotal_amount": "100"}]), ("g3", "receipt_headers", [])]
    df = spark.createDataFrame(rows, "document_id string, target_table string, extracted_rows array<map<string,string>>").withColumn("expect_fail", F.lit(False))
    got = {r.document_id: r.expect_fail for r in evaluate.validate_goldens(df).collect()}
    assert got == {"g1": False, "g2": True}


GOLDENS = {  # name: (table, rows, expectation, (hard, soft))
    "tx_break": ("bank_statement_transactions", [{"deposit_amount": 10, "balance": 110}, {"withdrawal_amount": 5, "balance": 300}], "_expect_critic_fail", (1, 0)),
    "tx_fine": ("bank_statement_transactions", [{"deposit_amount": 10, "balance": 110}, {"withdrawal_amount": 5, "balance": "105.00"}], None, (0, 0)),
    "closing": ("bank_statement_headers", [{"opening_balance": 100, "closing_balance": 500, "total_deposits": 400, "total_withdrawals": 0, "_related": {"bank_statement_transactions": [{"deposit_amount": 10, "balance": 110}]}}], "_expect_critic_fail", (1, 0)),
    "lines": ("vendor_invoice_headers", [{"subtotal_amount": 100, "total_amount": 100, "_related": {"invoice_line_items": [{"total_amount": 30}, {"amount": "50"}]}}], "_expect_critic_fail", (1, 0)),
    "one_line": ("vendor_invoice_headers", [{"total_amount": 100, "subtotal_amount": 100, "_related": {"invoice_line_items": {"total_amount": 100}}}], None, (0, 0)),
    "cash": ("standardized_cash_flow", [{"net_change_in_cash": 50, "net_cash_from_operating_activities": 50, "net_cash_from_investing_activities": 0, "net_cash_from_financing_activities": 0, "cash_at_end": 250, "_related": {"standardized_balance_sheet": [{"cash_and_equivalents": 900}]}}], "_expect_soft_fail", (0, 1)),
    "sheet": ("standardized_balance_sheet", [{"total_assets": "1.000,00", "total_liabilities": "600", "total_shareholders_equity": "(400)"}], "_expect_critic_fail", (1, 0)),
    "ledger": ("general_ledger", [{"amount": 1}], "_expect_critic_fail", (1, 0)),
    "memo": ("memos", [{"amount": 1}], None, (0, 0)),
}


def test_document_critic_on_golden_files(spark, folder):
    import json
    import pathlib

    from ledgerloom.operators import critic
    from ledgerloom.sources import readers

    for name, (table, rows, expects, _) in GOLDENS.items():
        own = {"extracted_row": rows[0]} if len(rows) == 1 else {"extracted_rows": rows}
        pathlib.Path(folder, f"{name}.json").write_text(json.dumps({"document_id": name, "target_table": table, **own, **({expects: True} if expects else {}),
                                                                    "relations": [{"type": "sum_equals", "left": "a", "right": "b"}]}))
    goldens = readers.goldens(spark, folder)
    financial = (*critic.FINANCIAL_SCHEMAS, "general_ledger")
    found = critic.document_violations(evaluate.golden_rows(goldens), financial=financial)
    got = {n: [0, 0] for n in GOLDENS}
    for r in found.collect():
        got[r.document_id][0 if r.severity == "hard" else 1] += 1
    assert {n: tuple(v) for n, v in got.items()} == {n: g[3] for n, g in GOLDENS.items()}
    out = {r.document_id: (r.critic_ok, r.cells_total, r.cells_matched) for r in evaluate.evaluated(goldens).collect()}
    assert all(ok == (n != "ledger") for n, (ok, *_) in out.items())
    assert out["tx_fine"][1:] == (1, 1) and out["lines"][1:] == (0, 0)


def test_filters_and_limits():
    with pytest.raises(ValueError):
        views.parse_filters('{"x": 1}', ["a"])
    with pytest.raises(ValueError):
        views.parse_filters('{"a": [1]}', ["a"])
    assert views.parse_filters('{"a": 1, "tenant_id": "z"}', ["a", "tenant_id"]) == {"a": 1}
    with pytest.raises(ValueError):
        views.at_most(None, 0)


def test_registry(spark, folder):
    registry = default_registry()
    changes = spark.createDataFrame([("c", "new_table", {"a": "float"}, 1), ("u", "new_table", {"a": "int"}, 2), ("d", "x", {}, 3)], "op string, target_table string, columns map<string,string>, seq int")
    assert apply_schema_changes(registry, changes)["new_table"] == {"a": "int"}
    with open(f"{folder}/r.json", "w") as f:
        json.dump({"t": {"x": "float", "y": {"nested": "str"}}}, f)
    assert load_registry(spark, f"{folder}/r.json") == {"t": {"x": "float"}}
    assert struct_type({"x": "int"}, vertical=True).fieldNames()[0] == "period_name"
    roles = {(r.column, r.role) for r in view_catalog(spark, {"t": {"x": "float"}}).collect()}
    assert ("total_x", "measure") in roles and ("x", "dimension") in roles


def test_tenant_views_scope_any_sql(spark):
    rows = spark.createDataFrame([(i, "t1" if i % 2 else "t2", "u", f"d{i}", "n", i, 1, None, "corporate_subsidiaries", "MAPPED", {"entity_name": f"e{i}"}, {}) for i in range(6)],
        "id int, tenant_id string, user_id string, document_id string, node_id string, row_index int, source_page int, source_bbox array<float>, target_table string, mapping_status string, strict map<string,string>, unmapped map<string,string>")
    views.register_views(spark, rows, {"corporate_subsidiaries": default_registry()["corporate_subsidiaries"]}, "t1")
    assert {r[0] for r in spark.sql("SELECT entity_name FROM view_corporate_subsidiaries").collect()} == {"e1", "e3", "e5"}


def test_batch_topk_blocks(spark, monkeypatch):
    rng = random.Random(2)
    points = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    queries = [(q, [rng.uniform(-1, 1) for _ in range(8)]) for q in range(5)]
    monkeypatch.setattr(vector, "QUERY_BLOCK", 2)
    p = spark.createDataFrame(points, "id int, vector array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, query_vector array<double>")
    got = {}
    for r in vector.top_k_batch(p, q, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for qid, qv in queries:
        best = sorted(points, key=lambda t: -sum(a * b for a, b in zip(t[1], qv)) / norm(t[1]))[:4]
        assert [got[qid][k] for k in (1, 2, 3, 4)] == [b[0] for b in best]


def test_corrections_apply_and_errors(spark):
    df = spark.createDataFrame([({"a": "1"}, '{"b": "2"}', ""), ({"a": "1"}, "9", "a"), ({"a": "1"}, "9", "")], "data map<string,string>, v string, f string")
    got = [r[0] for r in df.select(alignment.apply_correction(F.col("data"), F.col("v"), F.col("f"))).collect()]
    assert got == [{"b": "2"}, {"a": "9"}, None]
    assert catalog.ACTIVE


def test_grounding_fields_of_a_pack(spark, folder):
    path = f"{folder}/pack.json"
    with open(path, "w") as f:
        json.dump({"rules": {}, "grounding_fields": {"vendor_invoice_headers": ["amount_due"], "receipt_headers": ["total_amount"]}}, f)
    fields = rules.load_grounding(spark, path)
    assert fields["vendor_invoice_headers"] == ["amount_due"] and fields["bank_statement_headers"] == ["opening_balance", "closing_balance"]
    df = spark.createDataFrame([({"amount_due": "17", "total_amount": "99"}, "due: 18"), ({"amount_due": "18"}, "due: 18")], "data map<string,string>, body string")
    got = rules.check_rows(df, "vendor_invoice_headers", bag="data", source_text="body", rules=(), grounding_severity=rules.HARD, grounding_fields=fields)
    found = [[(v.rule_id, v.severity) for v in r.violations] for r in got.collect()]
    assert [[x for x in row if x[0].startswith("grounding")] for row in found] == [[("grounding.value_not_in_source.amount_due", "hard")], []]


def test_nested_line_items(spark):
    """JSON lists with blanks, texts and entries that are no objects; structs; a list without entries is none."""
    cells = ['[{"amount":"1,000.50"},{"amount":"","total_amount":2},{"amount":"n/a"},7,null]', "[7]", "[]", "{}", "no list", None]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "k int, line_items string")
    want = [1002.5, 0.0, None, None, None, None]
    got = rules.with_numbers(frame, ["line_items_total"]).orderBy("k").collect()
    assert [r.n_line_items_total for r in got] == want
    bags = frame.select("k", F.create_map(F.lit("line_items"), "line_items").alias("bag"))
    got = rules.with_numbers(bags, ["line_items_total"], "bag").orderBy("k").collect()
    assert [r.n_line_items_total for r in got] == want
    frame = spark.createDataFrame([([(3.0, None), (None, 4.0)],), ([],), (None,)], "line_items array<struct<amount:double,total_amount:double>>")
    assert [r[1] for r in rules.with_numbers(frame, ["line_items_total"]).collect()] == [7.0, None, None]
    frame = spark.createDataFrame([(100.0, '[{"amount":"60"},{"total_amount":"40"}]'), (100.0, '[{"amount":"60"}]'), (100.0, "[]")], "total_amount double, line_items string")
    got = rules.with_verdict(rules.check_rows(frame, "vendor_invoice_headers", packs={})).select("hard_failures").collect()
    assert [r[0] for r in got] == [[], ["inv.identity.line_sum"], ["inv.completeness.subtotal"]]
    bags = frame.select(
        F.lit("d").alias("document_id"), F.lit("vendor_invoice_headers").alias("target_table"), F.monotonically_increasing_id().alias("row_index"),
        F.create_map(F.lit("total_amount"), F.col("total_amount").cast("string"), F.lit("line_items"), "line_items").alias("data"),
    )
    got = critic.row_violations(critic.with_parsed(bags.coalesce(1))).orderBy("row_index").collect()
    assert [r.rule_id for r in got] == ["inv.identity.line_sum", "inv.completeness.subtotal"]


def test_corrections_of_one_time(spark):
    rows = [(i, "t1", "bank", i % 5 == 0, 7 if i < 9 else 3) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "id long, tenant_id string, target_table string, promoted boolean, created_at long")
    waiting = [i for i, *_, promoted, _ in sorted(rows, key=lambda r: (r[4], r[0]), reverse=True) if not promoted]
    assert [r.id for r in catalog.unpromoted_corrections(df, limit=9).collect()] == waiting[:9]
    assert [r.id for r in catalog.corrections_list(df, "t1", "bank", unpromoted=True, limit=4).collect()] == waiting[:4]


def test_statements_meet_in_one_aggregate(spark, capsys):
    """First rows only, documents that lack a table or a key find nothing, and no side is held for a join."""
    bs = spark.createDataFrame([("a", 1, 10.0), ("a", 0, 5.0), ("b", 0, 7.0), (None, 0, 1.0)], "k string, row_index int, cash_and_equivalents double")
    cf = spark.createDataFrame([("a", 0, 9.0, 2.0), ("c", 0, 3.0, 4.0), (None, 0, 8.0, 9.0), ("b", 3, 7.0, 1.0)], "k string, row_index int, cash_at_end double, net_income double")
    income = spark.createDataFrame([("a", 0, 2.0), ("b", 2, 6.0), ("b", 5, 1.0), ("d", 0, 1.0)], "k string, row_index int, net_income double")
    found = documents.statement_checks(bs, income, cf, ["k"])
    apart = documents.balance_vs_cash_flow(bs, cf, ["k"]).unionByName(documents.income_vs_cash_flow(income, cf, ["k"]))
    for checks, exchanges in ((found, 1), (apart, 2)):
        checks.explain()
        plan = capsys.readouterr().out
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == exchanges
    assert {(r.k, r.rule_id.split(".")[-1], r.expected, r.actual) for r in found.collect()} == {
        ("a", "cf_ending_vs_bs_cash", 5.0, 9.0), ("b", "is_vs_cf_net_income", 6.0, 1.0),
    }
    assert {(r.k, r.rule_id) for r in apart.collect()} == {(r.k, r.rule_id) for r in found.collect()}


def test_named_checks_alone(spark, capsys):
    """Each kind of check alone gives its part of the whole, without the shuffles of the others."""
    rows = spark.createDataFrame([
        ("a", "vendor_invoice_headers", 0, {"total_amount": "10.00", "_related": '{"invoice_line_items":[{"amount":"7"}]}'}),
        ("a", "vendor_invoice_headers", 1, {"total_amount": "3"}),
        ("b", "bank_statement_headers", 0, {"closing_balance": "9"}),
        ("b", "bank_statement_transactions", 0, {"balance": "5", "deposit_amount": "5"}),
        ("b", "bank_statement_transactions", 1, {"balance": "8", "deposit_amount": "2"}),
    ], "document_id string, target_table string, row_index long, data map<string,string>")
    sources = spark.createDataFrame([("a", "Total 11.00")], "document_id string, source_text string")
    found = lambda **kw: sorted(critic.document_violations(rows, sources=sources, **kw).select("document_id", "rule_id").collect())
    parts = {c: found(checks=(c,)) for c in critic.CHECKS}
    assert sorted(sum(parts.values(), [])) == found()
    assert [r.rule_id for r in parts["grounding"]] == ["grounding.value_not_in_source.total_amount"]
    assert ("a", "cross.inv.header_vs_lines") in parts["between"] and ("b", "bank.tx.running_balance") in parts["transactions"]
    critic.document_violations(rows, sources=sources, checks=("grounding",)).explain()
    assert "Aggregate" not in capsys.readouterr().out
    with pytest.raises(ValueError):
        critic.document_violations(rows, checks=("all",))


@pytest.mark.parametrize("inclusive", (False, True))
def test_carried_values_come_back_without_a_join(spark, inclusive):
    """The last value before each row, whatever the width; the input is shuffled once for rows and summary."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]), i, rng.choice([None, None, None, f"v{i}"]), rng.choice([None, i])) for i in rng.sample(range(400), 120)]
    df = spark.createDataFrame([*rows, ("c", 3, None, None), ("c", 300, None, 1)], "k string, i long, v string, _row long")
    want = {}
    for k, i, _, _ in rows:
        before = [r for r in rows if r[0] == k and (r[1] < i or (inclusive and r[1] == i))]
        want[k, i] = tuple(max(((r[1], r[c]) for r in before if r[c] is not None), default=(0, None))[1] for c in (2, 3))
    want |= {("c", 3): (None, None), ("c", 300): (None, 1 if inclusive else None)}
    for width in (1, 16, 1000):
        out = segmented.carry_last(df, ["k"], "i", {"v": "p", "_row": "q"}, inclusive=inclusive, width=width)
        assert out.columns == ["k", "i", "v", "_row", "p", "q"]
        got = out.collect()
        assert len(got) == len(want) and {(r.k, r.i): (r.p, r.q) for r in got} == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_stitched_rows_parse_each_table_once(spark):
    """What the joins read is parsed already, and heads bring their headers only."""
    nodes = [("d", i, i // 2, "TABLE", '{"Item":["%d"],"Amount":["1"]}' % i) for i in range(6)] + [("e", 0, None, "TABLE", "| A | B |\n|---|---|\n| 1 | 2 |")]
    df = spark.createDataFrame(nodes, "document_id string, ord long, page int, type string, content string")
    rows = stitching.stitched_rows(df, ["document_id"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "head_table" in plan
    got = sorted((r["document_id"], r["head"], r["part"], r["headers"], r["values"]) for r in rows.collect())
    heads = stitch_reference([(d, o, kind, content, page) for d, o, page, kind, content in nodes[:6]])
    assert [g[:3] for g in got[:6]] == [("d", heads["d", i], i) for i in range(6)]
    assert got[6] == ("e", 0, 0, ["A", "B"], ["1", "2"])
    assert stitching.stitched_rows(df.limit(0), ["document_id"]).collect() == []


def test_weak_text_with_any_blanks(spark):
    texts = [None, "", "  \n", "a", "　" * 200 + "note" + "\t" * 200, "x" * 200, " \x1c "]
    df = spark.createDataFrame([("TEXT", t) for t in texts], "k string, c string")
    assert [r[0] for r in df.select(stitching.is_weak(F.col("k"), F.col("c"))).collect()] == [False, False, False, True, True, False, False]
