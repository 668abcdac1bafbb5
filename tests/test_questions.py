"""Plans of questions, investigations, routes, payments, graph and vectors on small tables."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import api
from ledgerloom.operators import graph, payments, vectors
from ledgerloom.operators import operations as ops
from ledgerloom.operators.records import records
from ledgerloom.plans import investigation as inv
from ledgerloom.plans import questions as q
from ledgerloom.sources import files, sinks

TODAY = date(2025, 8, 15)


def test_intents_and_plans():
    plan = lambda text, e=None, c=None: q.plan_of(text, e or {}, TODAY, c)
    assert plan("Why did spend with Acme increase?").intent == "INVESTIGATION" and plan("Show overdue invoices").steps[0].args == {"as_of": "2025-08-15"}
    assert plan("top 3 vendors last month").steps[0].args == {"limit": 3, "start": "2025-07-01", "end": "2025-07-31"}
    assert plan("invoices of my vsam system").intent != "SPEND_COMPARISON" and plan("compare Q1 2025 vs before").intent == "SPEND_COMPARISON"
    assert [s.needs for s in plan("show INV-7", {"invoice_number": "INV-7"}).steps] == [[], ["s1"], ["s1"]]
    before = q.Context("v1", (date(2025, 1, 1), date(2025, 1, 31)), "VENDOR_SPEND")
    assert plan("what about July?", None, before).steps[0].args["vendor_id"] == "v1" and plan("invoices with items", None, before).entities == {}
    assert q.spellings("inv/12")[1:] == ["INV-12", "INV12", "12"] and q.search_text("Find invoices mentioning steel bolts?") == "steel bolts"


def test_execution_and_confidence(spark):
    data = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "id string, confidence double")
    allowed = {"rows": lambda **a: data, "more": lambda s1: s1.filter("id = 'a'"), "fail": lambda: 1 / 0, "slow": lambda: __import__("time").sleep(3)}
    step = lambda name, op, *needs: q.Step(name, op, {}, list(needs))
    plan = q.Plan("", "X", {}, None, [step("s2", "more", "s1"), step("s1", "rows"), step("s3", "fail"), step("s4", "more", "s3"), step("s5", "none")], [])
    got = q.execute(plan, allowed)
    assert [len(r.rows) for r in got] == [1, 2, 0, 0, 0] and [bool(r.error) for r in got] == [False, False, True, True, True]
    found = q.evidence_of(got)
    assert [e["record"] for e in found] == ["b", "a", "a"] and q.confidence_of(plan, got, found) == round(0.4 * (0.8 + 0.2 * (0.9 + 0.5 + 0.5) / 3), 2) and q.confidence_of(plan, [], []) == 0.1
    assert all(r.error.startswith("cycle") for r in q.execute(q.Plan("", "X", {}, None, [step("a", "rows", "b"), step("b", "rows", "a")], []), allowed))
    assert "longer" in q.execute(q.Plan("", "X", {}, None, [step("a", "slow")], []), allowed, seconds=0.2)[0].error
    with pytest.raises(ValueError):
        q.execute(q.Plan("", "X", {}, None, [step(str(i), "rows") for i in range(11)], []), allowed)


def test_asking_and_routes(spark, small):
    org = records(spark, small, "invoice", "").groupBy("organization_id").count().orderBy(F.desc("count"), "organization_id").first().organization_id
    answer = q.ask(spark, small, org, "How much did we spend in total?", TODAY)
    assert answer.plan.intent == "TOTAL_SPEND" and answer.results[0].rows[0].invoices > 0 and 0.5 < answer.confidence <= 1
    assert "findings" in q.ask(spark, small, org, "any duplicates or violations?", TODAY).remarks
    late = q.ask(spark, small, org, "monthly spend", TODAY)
    assert late.plan.intent == "MONTHLY_SPEND" and late.results[0].error is None
    assert api.call("health", spark, small).first().status == "ok" and api.call("invoices", spark, small, org=org, limit=3).count() <= 3
    assert api.call("graph/stats", spark, small, org=org).filter("kind = 'Vendor'").count() == 1 and api.call("search/semantic", spark, small, org=org, text="invoice total", top=2).count() <= 2
    assert api.call("investigate", spark, small, org=org, question="why did spend rise in Q2 2025", today=TODAY).state == "COMPLETED"
    assert len(api.ROUTES) == 30
    with pytest.raises(KeyError):
        api.call("none", spark, small)


def test_investigation_states(spark):
    run = inv.Investigation("why", TODAY, most_steps=2)
    run.step("PLANNING")
    with pytest.raises(ValueError):
        run.step("PLANNING")
    run.step("COMPARING")
    with pytest.raises(RuntimeError):
        run.step("FINDINGS")
    assert run.state == "PARTIAL"
    broken = inv.investigate("why in Q2 2025", TODAY, spark.range(1), spark.range(1), spark.range(1))
    assert broken.state == "FAILED" and broken.limits and broken.trace
    assert inv.kind_of("why did it drop") == "SPEND_DECREASE" and inv.kind_of("hm") == "SPEND_INCREASE"


def test_investigation_explains_a_change(spark):
    i = spark.createDataFrame([("o", "i1", "v", "2025-06-03", Decimal("1000")), ("o", "i2", "v", "2025-07-03", Decimal("5500")), ("o", "i3", "w", "2025-07-03", Decimal("9"))], "organization_id string, id string, vendor_id string, d string, total_amount decimal(15,2)").withColumn("invoice_date", F.col("d").cast("date"))
    li = spark.createDataFrame([("o", "l1", "i1", "p", 10.0, 1000.0), ("o", "l2", "i2", "p", 10.0, 4000.0), ("o", "l3", "i2", "q", 1.0, 1500.0)], "organization_id string, id string, invoice_id string, product_code string, quantity double, total double")
    found = spark.createDataFrame([], "organization_id string, invoice_id string, kind string, impact double, detail string")
    run = inv.investigate("why did spend increase in July 2025", TODAY, i, li, found)
    r = run.result.filter("vendor_id = 'v'").first()
    assert (r.delta, r.explained, r.unexplained, r.confidence, r.findings) == (4500.0, 4500.0, 0.0, 1.0, 2)
    assert [(f.kind, f.impact) for f in run.findings.orderBy("place").collect()] == [("PRICE_CHANGE", 3000.0), ("NEW_LINE_ITEM", 1500.0)]


def test_payments(spark):
    p = spark.createDataFrame(
        [("o", "p1", "R1", Decimal("60"), "COMPLETED", "2025-01-01", [" A ", "A", "zz"]), ("o", "p2", " R1", Decimal("40"), "COMPLETED", "2025-01-02", ["A", "B"]), ("o", "p3", "R3", Decimal("99"), "BOUNCED", "2025-01-03", ["C"]), ("p", "p4", "R1", Decimal("1"), "COMPLETED", "2025-01-01", None)],
        "organization_id string, id string, reference string, amount decimal(15,2), status string, paid_on string, referenced_invoice_numbers array<string>",
    )
    i = spark.createDataFrame([("o", "a", "A", Decimal("100.5")), ("o", "a2", "A", Decimal("7")), ("o", "b", "B", Decimal("10")), ("o", "c", "C", Decimal("99"))], "organization_id string, id string, invoice_number string, total_amount decimal(15,2)")
    links = payments.payment_links(p, i)
    assert {(r.payment_id, r.invoice_id) for r in links.collect()} == {("p1", "a"), ("p2", "a"), ("p2", "b"), ("p3", "c")}
    assert {r.id: (r.paid, r.settled) for r in payments.paid_totals(i, p, links).collect()} == {"a": (100.0, "paid"), "a2": (0.0, "unpaid"), "b": (40.0, "overpaid"), "c": (0.0, "unpaid")}
    assert [(r.duplicate_id, r.original_id) for r in payments.repeated_payments(p).collect()] == [("p2", "p1")]


def test_names_pages_and_details(spark):
    i = spark.createDataFrame([("o", str(n), "v", "100% Co" if n % 2 else "1000 Co", None, Decimal(n), None) for n in range(7)], "organization_id string, id string, vendor_id string, vendor_name_raw string, vendor_name_normalized string, total_amount decimal(15,2), invoice_date date")
    assert ops.vendor_total_spend(i, vendor_name="0% c").first().invoices == 3 and ops.vendor_total_spend(i, "other").count() == 0
    second = ops.invoices_for_period(i, None, None, limit=3, offset=3).collect()
    assert [r.id for r in sorted(second, key=lambda r: r.place)] == ["3", "4", "5"] and {r.total for r in second} == {7}
    assert ops.page(i.limit(0), [F.asc("id")]).count() == 0


def test_graph_parts(spark):
    old = spark.createDataFrame([("o", "a", "Vendor", {"name": "x", "city": "y"})], "organization_id string, id string, label string, attributes map<string,string>")
    new = spark.createDataFrame([("o", "a", "Vendor", {"name": "z"}), ("o", "b", "Invoice", {})], old.schema)
    assert {r.id: r.attributes for r in graph.upsert_nodes(old, new).collect()} == {"a": {"name": "z", "city": "y"}, "b": {}}
    nodes = spark.createDataFrame([("o", "a", "V"), ("o", "b", "I"), ("p", "c", "V")], "organization_id string, id string, label string")
    edges = spark.createDataFrame([("o", "a", "b", "R"), ("o", "b", "d", "R"), ("p", "c", "e", "R")], "organization_id string, src string, dst string, relation string")
    assert [x.count() for x in graph.clear(nodes, edges, "o")] == [1, 1] and [x.count() for x in graph.clear(nodes, edges)] == [0, 0] and graph.get_node(nodes, "c", "o").count() == 0
    around = graph.neighbourhood(edges, spark.createDataFrame([("o", "a")], "organization_id string, root string"), 1)
    assert [(r.src, r.dst) for r in graph.induced(edges, around).collect()] == [("a", "b")]


def test_vectors_with_filters(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 5)], "x" if i % 2 else "y", {"k": "1"} if i % 3 else {}) for i in range(40)] + [(99, [-1.0, 0.0], "x", None), (100, None, "x", None)], "id int, v array<double>, scope_of string, metadata map<string,string>")
    got = vectors.search(rows.filter("id = 1"), rows, "id", "v", 50, block=1, batch=7, scope="scope_of", positive=True).collect()
    assert {r.id for r in got} == {i for i in range(3, 40, 2)} and sorted(r.place for r in got) == list(range(1, 20))
    assert vectors.metadata_filter(rows, {"k": "1"}).count() == 42 and vectors.metadata_filter(rows, {"k": "2"}).count() == 16
    chunk = "chunk_id string, ingested_at int, text string"
    up = vectors.upsert_chunks(spark.createDataFrame([("a", 1, "old"), ("b", 1, "kept")], chunk), spark.createDataFrame([("a", 5, "second"), ("a", 5, "first"), ("c", 2, "new")], chunk))
    assert {r.chunk_id: r.text for r in up.collect()} == {"a": "first", "b": "kept", "c": "new"}


def test_more_sinks_and_sources(spark, tmp_path):
    x = spark.createDataFrame([("o", "d1", "i1", [("l1", 2.0)], [("f", "v")], [("w", "low")])], "organization_id string, document_id string, id string, lines array<struct<line:string,qty:double>>, fields array<struct<name:string,value:string>>, issues array<struct<issue:string,severity:string>>")
    sinks.fan_out(x, str(tmp_path))
    assert [spark.read.parquet(str(tmp_path / t)).count() for t in ("invoice", "invoice_line", "extracted_field", "issue")] == [1, 1, 1, 1]
    orders = spark.createDataFrame([("o", "p1", [("a", 1)])], "organization_id string, id string, line_items array<struct<code:string,n:int>>")
    sinks.order_tables(orders, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "purchase_order_line")).first().po_id == "p1"
    pay = sinks.new_payments(spark.createDataFrame([("o", " R ", "5", None, "2025"), ("o", " R ", "5", None, "2025")], "organization_id string, reference string, amount string, status string, paid_on string")).collect()
    assert pay[0].id == pay[1].id and pay[0].reference == "R" and pay[0].status == "COMPLETED"
    events = spark.createDataFrame([("o", "d", "UPLOADED", 1), ("o", "d", "DONE", 3), ("o", "d", "READ", 2)], "organization_id string, document_id string, status string, at int")
    assert sinks.latest_status(events).first().status == "DONE"
    region = "doc_id string, page_number int, id string, region_type string, reading_order int, bbox struct<x1:int,y1:int,x2:int,y2:int>, confidence double, raw_ocr_output string"
    r = spark.createDataFrame([("d", 1, "a", "text", 1, (0, 0, 9, 9), 0.9, "Invoice No: 7"), ("d", 2, "b", "text", 1, (0, 0, 9, 9), 0.9, "Total: 5")], region)
    sinks.write_json(r, str(tmp_path / "json"))
    back = files.stored_regions(spark, str(tmp_path / "json"))
    assert back.select(*r.columns).exceptAll(r).count() == 0 and api.call("finance/extract", spark, "", path=str(tmp_path / "json")).first().document_type == "INVOICE"
    sinks.write_graph(spark.createDataFrame([("o", "a", "V")], "organization_id string, id string, label string"), spark.createDataFrame([("o", "a", "b", "R")], "organization_id string, src string, dst string, relation string"), str(tmp_path / "g"))
    sinks.write_index(spark.createDataFrame([("o", "c", [0.5, 0.5])], "organization_id string, chunk_id string, embedding array<double>"), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 1 and spark.read.parquet(str(tmp_path / "index")).first().embedding == [0.5, 0.5]
    (tmp_path / "up").mkdir()
    (tmp_path / "up/a.png").write_bytes(b"img")
    (tmp_path / "up/b.txt").write_text("TAX INVOICE")
    up = files.uploads(spark, str(tmp_path / "up"))
    assert files.recognised(up, None).first().status == "FAILED" and files.load_documents(up).count() == 1
    assert {r.raw_ocr_output for r in files.load_documents(up, lambda name, data: [f"page of {len(data)}"]).collect()} == {"TAX INVOICE", "page of 3"}
    demo = files.demo_records(spark)
    assert demo.count() == 84 and ops.monthly_vendor_spend(demo).count() == 7 and demo.select("invoice_number").distinct().count() == 83
