"""Questions in words: intent, entities, a plan of operations, results with evidence and confidence. The plan is made on
the driver, every step is a lazy DataFrame; the wording of answers is left out."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field
from datetime import date
from graphlib import CycleError, TopologicalSorter

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import operations as ops
from ledgerloom.operators import records
from ledgerloom.operators.records import records as read
from ledgerloom.plans.periods import period_of

# Words that tell an intent, looked for in this order as whole words.
INTENTS = [
    ("INVESTIGATION", "why did|why has|why was|why spend|explain why|reason for|spending increase|spend increase|investigate|what caused"),
    ("ANOMALIES", "unusual|anomalous|anomaly|anomalies|outliers?"), ("FINDINGS", "mismatch(?:es)?|rule violations?|violations?|missing po|without po|duplicates?"), ("OVERDUE_INVOICES", "overdue|past due"),
    ("UNPAID_INVOICES", "unpaid|pending payment|not paid|outstanding invoices"), ("SPEND_COMPARISON", "compare|difference between|versus|vs"), ("TOP_VENDORS", "top vendors?|highest spend|most spend|top \\d+|biggest vendors?"),
    ("RELATIONSHIPS", "connected to|relations?|relationships?|linked to|associated with|path between|vendor network"), ("DOCUMENT_SEARCH", "mentioning|containing|related to|about|find invoices|search for"),
]
FORMATS = {"invoice_number": r"\b(INV[-/ ]?[A-Z0-9][A-Z0-9/-]*)\b", "po_number": r"\b(PO[-/ ]?[0-9][A-Z0-9/-]*)\b", "payment_reference": r"\b((?:PAY|UTR)[-/ ]?[0-9][A-Z0-9/-]*)\b"}
LEADS = r"^(?:please\s+)?(?:(?:find|show|list|search)(?:\s+(?:me|for|all))*\s+)?(?:(?:invoices?|documents?|line items?)\s+)?(?:mentioning|containing|related to|about|for)\s+"
FOLLOW_UP = r"\b(?:their|that vendor|it|what about|how about|same|and for)\b"


@dataclass
class Context:
    """What a conversation is about."""

    vendor_id: str | None = None
    period: tuple[date, date] | None = None
    intent: str | None = None


@dataclass
class Step:
    name: str
    operation: str
    args: dict[str, object] = field(default_factory=dict)
    needs: list[str] = field(default_factory=list)


@dataclass
class Plan:
    question: str
    intent: str
    entities: dict[str, str]
    period: tuple[date, date] | None
    steps: list[Step]
    open: list[str]


@dataclass
class StepResult:
    name: str
    operation: str
    data: DataFrame | None
    rows: list
    error: str | None
    ms: float


@dataclass
class Answer:
    plan: Plan
    results: list[StepResult]
    evidence: list[dict]
    confidence: float
    remarks: dict[str, object]
    context: Context


def intent_of(question: str, entities: dict[str, str]) -> str:
    q = question.lower()
    for name, words in INTENTS:
        if re.search(rf"\b(?:{words})\b", q):
            return name
    for key, name in (("invoice_number", "INVOICE_LOOKUP"), ("po_number", "ORDER_LOOKUP"), ("payment_reference", "PAYMENT_LOOKUP")):
        if key in entities:
            return name
    if re.search(r"\b(?:month|monthly)\b", q):
        return "MONTHLY_SPEND"
    if re.search(r"\b(?:how much|total spend|spend|spent|cost us)\b", q):
        return "VENDOR_SPEND" if "vendor_id" in entities or "vendor_name" in entities else "TOTAL_SPEND"
    return "GENERAL"


def spellings(number: str) -> list[str]:
    """Ways a number may be written in the records."""
    bare = re.sub(r"[\s/]", "-", number.strip().upper())
    digits = re.sub(r"^[A-Z]+-?", "", bare)
    head = re.match(r"[A-Z]*", bare).group(0)
    return list(dict.fromkeys([number.strip(), bare, f"{head}-{digits}" if head else digits, f"{head}{digits}", digits]))


def entities_of(question: str, vendors: DataFrame, org: str) -> dict[str, str]:
    """Numbers by their form and the vendor with the longest name the question mentions; a capitalised name nobody has
    is left open. The vendors are searched on the cluster; one row comes back."""
    out = {}
    for key, pattern in FORMATS.items():
        m = re.search(pattern, question, re.I)
        if m and re.search(r"\d", m[1]):
            out[key] = m[1]
    spark = vendors.sparkSession
    text = spark.createDataFrame([(org, "q", question)], "organization_id string, id string, text string")
    hit = ops.longest_mentions(text, ops.within(vendors, org)).first()
    if hit:
        out["vendor_id"], out["vendor_name"] = hit.vendor_id, hit.name
    else:
        m = re.search(r"\b(?:with|from|to|vendor|by|for)\s+((?:[A-Z][\w&.-]+\s?){1,4})", question)
        if m and not re.match(r"(?:Q[1-4]|January|February|March|April|May|June|July|August|September|October|November|December)\b", m[1]):
            out["unresolved"] = m[1].strip()
    return out


def search_text(question: str) -> str:
    """What is to be searched, without the words that ask for it."""
    return re.sub(LEADS, "", question.strip().rstrip("?."), flags=re.I).strip()


def plan_of(question: str, entities: dict[str, str], today: date, context: Context | None = None) -> Plan:
    """The steps for a question; what it leaves out is taken from the context where it refers to it."""
    entities, remarks = dict(entities), []
    period = period_of(question, today)
    if context and re.search(FOLLOW_UP, question.lower()):
        if "vendor_id" not in entities and context.vendor_id:
            entities["vendor_id"] = context.vendor_id
        period = period or context.period
    intent = intent_of(re.sub(r"\b(?:what about|how about|and for)\b", " ", question, flags=re.I), entities)
    if intent == "GENERAL" and context and context.intent and re.search(FOLLOW_UP, question.lower()):
        intent = context.intent
    if "unresolved" in entities:
        remarks.append(f"no vendor is called {entities['unresolved']}")
    span = {"start": str(period[0]), "end": str(period[1])} if period else {}
    who = {"vendor_id": entities["vendor_id"]} if "vendor_id" in entities else {}
    one = lambda op, **args: [Step("s1", op, args)]
    if intent in ("VENDOR_SPEND", "TOTAL_SPEND"):
        steps = one("GET_VENDOR_TOTAL_SPEND", **who, **span)
    elif intent == "MONTHLY_SPEND":
        steps = one("GET_MONTHLY_VENDOR_SPEND", **who, **span)
    elif intent == "SPEND_COMPARISON":
        steps = one("COMPARE_VENDOR_SPEND", **who, **span)
    elif intent == "TOP_VENDORS":
        n = re.search(r"\btop (\d+)\b", question.lower())
        steps = one("GET_TOP_VENDORS", limit=int(n[1]) if n else 5, **span)
    elif intent == "UNPAID_INVOICES":
        steps = one("GET_UNPAID_INVOICES", **who)
    elif intent == "OVERDUE_INVOICES":
        steps = one("GET_OVERDUE_INVOICES", as_of=str(today))
    elif intent == "INVOICE_LOOKUP":
        steps = [Step("s1", "GET_INVOICE_BY_NUMBER", {"number": entities["invoice_number"]}), Step("s2", "GET_INVOICE_LINE_ITEMS", {}, ["s1"]), Step("s3", "GET_PAYMENTS_FOR_INVOICE", {}, ["s1"])]
    elif intent == "ORDER_LOOKUP":
        steps = one("GET_PURCHASE_ORDER", number=entities["po_number"])
    elif intent in ("FINDINGS", "ANOMALIES"):
        steps = one("GET_FINDINGS", kind="OUTLIER" if intent == "ANOMALIES" else None, **span)
    elif intent == "DOCUMENT_SEARCH":
        steps = one("DOCUMENT_SEARCH", text=search_text(question))
    elif intent == "RELATIONSHIPS":
        steps = one("GET_VENDOR_NETWORK", **who)
    else:
        steps = one("GET_INVOICES_FOR_PERIOD", **who, **span)
    return Plan(question, intent, entities, period, steps, remarks)


def operations(spark: SparkSession, sf: str, org: str) -> dict[str, Callable[..., DataFrame]]:
    """The approved operations over one organisation's records. Steps that need others get their results first."""
    t = lambda name, columns: ops.within(read(spark, sf, name, columns), org)
    names = "vendor_id vendor_name_raw vendor_name_normalized "
    links = lambda: t("document_link", "link_type source_type source_id target_id status")

    def by_number(number: str) -> DataFrame:
        x = t("invoice", names + "invoice_number invoice_date total_amount seq")
        wanted = [s.lower() for s in spellings(number)]
        return ops.lookup(x.filter(F.lower(F.trim("invoice_number")).isin(wanted)), order="seq")

    def compare(start: str | None = None, end: str | None = None, vendor_id: str | None = None) -> DataFrame:
        from ledgerloom.plans.periods import baseline_of

        x = t("invoice", "vendor_id invoice_date total_amount")
        x = x.filter(F.col("vendor_id") == vendor_id) if vendor_id else x
        if not start or not end:
            raise ValueError("a comparison needs a period")
        before = baseline_of(date.fromisoformat(start), date.fromisoformat(end))
        return records.compare_spend(x, (str(before[0]), str(before[1])), (start, end))

    def findings(kind: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        inv = t("invoice", "invoice_number vendor_id vendor_name_raw invoice_date total_amount seq")
        found = ops.findings(records.duplicate_invoices(inv), records.amount_outliers(inv), links(), inv)
        found = ops.findings_in_period(found, inv, start, end) if start or end else found
        return ops.ranked_findings(found.filter(F.col("kind") == kind) if kind else found)

    def network(vendor_id: str | None = None) -> DataFrame:
        from ledgerloom.operators import graph

        nodes, edges = graph.build(t("vendor", "tax_id bank_account"), t("invoice", "vendor_id"), t("purchase_order", "vendor_id"), links())
        seeds = nodes.filter("label = 'Vendor'").filter(F.col("id") == vendor_id if vendor_id else F.lit(True)).select("organization_id", F.col("id").alias("root"))
        return graph.neighbourhood(edges, seeds, 2)

    def document_search(text: str, top: int = 10) -> DataFrame:
        from ledgerloom.operators import vectors
        from ledgerloom.session import table

        chunks = ops.within(table(spark, sf, "chunk"), org).select("chunk_id", "text").distinct()
        rows = vectors.sparse_embedding(chunks, "chunk_id", "text")
        q = vectors.sparse_embedding(spark.createDataFrame([("q", text)], "chunk_id string, text string"), "chunk_id", "text").select("bucket", F.col("weight").alias("q"))
        hits = rows.join(F.broadcast(q), "bucket").groupBy("chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("q")), 4).alias("score")).filter("score > 0")  # a vector of 128 places at most
        return hits.orderBy(F.desc("score"), "chunk_id").limit(top)

    return {
        "GET_VENDOR_TOTAL_SPEND": lambda **a: ops.vendor_total_spend(t("invoice", names + "invoice_date total_amount"), **a),
        "GET_MONTHLY_VENDOR_SPEND": lambda **a: ops.monthly_vendor_spend(t("invoice", names + "invoice_date total_amount"), **a),
        "GET_VENDOR_INVOICE_COUNT": lambda **a: ops.vendor_invoice_count(t("invoice", "vendor_id"), **a),
        "GET_UNPAID_INVOICES": lambda **a: ops.unpaid_invoices(t("invoice", names + "payment_status amount_due ingested_at"), **a),
        "GET_OVERDUE_INVOICES": lambda **a: ops.overdue_invoices(t("invoice", "payment_status due_date"), **a),
        "GET_INVOICE_BY_NUMBER": by_number,
        "GET_PURCHASE_ORDER": lambda number: ops.order_detail(t("purchase_order", "po_number line_items"), links(), po_number=number),
        "GET_PAYMENTS_FOR_INVOICE": lambda s1: links().filter("link_type = 'PAYMENT_TO_INVOICE'").join(s1.select(F.col("id").alias("target_id")), "target_id", "left_semi"),
        "GET_TOP_VENDORS": lambda **a: ops.top_vendors(t("invoice", names + "invoice_date total_amount"), **a),
        "GET_INVOICES_FOR_PERIOD": lambda start=None, end=None, **a: ops.invoices_for_period(t("invoice", "vendor_id invoice_date"), start, end, **a),
        "GET_INVOICE_LINE_ITEMS": lambda s1: ops.line_items(t("invoice_line", "invoice_id product_code quantity unit_price total"), s1),
        "COMPARE_VENDOR_SPEND": compare, "GET_FINDINGS": findings, "GET_VENDOR_NETWORK": network, "DOCUMENT_SEARCH": document_search,
    }


def execute(plan: Plan, allowed: dict[str, Callable[..., DataFrame]], most_rows: int = 100, seconds: float = 15.0, most_steps: int = 10) -> list[StepResult]:
    """Runs the steps in the order of their needs, those of one layer at once. A step that fails, is not allowed or takes
    too long fails alone, as do steps that need it; its Spark jobs are cancelled. A cycle fails all."""
    if len(plan.steps) > most_steps:
        raise ValueError(f"a plan has at most {most_steps} steps")
    by_name = {s.name: s for s in plan.steps}
    order = TopologicalSorter({s.name: set(s.needs) for s in plan.steps})
    try:
        order.prepare()
    except CycleError as e:
        return [StepResult(s.name, s.operation, None, [], f"cycle: {e.args[1]}", 0.0) for s in plan.steps]
    done: dict[str, StepResult] = {}
    sc = SparkContext.getOrCreate()
    groups = {s.name: f"step-{uuid.uuid4().hex}" for s in plan.steps}

    def one(step: Step) -> StepResult:
        began = time.time()
        try:
            sc.setJobGroup(groups[step.name], step.operation, True)  # of this thread
            if step.operation not in allowed:
                raise KeyError(f"no such operation: {step.operation}")
            bad = [n for n in step.needs if done[n].data is None]
            if bad:
                raise RuntimeError(f"{bad[0]} failed")
            df = allowed[step.operation](**step.args, **{n: done[n].data for n in step.needs})
            return StepResult(step.name, step.operation, df, df.limit(most_rows).collect(), None, (time.time() - began) * 1000)
        except Exception as e:  # noqa: BLE001 - a step's failure is its result
            return StepResult(step.name, step.operation, None, [], str(e), (time.time() - began) * 1000)

    with ThreadPoolExecutor(4) as pool:
        while order.is_active():
            layer = [by_name[n] for n in order.get_ready()]
            runs = [(s, pool.submit(one, s)) for s in layer]
            for s, run in runs:
                try:
                    done[s.name] = run.result(timeout=seconds)
                except Late:
                    run.cancel()
                    sc.cancelJobGroup(groups[s.name])
                    done[s.name] = StepResult(s.name, s.operation, None, [], f"longer than {seconds} s", seconds * 1000)
                order.done(s.name)
    return [done[s.name] for s in plan.steps]


def evidence_of(results: list[StepResult]) -> list[dict]:
    """Records that back the results, each once, the surest first."""
    seen: dict[tuple, dict] = {}
    for r in results:
        for row in r.rows:
            d = row.asDict()
            key = (r.operation, d.get("id") or d.get("invoice_id") or d.get("chunk_id") or d.get("vendor_id") or str(d))
            seen.setdefault(key, {"operation": r.operation, "record": key[1], "confidence": float(d.get("confidence") or d.get("score") or 1.0)})
    return sorted(seen.values(), key=lambda e: -e["confidence"])


def confidence_of(plan: Plan, results: list[StepResult], evidence: list[dict]) -> float:
    """Of plan, steps that succeeded, records found and how sure they are; 0.1 without any result."""
    if not results:
        return 0.1
    planned = 0.75 * 0.8 if plan.open else 1.0
    worked = [r for r in results if r.error is None]
    found = 1.0 if any(r.rows for r in worked) else 0.7
    backed = 0.8 + 0.2 * min(1.0, sum(e["confidence"] for e in evidence) / len(evidence)) if evidence else 0.6
    return round(max(0.05, min(1.0, planned * len(worked) / len(results) * found * backed)), 2)


def remarks_of(results: list[StepResult]) -> dict[str, object]:
    """What follows from the rows alone: the change between the last two months, how many findings of which kind."""
    out: dict[str, object] = {}
    for r in results:
        rows = [x.asDict() for x in r.rows]
        if r.operation == "GET_MONTHLY_VENDOR_SPEND" and len(rows) >= 2:
            a, b = sorted(rows, key=lambda x: x["month"])[-2:]
            out["last_change"] = round(b["spend"] - a["spend"], 2)
            out["last_change_pct"] = round((b["spend"] - a["spend"]) / a["spend"] * 100, 2) if a["spend"] > 0 else None
        if r.operation == "GET_FINDINGS":
            kinds = [x["kind"] for x in rows]
            out["findings"] = {k: kinds.count(k) for k in sorted(set(kinds))}
    return out


def ask(spark: SparkSession, sf: str, org: str, question: str, today: date, context: Context | None = None) -> Answer:
    """Question -> plan -> results -> evidence, confidence, remarks, and the context for the next question."""
    vendors = read(spark, sf, "vendor", "normalized_name")
    plan = plan_of(question, entities_of(question, vendors, org), today, context)
    results = execute(plan, operations(spark, sf, org))
    evidence = evidence_of(results)
    after = Context(plan.entities.get("vendor_id") or (context.vendor_id if context else None), plan.period or (context.period if context else None), plan.intent)
    return Answer(plan, results, evidence, confidence_of(plan, results, evidence), remarks_of(results), after)
