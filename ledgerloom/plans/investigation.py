"""Why spend changed between two periods, for all vendors at once; one vendor is a filter on the result."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.operations import ORG, change_pct
from ledgerloom.plans.periods import _month, baseline_of, period_of

Period = tuple[str, str]
KEY = [ORG, "vendor_id"]


def _inside(p: Period):
    return F.col("invoice_date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))


def spend_change(invoices: DataFrame, before: Period, after: Period) -> DataFrame:
    """organization_id, vendor_id, both sums and counts, delta and per cent: one scan tagged by period."""
    x = invoices.filter(F.col("vendor_id").isNotNull() & (_inside(before) | _inside(after))).groupBy(*KEY)
    part = lambda p: F.coalesce(F.sum(F.when(_inside(p), F.col("total_amount"))), F.lit(0)).cast("double")
    y = x.agg(part(before).alias("spend_before"), part(after).alias("spend_after"), F.count_if(_inside(before)).alias("invoices_before"), F.count_if(_inside(after)).alias("invoices_after"))
    return y.withColumn("delta", F.round(F.col("spend_after") - F.col("spend_before"), 2)).withColumn("change_pct", change_pct(F.col("spend_before"), F.col("spend_after")))


def line_findings(lines: DataFrame, invoices: DataFrame, before: Period, after: Period) -> DataFrame:
    """organization_id, vendor_id, kind, subject, impact, severity: what price and quantity of a product changed, and
    products that are new. Products are aggregated per period before they are compared."""
    tagged = invoices.filter(F.col("vendor_id").isNotNull() & (_inside(before) | _inside(after))).select(ORG, F.col("id").alias("invoice_id"), "vendor_id", _inside(before).alias("early"))
    x = lines.filter("product_code is not null and quantity is not null and total is not null").join(tagged, [ORG, "invoice_id"])
    pick = lambda early, c: F.sum(F.when(F.col("early") == early, F.col(c))).cast("double")
    g = x.groupBy(*KEY, F.col("product_code").alias("subject")).agg(pick(True, "quantity").alias("bq"), pick(True, "total").alias("bt"), pick(False, "quantity").alias("aq"), pick(False, "total").alias("at"))
    pb, pa = F.when(F.col("bq") > 0, F.col("bt") / F.col("bq")), F.when(F.col("aq") > 0, F.col("at") / F.col("aq"))
    price, amount, new = F.round((pa - pb) * F.col("aq"), 2), F.round((F.col("aq") - F.col("bq")) * pb, 2), F.when(F.col("bt").isNull(), F.round("at", 2))
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("impact")) for k, v in (("PRICE_CHANGE", price), ("QUANTITY_CHANGE", amount), ("NEW_LINE_ITEM", new))]), lambda f: f.impact.isNotNull() & (f.impact != 0))
    y = g.select(*KEY, "subject", F.inline(each))
    limit = F.when(F.col("kind") == "NEW_LINE_ITEM", 20000).otherwise(10000)
    return y.select(*KEY, "kind", "subject", "impact", F.when(F.col("impact") < 0, "INFO").when(F.col("impact") > limit, "HIGH").otherwise("MEDIUM").alias("severity"))


def record_findings(found: DataFrame, invoices: DataFrame, after: Period) -> DataFrame:
    """Findings about invoices as findings of their vendors: those of the later period are CRITICAL where an invoice is
    repeated; outliers count without an impact, as they explain nothing."""
    inv = invoices.filter("vendor_id is not null").select(ORG, F.col("id").alias("invoice_id"), "vendor_id", _inside(after).alias("inside"))
    x = found.join(inv, [ORG, "invoice_id"]).filter(F.coalesce("inside", F.lit(False)) | (F.col("kind") == "OUTLIER"))
    kind = F.col("kind")
    return x.select(*KEY, kind, F.col("invoice_id").alias("subject"), F.when(kind == "DUPLICATE", F.col("impact")).otherwise(0.0).alias("impact"), F.when(kind == "DUPLICATE", "CRITICAL").when(kind == "OUTLIER", F.when(F.coalesce("inside", F.lit(False)), "HIGH").otherwise("MEDIUM")).otherwise("HIGH").alias("severity"))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings by impact within their vendor."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("impact"), "kind", "subject")
    return findings.withColumn("place", F.row_number().over(w))


def report(change: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a vendor: the change, what findings explain of it, what stays unexplained, and how sure that is:
    half for what is explained, three tenths for two findings or more, two tenths for later invoices; a vendor
    without change is sure as far as both periods have invoices."""
    by = findings.groupBy(*KEY).agg(F.count("*").alias("findings"), F.round(F.sum(F.when(F.col("impact") > 0, F.col("impact")).otherwise(0.0)), 2).alias("explained"), F.max_by("kind", F.struct("impact", "subject", "kind")).alias("main_driver"))
    x = change.join(by, KEY, "left").fillna(0, ["findings"]).fillna(0.0, ["explained"])
    size = F.abs("delta")
    cover = F.least(F.lit(1.0), F.col("explained") / size)
    backed = F.when(F.col("findings") >= 2, 1.0).when(F.col("findings") == 1, 0.75).otherwise(0.5)
    known = F.when(F.col("invoices_after") > 0, 1.0).otherwise(0.4)
    both = (F.col("invoices_before") > 0) & (F.col("invoices_after") > 0)
    sure = F.when(size > 0, F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.5 * cover + 0.3 * backed + 0.2 * known)), 2)).otherwise(F.when(both, 0.95).otherwise(0.55))
    return x.select(*KEY, "spend_before", "spend_after", "delta", "change_pct", "findings", "explained", F.round(F.greatest(F.lit(0.0), size - F.col("explained")), 2).alias("unexplained"), "main_driver", sure.alias("confidence"))


STATES = ["CREATED", "PLANNING", "BASELINE", "TARGET", "COMPARING", "LINE_ITEMS", "RECORDS", "FINDINGS", "COMPLETED"]


@dataclass
class Investigation:
    """A question about a change of spend as it is worked on: periods, state, trace, results."""

    question: str
    today: date
    vendor_id: str | None = None
    most_steps: int = 25
    state: str = "CREATED"
    trace: list[tuple[int, str, str]] = field(default_factory=list)
    limits: list[str] = field(default_factory=list)
    target: tuple[date, date] | None = None
    baseline: tuple[date, date] | None = None
    result: DataFrame | None = None
    findings: DataFrame | None = None

    def step(self, state: str, note: str = "") -> None:
        """States follow each other in their order; any may fail. Beyond ``most_steps`` the run stops."""
        if self.state in ("COMPLETED", "FAILED", "PARTIAL"):
            raise ValueError(f"{self.state} is final")
        if len(self.trace) >= self.most_steps:
            self.state = "PARTIAL"
            raise RuntimeError(f"stopped after {self.most_steps} steps")
        if state not in ("FAILED", "PARTIAL") and STATES.index(state) <= STATES.index(self.state):
            raise ValueError(f"{state} cannot follow {self.state}")
        self.state = state
        self.trace.append((len(self.trace) + 1, state, note))


def kind_of(question: str) -> str:
    q = question.lower()
    for kind, words in (("SPEND_DECREASE", ("decrease", "drop", "reduced")), ("DUPLICATES", ("duplicate",)), ("ORDER_MISMATCH", ("mismatch",)), ("UNUSUAL_ACTIVITY", ("anomaly", "unusual")), ("PRICE_CHANGE", ("price", "rate"))):
        if any(w in q for w in words):
            return kind
    return "SPEND_INCREASE"


def investigate(question: str, today: date, invoices: DataFrame, lines: DataFrame, found: DataFrame, vendor_id: str | None = None) -> Investigation:
    """Plans, compares and reports; a failure ends the run with what there is by then."""
    run = Investigation(question, today, vendor_id)
    try:
        run.step("PLANNING", kind_of(question))
        run.target = period_of(question, today) or _month(today.year, today.month - 1)
        run.baseline = baseline_of(*run.target)
        before, after = ((str(a), str(b)) for a, b in (run.baseline, run.target))
        mine = invoices.filter(F.col("vendor_id") == vendor_id) if vendor_id is not None else invoices
        run.step("BASELINE", " to ".join(before))
        run.step("TARGET", " to ".join(after))
        change = spend_change(mine, before, after)
        run.step("COMPARING")
        run.step("LINE_ITEMS")
        parts = line_findings(lines, mine, before, after)
        run.step("RECORDS")
        run.findings = ranked(parts.unionByName(record_findings(found, mine, after)))
        run.step("FINDINGS")
        run.result = report(change, run.findings)
        run.step("COMPLETED")
    except Exception as e:  # noqa: BLE001 - the report tells what failed
        run.limits.append(str(e))
        run.state = run.state if run.state == "PARTIAL" else "FAILED"
    return run
