"""The investigation over all vendors with the SQL that checks it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import investigation as inv
from ledgerloom.queries.analytics import PERIOD_A, PERIOD_B, _inv, _lines, _sql
from ledgerloom.queries.operations import _FOUND, _findings

LINES = "invoice_id product_code quantity total"


def _change(s: SparkSession, d: str) -> DataFrame:
    return inv.spend_change(_inv(s, d, "vendor_id invoice_date total_amount"), PERIOD_A, PERIOD_B)


def _lines_found(s: SparkSession, d: str) -> DataFrame:
    return inv.line_findings(_lines(s, d, LINES), _inv(s, d, "vendor_id invoice_date"), PERIOD_A, PERIOD_B)


def investigation_report(s: SparkSession, d: str) -> DataFrame:
    run = inv.investigate("Why did spend increase in Q2 2025?", date(2025, 8, 1), _inv(s, d, "vendor_id invoice_date total_amount"), _lines(s, d, LINES), _findings(s, d))
    if run.result is None:
        raise RuntimeError(run.limits)
    return run.result.select("organization_id", "vendor_id", "spend_before", "spend_after", "delta", "change_pct", "findings", "explained", "unexplained", "confidence")


QUERIES = {
    "investigated_change": _change,
    "line_findings": _lines_found,
    "ranked_line_findings": lambda s, d: inv.ranked(_lines_found(s, d)).filter("place <= 3"),
    "record_findings": lambda s, d: inv.record_findings(_findings(s, d), _inv(s, d, "vendor_id invoice_date"), PERIOD_B),
    "investigation_report": investigation_report,
}


def _parts(before: tuple[str, str], after: tuple[str, str]) -> str:
    b, a = (f"invoice_date BETWEEN DATE '{p[0]}' AND DATE '{p[1]}'" for p in (before, after))
    return f"""tag AS (SELECT organization_id, id AS invoice_id, vendor_id, total_amount, {b} AS early, {a} AS late FROM inv WHERE vendor_id IS NOT NULL AND ({b} OR {a})),
ch AS (SELECT organization_id, vendor_id, coalesce(sum(total_amount) FILTER (early), 0)::DOUBLE AS spend_before, coalesce(sum(total_amount) FILTER (late), 0)::DOUBLE AS spend_after, count_if(early) AS invoices_before, count_if(late) AS invoices_after FROM tag GROUP BY 1, 2),
cc AS (SELECT *, round(spend_after - spend_before, 2) AS delta, CASE WHEN spend_before > 0 THEN round_even((spend_after - spend_before) / spend_before * 100, 2) WHEN spend_after > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS change_pct FROM ch),
g AS (SELECT organization_id, vendor_id, product_code AS subject, (sum(quantity) FILTER (early))::DOUBLE AS bq, (sum(total) FILTER (early))::DOUBLE AS bt, (sum(quantity) FILTER (NOT early))::DOUBLE AS aq, (sum(total) FILTER (NOT early))::DOUBLE AS at_ FROM lin JOIN tag USING (organization_id, invoice_id) WHERE product_code IS NOT NULL AND quantity IS NOT NULL AND total IS NOT NULL GROUP BY ALL),
lf0 AS (SELECT organization_id, vendor_id, 'PRICE_CHANGE' AS kind, subject, CASE WHEN bq > 0 AND aq > 0 THEN round((at_ / aq - bt / bq) * aq, 2) END AS impact FROM g UNION ALL SELECT organization_id, vendor_id, 'QUANTITY_CHANGE', subject, CASE WHEN bq > 0 THEN round((aq - bq) * (bt / bq), 2) END FROM g UNION ALL SELECT organization_id, vendor_id, 'NEW_LINE_ITEM', subject, CASE WHEN bt IS NULL THEN round(at_, 2) END FROM g),
lf AS (SELECT *, CASE WHEN impact < 0 THEN 'INFO' WHEN impact > CASE WHEN kind = 'NEW_LINE_ITEM' THEN 20000 ELSE 10000 END THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM lf0 WHERE impact IS NOT NULL AND impact <> 0)"""


_BOTH = _parts(PERIOD_A, PERIOD_B)
# the baseline of a quarter: as many days before it
_REPORT = _parts(("2024-12-31", "2025-03-31"), ("2025-04-01", "2025-06-30"))
_REC = f"""rf AS (SELECT f.organization_id, i.vendor_id, f.kind, f.invoice_id AS subject, CASE WHEN f.kind = 'DUPLICATE' THEN f.impact ELSE 0.0 END AS impact, CASE WHEN f.kind = 'DUPLICATE' THEN 'CRITICAL' WHEN f.kind = 'OUTLIER' THEN CASE WHEN coalesce(i.late, false) THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'HIGH' END AS severity
  FROM found f JOIN (SELECT organization_id, id, vendor_id, invoice_date BETWEEN DATE '{PERIOD_B[0]}' AND DATE '{PERIOD_B[1]}' AS late FROM inv WHERE vendor_id IS NOT NULL) i ON i.organization_id = f.organization_id AND i.id = f.invoice_id WHERE coalesce(i.late, false) OR f.kind = 'OUTLIER')"""
SQL = {
    "investigated_change": _sql("inv lin", "SELECT * FROM cc", _BOTH),
    "line_findings": _sql("inv lin", "SELECT organization_id, vendor_id, kind, subject, impact, severity FROM lf", _BOTH),
    "ranked_line_findings": _sql("inv lin", "SELECT organization_id, vendor_id, kind, subject, impact, severity, place FROM (SELECT *, row_number() OVER (PARTITION BY organization_id, vendor_id ORDER BY impact DESC, kind, subject) AS place FROM lf) WHERE place <= 3", _BOTH),
    "record_findings": _sql("inv lnk", "SELECT * FROM rf", _FOUND + ", " + _REC),
    "investigation_report": _sql(
        "inv lin lnk",
        """SELECT c.organization_id, c.vendor_id, spend_before, spend_after, delta, change_pct, coalesce(n, 0) AS findings, coalesce(e, 0.0) AS explained, round(greatest(0.0, abs(delta) - coalesce(e, 0.0)), 2) AS unexplained,
        CASE WHEN abs(delta) > 0 THEN round(greatest(0.1, least(1.0, 0.5::DOUBLE * least(1.0, coalesce(e, 0.0) / abs(delta)) + 0.3::DOUBLE * CASE WHEN n >= 2 THEN 1.0::DOUBLE WHEN n = 1 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END + 0.2::DOUBLE * CASE WHEN invoices_after > 0 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END)), 2) WHEN invoices_before > 0 AND invoices_after > 0 THEN 0.95 ELSE 0.55 END::DOUBLE AS confidence
        FROM cc c LEFT JOIN (SELECT organization_id, vendor_id, count(*) AS n, round(sum(CASE WHEN impact > 0 THEN impact ELSE 0.0 END), 2) AS e FROM (SELECT organization_id, vendor_id, impact FROM lf UNION ALL SELECT organization_id, vendor_id, impact FROM rf) GROUP BY 1, 2) f ON f.organization_id = c.organization_id AND f.vendor_id = c.vendor_id""",
        _REPORT + ", " + _FOUND + ", " + _REC,
    ),
}
