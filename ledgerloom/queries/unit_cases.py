"""The definition of problem 6's cases in SQL: spellings, packages and currencies as tables."""

from __future__ import annotations

from ledgerloom.operators.units import CURRENCIES, PACKAGES, SPELLINGS


def unit_cases_sql() -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'"
    rows = lambda d: ", ".join(f"({text(w)}, {text(k)})" for k, ws in d.items() for w in ws.split())
    n, packs = r"(\d+(?:\.\d+)?)", PACKAGES
    # how a unit text, and where that is silent a description, may name a unit, the first that does counts
    units = [rf"^\s*(?:{packs})s?\s+of\s+(?:{n}\s*x\s*)?{n}\s*(\p{{L}}[\p{{L}} .]*)$", rf"^\s*(?:{n}\s*x\s*)?{n}\s*(\p{{L}}+)\.?\s+(?:{packs})s?\s*$"]
    told = r"(?:\buom\s*:?\s*|\bqty in\s+|\bsold by the\s+|\(in\s+|\bsold in\s+|\bper\s+)(\p{L}[\p{L}.³]*\d?)\s*[\])]?\s*$"
    described = [
        rf",\s*{n}\s*x\s*{n}\s*(\p{{L}}+)\.?\s+(?:{packs})s?\s*$", rf",\s*()?{n}\s*(\p{{L}}+)\.?\s+(?:{packs})s?\s*$", rf"\(\s*{n}\s*x\s*{n}\s*(\p{{L}}+)\.?\s*\)\s*$", rf"\b(?:{packs})\s+{n}\s*x\s*{n}\s*(\p{{L}}+)\.?\s*$",
        rf"\b(?:{packs})\s+of\s+(?:{n}\s*x\s*)?{n}\s*(\p{{L}}+)\.?\s*$",
    ]
    part = lambda c, pattern, i: f"regexp_extract({c}, {text(pattern)}, {i})"
    packed = lambda c, pattern, k, where: f"SELECT k, {k}, {part(c, pattern, 3)}, coalesce(try_cast({part(c, pattern, 1)} AS DOUBLE), 1.0) * try_cast({part(c, pattern, 2)} AS DOUBLE) FROM t WHERE {where}"
    reads = ["SELECT k, 0 AS n, u AS word, 1.0::DOUBLE AS size FROM t WHERE NOT silent", *[packed("u", x, i + 1, "NOT silent") for i, x in enumerate(units)]]
    reads += [f"SELECT k, 0, {part('d', told, 1)}, 1.0 FROM t WHERE silent", *[packed("d", x, i + 1, "silent") for i, x in enumerate(described)]]
    squeeze = lambda c: rf"regexp_replace({c}, '[\s\x{{a0}}]+', ' ', 'g')"
    tidy = lambda c: f"replace(trim({squeeze(f'''replace(lower({c}), '.', '')''')}), ' ', '_')"
    scale = r"CASE WHEN regexp_matches(c, '''?000s?\b|thousand|\(k\)$') THEN 1e3 WHEN regexp_matches(c, '\bla(kh|c)s?\b') THEN 1e5 WHEN regexp_matches(c, '\bcrores?\b|\bcr\b') THEN 1e7 WHEN regexp_matches(c, 'million|\bmn\b') THEN 1e6 ELSE 1.0 END"
    bare = r"regexp_replace(c, '\(?\b(in )?(thousands?|la(kh|c)s?|crores?|cr|millions?|mn)\b\)?|\(?''?000s?\)?|\bin\b', ' ', 'g')"
    word = rf"regexp_replace(regexp_replace({bare}, '^[\s.,()-]+|[\s.,()-]+$', '', 'g'), '\s+', '_', 'g')"
    return f"""WITH spelled(word, unit_code) AS (VALUES {rows(SPELLINGS)}), coin(word, iso) AS (VALUES {rows(CURRENCIES)}),
inv AS (SELECT DISTINCT organization_id, id, trim(po_number) AS key, currency FROM invoice), po AS (SELECT DISTINCT organization_id, id, trim(po_number) AS key, po_date, currency, line_items FROM purchase_order),
lin AS (SELECT DISTINCT organization_id, id, invoice_id, product_code, description, quantity, unit, unit_price FROM invoice_line),
told AS (SELECT currency, {scale} AS scale, {word} AS word FROM (SELECT DISTINCT currency, lower(trim({squeeze('currency')})) AS c FROM inv WHERE currency IS NOT NULL)),
money AS (SELECT t.currency, scale, iso FROM told t LEFT JOIN coin USING (word)),
ours AS (SELECT l.id AS line_id, l.product_code, l.description, l.unit, l.quantity::DOUBLE AS q, l.unit_price::DOUBLE * m.scale * f.inr_rate::DOUBLE AS p, p.id AS po_id, p.organization_id FROM lin l JOIN inv i ON i.organization_id = l.organization_id AND i.id = l.invoice_id
  JOIN po p ON p.organization_id = i.organization_id AND p.key = i.key AND p.key <> '' LEFT JOIN money m ON m.currency = i.currency LEFT JOIN fx_rate f ON f.currency = m.iso AND f.rate_month = strftime(p.po_date, '%Y-%m')),
px AS (SELECT organization_id, id AS po_id, po_date, currency, unnest(line_items) AS x FROM po),
theirs AS (SELECT px.organization_id, po_id, x.product_code AS product_code, x.description AS description, x.unit AS unit, x.quantity::DOUBLE AS q, x.unit_price::DOUBLE * f.inr_rate::DOUBLE AS p FROM px LEFT JOIN fx_rate f ON f.currency = upper(trim(px.currency)) AND f.rate_month = strftime(po_date, '%Y-%m')),
worded AS (SELECT unit, description FROM ours UNION SELECT unit, description FROM theirs),
t AS (SELECT k, u, d, regexp_matches(trim(u), '^((?:{packs})s?\\.?)?$') AS silent FROM (SELECT (coalesce(unit, '') || '|' || coalesce(description, '')) AS k, lower({squeeze("coalesce(unit, '')")}) AS u, lower({squeeze("coalesce(description, '')")}) AS d FROM worded)),
r AS (SELECT r.k, arg_min(s.unit_code, n) AS unit_code, arg_min(size, n) AS size FROM ({" UNION ALL ".join(reads)}) r JOIN spelled s ON s.word = {tidy("r.word")} WHERE size > 0 GROUP BY 1),
w AS (SELECT k, dimension, factor * size AS f FROM r JOIN unit_ref USING (unit_code)),
pairs AS (SELECT o.line_id, o.q * a.f AS oq, h.q * b.f AS hq, o.p / a.f AS op, h.p / b.f AS hp FROM ours o JOIN theirs h ON h.organization_id = o.organization_id AND h.po_id = o.po_id AND h.product_code = o.product_code
  JOIN w a ON a.k = coalesce(o.unit, '') || '|' || coalesce(o.description, '') JOIN w b ON b.k = coalesce(h.unit, '') || '|' || coalesce(h.description, '') WHERE a.dimension = b.dimension)
SELECT DISTINCT line_id AS invoice_line_id, 'quantity' AS measure FROM pairs WHERE abs(oq - hq) > 0.01 * abs(hq) UNION SELECT DISTINCT line_id, 'unit_price' FROM pairs WHERE abs(op - hp) > 0.01 * abs(hp)"""
