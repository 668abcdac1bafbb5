"""Documents from their layout regions: kind, fields, parties, tables, totals, routing. One DataFrame chain
over all documents; regions have doc_id, page_number, id, region_type, reading_order, bbox, confidence, raw_ocr_output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import normalize_amount, normalize_tax_id
from ledgerloom.operators.extraction import EMAIL, GSTIN, IFSC

TEXT = "raw_ocr_output"
# Phrases that name a kind of document, with their weights ("weight: phrase, phrase").
TITLES = {
    "INVOICE": ["6: tax invoice, commercial invoice, bill of supply, sales invoice", "4: invoice, bill"],
    "PURCHASE_ORDER": ["6: purchase order, purchase requisition", "4: p.o. order, po #"],
    "CREDIT_NOTE": ["7: credit note, credit memo"],
    "RECEIPT": ["6: receipt, cash receipt, payment receipt, acknowledgement receipt"],
    "PAYMENT_ADVICE": ["7: payment advice, remittance advice, direct deposit advice"],
    "CONTRACT": ["7: service agreement, master services agreement, contract agreement, non-disclosure agreement"],
    "BANK_STATEMENT": ["7: bank statement, account statement, statement of account"],
    "EXPENSE_REPORT": ["7: expense report, expense claim, travel expense"],
}
# Phrases found in documents of a kind.
CONTENTS = {
    "INVOICE": ["3: invoice no, invoice number, invoice num, invoice #", "2: invoice date, date of invoice", "2: bill to, billed to", "2: total due, amount due, balance due", "2: gstin, gst no, pan no", "1: due date, payment terms"],
    "PURCHASE_ORDER": ["4: po number, po no, po #, purchase order no", "2: ship to, vendor code", "2: requisition, requisitioner, buyer, delivery date", "1: order date"],
    "CREDIT_NOTE": ["3: original invoice, original invoice no", "3: reason for credit, adjustment", "2: credit amount"],
    "RECEIPT": ["3: received from, paid by", "2: payment method, cash, cheque, credit card", "3: amount received"],
    "PAYMENT_ADVICE": ["3: payment reference, remittance reference", "3: beneficiary, utr no, utr number, value date"],
    "CONTRACT": ["3: party of the first part, terms and conditions, indemnity, governing law"],
    "BANK_STATEMENT": ["3: opening balance, closing balance, withdrawal, deposit, cheque no"],
    "EXPENSE_REPORT": ["3: employee name, employee id, expense category, mileage, per diem"],
}
# Phrases at the top of the first page that speak against a kind.
AGAINST = {
    "INVOICE": ["4: purchase order", "5: credit note", "5: remittance advice, payment advice"],
    "PURCHASE_ORDER": ["6: tax invoice, bill of supply", "5: credit note"],
    "RECEIPT": ["4: purchase order"],
}
# Labels of fields, and the sort of value behind them.
LABELS = {
    "invoice_number": ("number", "invoice no, invoice number, invoice num, invoice #, inv #, bill no, bill number, bill #"),
    "invoice_date": ("date", "invoice date, bill date, dated, date"),
    "due_date": ("date", "due date, payment due, pay by"),
    "po_number": ("number", "po number, po no, po #, p.o. number, p.o. no, p.o. #, purchase order no, purchase order number, purchase order #"),
    "vendor_tax_id": ("tax", "vendor gstin, seller gstin, gstin, gst no, gst in, tax id"),
    "buyer_tax_id": ("tax", "buyer gstin, customer gstin, bill to gstin, consignee gstin"),
    "subtotal": ("money", "sub total, subtotal, taxable value, taxable amount, net amount"),
    "tax_amount": ("money", "total tax, tax amount, gst amount, igst, cgst + sgst"),
    "discount_amount": ("money", "discount, trade discount"),
    "shipping_amount": ("money", "shipping, freight, handling"),
    "total_amount": ("money", "grand total, total amount, invoice total, net payable, total"),
    "amount_due": ("money", "amount due, balance due, total due"),
    "bank_account": ("account", "account number, account no, account #, a/c no, a/c number"),
    "ifsc_swift": ("code", "ifsc code, ifsc, swift code, swift"),
}
VALUES = {
    "number": r"([A-Za-z0-9][A-Za-z0-9_/-]*)", "date": r"([0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}|[0-9]{1,2}[ -][A-Za-z]{3,9}[ -][0-9]{2,4})", "tax": GSTIN, "money": r"((?:inr|rs\.?|[₹$€£])?[ ]*[0-9][0-9.,]*[0-9]|[0-9])",
    "account": r"([0-9]{9,18})", "code": r"([A-Z]{4}0[A-Z0-9]{6}|[A-Z]{6}[A-Z0-9]{2,5})",
}
# Kinds of region a layout step names, by the kind used here; dashes are read as underscores.
REGION_KINDS = {
    "title": "title doc_title section_header", "text": "text table_footnote reference footnote", "figure": "figure image picture", "caption": "figure_caption table_caption chart_title figure_title caption", "table": "table", "header": "header",
    "footer": "footer", "page_number": "page_number", "chart": "chart", "paragraph": "paragraph", "equation": "equation formula math", "list": "list item",
}
CURRENCY_SIGNS = [("INR", "₹ inr gstin cgst sgst ifsc rupees udyam rs. rs"), ("USD", "$ usd"), ("EUR", "€ eur"), ("GBP", "£ gbp")]


def phrase_pattern(phrases: str) -> str:
    """A pattern for phrases parted by commas: any blanks between their words, none needed; points may be missing."""
    one = lambda p: r"\s*".join("".join(c if c.isalnum() else "\\.?" if c == "." else "\\" + c for c in w) for w in p.split())
    parts = sorted((one(p.strip()) for p in phrases.split(",")), key=len, reverse=True)
    return r"\b(?:" + "|".join(parts) + r")(?!\w)"


def weighted(rules: dict[str, list[str]]) -> list[tuple[str, int, str]]:
    return [(kind, int(r.split(":", 1)[0]), phrase_pattern(r.split(":", 1)[1])) for kind, rs in rules.items() for r in rs]


def region_kind(label: Column) -> Column:
    known = {w: kind for kind, ws in REGION_KINDS.items() for w in ws.split()}
    table = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in known.items()) + ")")
    return F.coalesce(F.try_element_at(table, F.regexp_replace(F.lower(F.trim(label)), "-", "_")), F.lit("other"))


def clamp_box(b: Column, width: int, height: int, least: int = 2, least_area: int = 4) -> Column:
    """The box within the page, null if hardly anything is left of it."""
    cut = lambda v, m: F.greatest(F.lit(0), F.least(F.lit(m), v))
    x1, y1, x2, y2 = cut(b.x1, width), cut(b.y1, height), cut(b.x2, width), cut(b.y2, height)
    w, h = x2 - x1, y2 - y1
    return F.when((w > least) & (h > least) & (w * h > least_area), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def currency_of(text: Column) -> Column:
    """The currency a text speaks of, INR if none; Indian signs first."""
    low, out = F.lower(text), F.lit("INR")
    for code, signs in reversed(CURRENCY_SIGNS):
        hit = F.lit(False)
        for s in signs.split():
            hit = hit | (low.contains(s) if len(s) == 1 or s[-1] == "." else low.rlike(rf"(?<!\w){s}(?!\w)"))
        out = F.when(F.coalesce(hit, F.lit(False)), code).otherwise(out)
    return out


def classify(regions: DataFrame, top_share: float = 0.35, least: int = 4) -> DataFrame:
    """doc_id, document_type, score, confidence: phrases count double at the top of the first page, others once;
    contents count anywhere; phrases at the top may speak against a kind; a table speaks for invoices and orders.

    One aggregate of flags over the regions, texts are never put together."""
    height = regions.filter("page_number = 1").groupBy("doc_id").agg(F.max("bbox.y2").alias("_height"))
    x = regions.filter(F.col(TEXT).isNotNull()).join(height, "doc_id", "left")
    top = F.coalesce((F.col("page_number") == 1) & (F.col("bbox.y1") <= top_share * F.col("_height")), F.lit(False))
    hit = lambda p: F.col(TEXT).rlike("(?i)" + p)
    titles, contents, against = weighted(TITLES), weighted(CONTENTS), weighted(AGAINST)
    flags = [F.bool_or(top & hit(p)).alias(f"t{i}") for i, (_, _, p) in enumerate(titles)] + [F.bool_or(hit(p)).alias(f"a{i}") for i, (_, _, p) in enumerate(titles)]
    flags += [F.bool_or(hit(p)).alias(f"c{i}") for i, (_, _, p) in enumerate(contents)] + [F.bool_or(top & hit(p)).alias(f"n{i}") for i, (_, _, p) in enumerate(against)]
    y = x.groupBy("doc_id").agg(*flags, F.bool_or(F.col("region_type") == "table").alias("tabular"))
    scores = {}
    for kind in TITLES:
        s = F.when(F.coalesce("tabular", F.lit(False)), 2).otherwise(0) if kind in ("INVOICE", "PURCHASE_ORDER") else F.lit(0)
        for i, (k, w, _) in enumerate(titles):
            s = s + F.when(F.col(f"t{i}"), 2 * w).when(F.col(f"a{i}"), w).otherwise(0) if k == kind else s
        for i, (k, w, _) in enumerate(contents):
            s = s + F.when(F.col(f"c{i}"), w).otherwise(0) if k == kind else s
        for i, (k, w, _) in enumerate(against):
            s = s - F.when(F.col(f"n{i}"), w).otherwise(0) if k == kind else s
        scores[kind] = s
    best = F.greatest(*[F.struct(s.alias("score"), F.lit(-i).alias("o"), F.lit(k).alias("kind")) for i, (k, s) in enumerate(scores.items())])
    y = y.select("doc_id", best.alias("b")).select("doc_id", F.greatest("b.score", F.lit(0)).alias("score"), "b.kind")
    sure = F.least(F.lit(0.99), F.greatest(F.lit(0.5), F.round(1 / (1 + F.pow(F.lit(2.71828), -(F.col("score") - 5) / 2.5)), 2)))
    told = F.col("score") >= least
    return y.select("doc_id", F.when(told, F.col("kind")).otherwise("UNKNOWN").alias("document_type"), "score", F.when(told, sure).otherwise(F.round(F.greatest(F.lit(0.1), F.col("score") / 20.0), 2)).alias("confidence"))


def label_value(text: Column, field: str) -> Column:
    """The value behind the field's label in the same text, null if there is none."""
    sort, phrases = LABELS[field]
    own = VALUES[sort].replace(r"\b", "")
    # labels that other labels end with must not follow a further word of one: "due date" is no "date"
    lead = r"(?<!due )(?<!order )(?<!invoice )(?<!bill )" if field == "invoice_date" else r"(?<!sub )(?<!sub)" if field == "total_amount" else ""
    found = F.regexp_extract(text, f"(?i){lead}" + phrase_pattern(phrases) + r"\.?\s*[:#-]?\s*" + own, 1)
    return F.nullif(F.trim(found), F.lit(""))


def same_region_fields(regions: DataFrame) -> DataFrame:
    """doc_id, field, value, region, score: for each field the first region in order with a label and its value."""
    each = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), label_value(F.col(TEXT), f).alias("value")) for f in LABELS]), lambda x: x.value.isNotNull())
    x = regions.filter(F.col(TEXT).isNotNull()).select("doc_id", "page_number", "reading_order", "id", F.inline(each))
    return x.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", F.col("id").alias("region")), F.struct("page_number", "reading_order", "id")).alias("v")).select("doc_id", "field", "v.value", "v.region", F.lit(0.95).alias("score"))


def fits_sort(value: Column, sort: str) -> Column:
    """How well a text is a value of a sort, 0 to 1."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if sort == "money":
        return F.when(normalize_amount(value).isNotNull(), 1.0).otherwise(0.1)
    if sort == "date":
        return F.when(value.rlike("^" + VALUES["date"] + "$"), 1.0).otherwise(0.1)
    if sort == "tax":
        n = F.length(normalize_tax_id(value))
        return F.when(n == 15, 1.0).when(n >= 10, 0.4).otherwise(0.1)
    if sort == "number":
        return F.when((F.length(value) <= 35) & value.rlike("^[A-Za-z0-9_/-]+$"), 1.0).when((F.length(value) <= 50) & ~value.contains("\n"), 0.7).otherwise(0.2)
    if sort == "account":
        return F.when(digits.between(9, 18), 1.0).otherwise(0.2)
    return F.lit(0.6)


def neighbour_fields(regions: DataFrame, most: int = 40, right: float = 350.0, below: float = 80.0, least: float = 0.55) -> DataFrame:
    """doc_id, field, value, region, score: the best text right of or below a region that is but a label.

    Both searches are bounded, so regions join on page and stretches of that height, not on the page alone."""
    x = regions.filter(F.col("bbox").isNotNull()).select("doc_id", "page_number", "id", "bbox", "confidence", F.trim(TEXT).alias("t")).filter("t <> ''")
    named = F.filter(F.array(*[F.when(F.col("t").rlike("(?i)^" + phrase_pattern(p) + r"\.?\s*[:-]?$"), F.struct(F.lit(f).alias("field"), F.lit(s).alias("sort"))) for f, (s, p) in LABELS.items()]), lambda f: f.isNotNull())
    step = 200
    lab = x.filter(F.length("t") <= most).select("doc_id", "page_number", F.col("id").alias("label_id"), F.col("bbox").alias("L"), F.inline(named))
    lab = lab.withColumn("cell", F.explode(F.sequence(F.floor((F.col("L.y1") - 60) / step), F.floor((F.col("L.y2") + below + 60) / step))))
    val = x.withColumn("cell", F.floor(F.col("bbox.y1") / step)).withColumnRenamed("bbox", "V")
    p = lab.join(val, ["doc_id", "page_number", "cell"]).filter("id <> label_id")
    mid = lambda b: (b.y1 + b.y2) / 2.0
    L, V = F.col("L"), F.col("V")
    beside, under = V.x1 - L.x2, V.y1 - L.y2
    is_right = (F.abs(mid(L) - mid(V)) <= 30) & beside.between(-10, right)
    is_below = under.between(-5, below) & (F.abs(L.x1 - V.x1) <= 70)
    fit = F.coalesce(*[F.when(F.col("sort") == s, fits_sort(F.col("t"), s)) for s in VALUES])
    place = F.when(is_right, F.struct(F.lit(1.0).alias("align"), (1 - F.greatest(F.lit(0.0), beside) / right).alias("near"))).when(is_below, F.struct(F.lit(0.85).alias("align"), (1 - F.greatest(F.lit(0.0), under) / below).alias("near")))
    score = 0.4 * fit + 0.25 * F.col("p.align") + 0.2 * F.col("p.near") + 0.15 * F.coalesce("confidence", F.lit(0.0))
    p = p.withColumn("p", place).filter("p is not null").withColumn("score", F.round(score, 4)).filter(F.col("score") >= least)
    best = p.groupBy("doc_id", "field").agg(F.min_by(F.struct(F.col("t").alias("value"), F.col("id").alias("region"), "score"), F.struct((-F.col("score")).alias("s"), "page_number", "id")).alias("v"))
    return best.select("doc_id", "field", "v.*")


def fallback_fields(regions: DataFrame) -> DataFrame:
    """doc_id, field, value, region, score: the first tax number (vendor) and the first other one (buyer), bank
    code, mail address, telephone and tax account number anywhere in the text."""
    kinds = {"tax": GSTIN, "ifsc_swift": IFSC, "email": EMAIL, "phone": r"(\+[0-9]{1,3}[ -]?[0-9]{4,5}[ -]?[0-9]{5,6})", "pan": r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"}
    hits = F.flatten(F.array(*[F.transform(F.regexp_extract_all(F.col(TEXT), F.lit(p), 1), (lambda k: lambda v, i: F.struct(F.lit(k).alias("kind"), v.alias("value"), i.alias("n")))(k)) for k, p in kinds.items()]))
    x = regions.filter(F.col(TEXT).isNotNull()).select("doc_id", F.struct("page_number", "reading_order", "id").alias("at"), "id", F.inline(hits))
    first = x.groupBy("doc_id", "kind", "value").agg(F.min(F.struct("at", "n", "id")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("f.at", "f.n"))  # values of one document
    field = F.when(F.col("kind") != "tax", F.when(F.col("rank") == 1, F.col("kind"))).when(F.col("rank") == 1, "vendor_tax_id").when(F.col("rank") == 2, "buyer_tax_id")
    return first.withColumn("rank", rank).select("doc_id", field.alias("field"), "value", F.col("f.id").alias("region"), F.lit(0.85).alias("score")).filter("field is not null")


def field_waterfall(regions: DataFrame) -> DataFrame:
    """doc_id, field, value, method, score: same region before neighbour before fallback; a value that is none of its
    sort is kept with the score 0.4."""
    methods = [("same_region", same_region_fields(regions)), ("spatial_proximity", neighbour_fields(regions)), ("regex_fallback", fallback_fields(regions))]
    x = None
    for i, (name, df) in enumerate(methods):
        y = df.select("doc_id", "field", "value", "score", F.lit(name).alias("method"), F.lit(i).alias("rank"))
        x = y if x is None else x.unionByName(y)
    best = x.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "method", "score"), "rank").alias("v")).select("doc_id", "field", "v.*")
    sort = F.expr("map(" + ", ".join(f"'{f}', '{s}'" for f, (s, _) in LABELS.items()) + ")")
    fit = F.coalesce(*[F.when(F.try_element_at(sort, F.col("field")) == s, fits_sort(F.col("value"), s)) for s in ("money", "date", "tax", "number", "account")], F.lit(1.0))
    return best.withColumn("score", F.when(fit < 0.5, 0.4).otherwise(F.col("score")))


def derived_totals(fields: DataFrame) -> DataFrame:
    """doc_id, total, derived: the total, or subtotal + tax - discount where there is none."""
    pick = lambda f: normalize_amount(F.max(F.when(F.col("field") == f, F.col("value")))).alias(f)
    x = fields.groupBy("doc_id").agg(*[pick(f) for f in ("total_amount", "subtotal", "tax_amount", "discount_amount")])
    none = lambda c: F.coalesce(c, F.lit(0).cast("decimal(18,2)"))
    made = F.col("subtotal") + none("tax_amount") - none("discount_amount")
    return x.select("doc_id", F.coalesce("total_amount", made).cast("double").alias("total"), (F.col("total_amount").isNull() & made.isNotNull()).alias("derived")).filter("total is not null")


def parties(regions: DataFrame, top_share: float = 0.35) -> DataFrame:
    """doc_id, vendor, buyer: the seller is the first line at the top of the first page that is no title, label or
    figure (or stands behind "vendor:"); the buyer stands behind "bill to"."""
    height = regions.filter("page_number = 1").groupBy("doc_id").agg(F.max("bbox.y2").alias("_height"))
    x = regions.filter((F.col("page_number") == 1) & F.col(TEXT).isNotNull()).join(height, "doc_id")
    x = x.select("doc_id", "reading_order", "id", "region_type", "bbox", "_height", TEXT, F.posexplode(F.split(TEXT, "\r?\n")).alias("n", "line"))
    line = F.trim("line")
    other = phrase_pattern(", ".join([p for _, p in LABELS.values()] + [r.split(":", 1)[1] for rs in (*TITLES.values(), *CONTENTS.values()) for r in rs] + ["bill to", "order date", "currency"]))
    plain = (line != "") & ~line.rlike("(?i)^" + other) & line.rlike(r"[A-Za-z]{2}") & (F.length(F.regexp_replace(line, "[^0-9]", "")) * 2 < F.length(line)) & ~line.startswith("|") & ~line.rlike(r"(?i)^(?:vendor|buyer|supplier)\b\s*:?$")
    named = F.regexp_extract(TEXT, r"(?i)^\s*(?:vendor|supplier)\s*:\s*\n\s*([^\n]+)", 1)
    seller = F.when(named != "", F.trim(named)).when((F.col("region_type") != "title") & (F.col("bbox.y1") <= top_share * F.col("_height")) & plain & ~F.col(TEXT).rlike(r"(?i)^\s*bill(?:ed)?\s*to"), line)
    buyer = F.nullif(F.trim(F.regexp_extract(TEXT, r"(?i)\bbill(?:ed)?\s*to\b\s*:?\s*\n?\s*([^\n]+)", 1)), F.lit(""))
    at = F.struct(F.when(named != "", 0).otherwise(1).alias("a"), "reading_order", "id", "n")
    return x.groupBy("doc_id").agg(F.min_by(seller, F.when(seller.isNotNull(), at)).alias("vendor"), F.min_by(buyer, F.when(buyer.isNotNull(), at)).alias("buyer"))


def mapped_rows(regions: DataFrame) -> DataFrame:
    """doc_id, id, number, description, quantity, rate, total: rows of pipe tables, columns told by the heading;
    numbered through all tables of a document."""
    x = regions.filter(F.col(TEXT).contains("|")).select("doc_id", "page_number", "reading_order", "id", F.split(TEXT, "\r?\n").alias("lines"))
    cells = lambda l: F.transform(F.split(F.regexp_replace(F.trim(l), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = F.filter("lines", lambda l: l.rlike(r"^\s*\|.*\|\s*$") & ~l.rlike(r"^[\s|:-]+$"))
    x = x.withColumn("rows", rows).filter(F.size("rows") > 1).withColumn("head", F.transform(cells(F.get("rows", F.lit(0))), lambda c: F.lower(c)))
    # Words in the heading of a column.
    words = {"description": "desc|item|particular|product|service", "quantity": "qty|quantity|units|hours", "rate": "rate|price|unit cost", "total": "amount|total|value"}
    for name, p in words.items():
        x = x.withColumn(f"_{name}", F.array_position(F.transform("head", lambda c: c.rlike(p)), True))  # noqa: B023
    x = x.filter("_description > 0 and _total > 0").select("doc_id", "page_number", "reading_order", "id", *[f"_{n}" for n in words], F.posexplode(F.slice("rows", 2, F.size("rows"))).alias("n", "row"))
    cell = lambda n: F.when(F.col(f"_{n}") > 0, F.get(cells(F.col("row")), (F.col(f"_{n}") - 1).cast("int")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "reading_order", "id", "n"))
    return x.select("doc_id", "id", number.alias("number"), cell("description").alias("description"), F.regexp_replace(cell("quantity"), ",", "").try_cast("double").alias("quantity"), *[normalize_amount(cell(n)).cast("double").alias(n) for n in ("rate", "total")])


def pieced_rows(regions: DataFrame) -> DataFrame:
    """doc_id, id, description, quantity, rate, total: a row read as one cell a line, text first and three figures in any
    order of which two make the third (to 1 or 1 per cent)."""
    x = regions.filter(F.col(TEXT).isNotNull() & ~F.col(TEXT).contains("|")).select("doc_id", "id", F.transform(F.split(TEXT, "\r?\n"), lambda l: F.trim(l)).alias("l"))
    figure = r"^[0-9][0-9,]*(?:\.[0-9]+)?$"
    starts = F.sequence(F.lit(0), F.size("l") - 4)
    x = x.filter(F.size("l") >= 4).select("doc_id", "id", "l", F.explode(starts).alias("i"))
    at = lambda k: F.get("l", F.col("i") + k)
    x = x.filter(at(0).rlike("[A-Za-z]") & ~at(0).rlike(figure) & at(1).rlike(figure) & at(2).rlike(figure) & at(3).rlike(figure))
    a, b, c = [F.regexp_replace(at(k), ",", "").try_cast("double") for k in (1, 2, 3)]
    ok = lambda q, r, t: F.abs(q * r - t) <= F.greatest(F.lit(1.0), 0.01 * t)
    cell = lambda q, r, t: F.struct(q.alias("quantity"), r.alias("rate"), t.alias("total"))
    orders = [(a, b, c), (a, c, b), (b, c, a)]  # the order of quantity and rate is kept as read
    found = F.coalesce(*[F.when(ok(*o), cell(*o)) for o in orders])
    return x.withColumn("v", found).filter("v is not null").select("doc_id", "id", at(0).alias("description"), "v.*")


def order_fields(regions: DataFrame) -> DataFrame:
    """doc_id, po_number, po_date, currency, vendor, total, lines, line_total of purchase orders."""
    t = F.col(TEXT)
    grab = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.struct("page_number", "reading_order", "id")))
    head = regions.filter(t.isNotNull()).groupBy("doc_id").agg(
        first(label_value(t, "po_number")).alias("po_number"), first(grab(r"(?i)\b(?:order|po)\s*date\s*:?\s*" + VALUES["date"])).alias("po_date"), first(grab(r"(?i)\bcurrency\s*:?\s*([A-Za-z]{3})\b")).alias("currency"),
        first(label_value(t, "total_amount")).alias("total"),
    )
    rows = mapped_rows(regions).groupBy("doc_id").agg(F.count("*").alias("lines"), F.round(F.sum("total"), 2).alias("line_total"))
    x = head.join(parties(regions).select("doc_id", "vendor"), "doc_id", "left").join(rows, "doc_id", "left")
    return x.select("doc_id", "po_number", "po_date", F.upper("currency").alias("currency"), "vendor", F.coalesce(normalize_amount(F.col("total")).cast("double"), "line_total").alias("total"), F.coalesce("lines", F.lit(0)).alias("lines"), "line_total")


def full_page_totals(regions: DataFrame) -> DataFrame:
    """doc_id, grand_total, tax_lines: what whole pages say of totals: the last grand total and the sum of all
    central, state and integrated tax lines."""
    t = F.col(TEXT)
    grand = F.element_at(F.regexp_extract_all(t, F.lit(r"(?i)\bgrand\s*total\s*:?\s*" + VALUES["money"].replace("(?:", "(?:", 1)), 1), -1)
    taxes = F.regexp_extract_all(t, F.lit(r"(?i)\b(?:c|s|i)gst\b[^0-9\n]*(?:[0-9.]+\s*%)?[^0-9\n]*([0-9][0-9.,]*)"), 1)
    total = F.aggregate(taxes, F.lit(0).cast("decimal(18,2)"), lambda a, v: (a + F.coalesce(normalize_amount(v), F.lit(0).cast("decimal(18,2)"))).cast("decimal(18,2)"))
    x = regions.filter(t.isNotNull()).select("doc_id", "page_number", "reading_order", "id", F.when(F.size(F.regexp_extract_all(t, F.lit(r"(?i)\bgrand\s*total\s*:?\s*" + VALUES["money"]), 1)) > 0, normalize_amount(grand)).alias("g"), total.alias("s"))
    return x.groupBy("doc_id").agg(F.max_by("g", F.when(F.col("g").isNotNull(), F.struct("page_number", "reading_order", "id"))).cast("double").alias("grand_total"), F.sum("s").cast("double").alias("tax_lines"))


def whole_pages(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """The regions and, for pages read as a whole without any text in regions, one region of the page's text.
    ``pages``(doc_id, page_number, mode, text)."""
    said = regions.filter(F.trim(TEXT) != "").select("doc_id", "page_number").distinct()
    bare = pages.filter("mode = 'full_page' and trim(text) <> ''").join(said, ["doc_id", "page_number"], "left_anti")
    made = bare.select("doc_id", "page_number", F.format_string("p%d_fullpage", "page_number").alias("id"), F.lit("text").alias("region_type"), F.lit(0).alias("reading_order"), F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>").alias("bbox"), F.lit(0.8).alias("confidence"), F.col("text").alias(TEXT))
    return regions.select(*made.columns).unionByName(made)


def page_routes(regions: DataFrame, width: int = 1200, height: int = 1600, grid: int = 20, least: float = 0.4, mode: str = "auto") -> DataFrame:
    """doc_id, page_number, regions, coverage, largest, mode, reason: whether a page is read by regions or as a
    whole. Coverage is the share of the cells of a grid that any box touches, so overlaps count once."""
    x = regions.filter("page_number is not null").withColumn("b", clamp_box(F.col("bbox"), width, height))
    area = (F.col("b.x2") - F.col("b.x1")) * (F.col("b.y2") - F.col("b.y1"))
    count = x.groupBy("doc_id", "page_number").agg(F.count("b").alias("regions"), (F.coalesce(F.max(area), F.lit(0)) / float(width * height)).alias("largest"))
    span = lambda a, b: F.explode(F.sequence(F.floor(a / grid), F.floor((b - 1) / grid)))
    cells = x.filter("b is not null").select("doc_id", "page_number", "b", span(F.col("b.x1"), F.col("b.x2")).alias("cx")).select("doc_id", "page_number", "cx", span(F.col("b.y1"), F.col("b.y2")).alias("cy")).distinct()
    held = cells.groupBy("doc_id", "page_number").agg((F.count("*") / float((width // grid) * (height // grid))).alias("coverage"))
    y = count.join(held, ["doc_id", "page_number"], "left").fillna(0.0, ["coverage"])
    reason = F.when(F.lit(mode == "full_page"), "forced_full_page_mode").when(F.lit(mode == "hybrid"), "forced_hybrid_mode").when(F.col("regions") == 0, "no_layout_regions").when(F.col("coverage") < least, "low_layout_coverage").otherwise("sufficient_layout_coverage")
    whole = reason.isin("forced_full_page_mode", "no_layout_regions", "low_layout_coverage")
    return y.select("doc_id", "page_number", "regions", "coverage", "largest", F.when(whole, "full_page").otherwise("hybrid").alias("mode"), reason.alias("reason"))


def documents(regions: DataFrame) -> DataFrame:
    """One row a document: its kind, its fields, parties, number of rows and total."""
    f = field_waterfall(regions)
    fields = f.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    rows = mapped_rows(regions).groupBy("doc_id").agg(F.count("*").alias("rows"))
    x = classify(regions)
    for part in (fields, parties(regions), rows, derived_totals(f)):
        x = x.join(part, "doc_id", "left")
    return x
