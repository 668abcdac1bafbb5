"""The same postal address written differently (problem 2).

1. Each distinct address is parsed into number, floor, unit, plot, direction, kind of street, street words,
   post code, buildings, areas and the place words left; landmarks tell no places apart and go.
2. A gazetteer is learned from the addresses that have a post code: a place word that is mostly the most
   specific of its address (seen under the fewest post-code prefixes) is a town of all its prefixes, other
   words are regions. An address with a post code lies in the block of its prefix; one without goes into the
   blocks of all prefixes of its town and of towns within one deletion on either side, however many.
3. Blocks hold equal numbers, floors, units, plots, directions and kinds of street within one
   locality: differences there are hard vetoes. Inside a block a deletion-neighbourhood index over
   street words yields the candidates; the cost of the optimal assignment of all their components
   (street, town, building and area words) decides, the cheapest links first.
4. Addresses linked in a block are one premises. Two different post codes are never one, and an address
   without post code belongs to the premises it fits best over all its blocks.

A block holds distinct parsed addresses of one number in one locality, so it stays small however often
an address is repeated; repeats rejoin at the end. Defined results: null, empty and talk ("same as
billing") or text without a street -> no premises; an address that names neither post code nor town joins only
others like it; very long texts are parsed like others; empty tables -> no rows; extra columns are ignored; a
record repeated under one id counts once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.components import components
from ledgerloom.operators.units import by_group
from ledgerloom.session import spread, stage

# Words that mark the parts of an address, in lower case without accents and dots.
STREET_TYPES = {
    "road": "road rd raod", "cross": "cross xrd", "marg": "marg mg", "lane": "lane ln", "avenue": "avenue ave av", "drive": "drive dr drv",
    "boulevard": "boulevard blvd boul", "parkway": "parkway pky pkwy", "highway": "highway hwy", "court": "court ct", "way": "way", "terrace": "terrace ter",
    "street": "street st str strasse", "weg": "weg", "platz": "platz pl", "allee": "allee", "gasse": "gasse",
}
#: Kinds of street that stand before the name, and the small words between.
LEADING_TYPES = {"rue": "rue", "calle": "calle", "via": "via", "avenida": "avenida", "chemin": "chemin", "quai": "quai", "rua": "rua", "place": "place"}
PARTICLES = "de du des la le les l d del della di da do dos das"
BUILDINGS = "arcade chambers complex cplx estate est house hse plaza tower towers twr building bldg heights centre center mall"
AREAS = "nagar ngr colony col extension extn layout sector"
COUNTRIES = "india in bharat germany de d deutschland us usa united states america"
DIRECTIONS = {"n": "n", "s": "s", "e": "e", "w": "w", "north": "n", "south": "s", "east": "e", "west": "w", "ne": "ne", "nw": "nw", "se": "se", "sw": "sw"}
TALK = {"", "-", "n/a", "na", "none", "nil", "tbd", "same as billing", "as per gst certificate", "same as above", "not available", "unknown"}

_TYPE = {w: t for t, ws in STREET_TYPES.items() for w in ws.split()}
_GERMAN = ("strasse", "weg", "platz", "allee", "gasse", "str", "pl")
_NUMBER = r"(\d+(?:\s?-\s?\d+(?!\d))?[a-z]?)"


def plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ẞ", "ss"))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def parse(address: str | None) -> dict | None:
    """number, floor, unit, plot, direction, kind (of street), street, post (code) and places (words left)."""
    if address is None:
        return None
    s = plain(address)
    if s.strip(" .") in TALK:
        return None
    s = re.sub(r"[\t\r\n;/|]+(?!f\b)", " , ", s) if "/f" in s else re.sub(r"[\t\r\n;/|]+", " , ", s)
    s = re.sub(r"\b(?:opp(?:osite)?|behind|near|next to|adj(?:acent)?(?: to)?)\b\.?\s+\w+\s+\w+", " , ", s)
    s = re.sub(r"\bu\.?s\.?a?\.?(?=\s*(?:,|$))|\bunited states(?: of america)?\b", " , ", s)
    out: dict = {"floor": "", "unit": "", "plot": "", "post": "", "number": "", "direction": "", "kind": "", "street": "", "extras": []}

    def take(pattern: str, key: str) -> None:
        nonlocal s
        m = re.search(pattern, s)
        if m:
            out[key] = m.group(1).replace(" ", "")
            s = s[: m.start()] + " , " + s[m.end() :]

    take(r"\b(\d+)\s?(?:st|nd|rd|th)\s+(?:floor|flr|fl)\b\.?", "floor")
    take(r"\b(?:floor|flr|fl|level|lvl)\b\.?\s*(?:no\.?\s*)?#?\s*(\d+[a-z]?)\b", "floor")
    take(r"\b(\d+)\s?/\s?f\b", "floor")
    take(r"\b(?:suite|ste|unit|apt|apartment|flat|shop|office)\b\.?\s*(?:no\.?)?\s*#?\s*(\d+[a-z]?)\b", "unit")
    take(r"\b(?:plot|p\.?\s?no|site)\b\.?\s*(?:no\b\.?)?\s*#?\s*(\d+[a-z]?)\b", "plot")

    def aside(sort: str, pattern: str) -> None:
        nonlocal s
        out["extras"] += [f"{sort}:{m.group(1)}" for m in re.finditer(pattern, s)]
        s = re.sub(pattern, " , ", s)

    aside("area", r"(\w+)[ -]+(?:phase|ph)[ .-]*(?:[ivx]+|\d+)\b")
    aside("area", r"\b(\w+)\s+(?:industrial|indl|ind)\b\.?\s+area\b")
    aside("building", rf"\b(\w+)\s+(?:{BUILDINGS.replace(' ', '|')})\b\.?")
    aside("area", rf"\b(\w+)\s+(?:{AREAS.replace(' ', '|')})\b\.?")
    take(r"(?<![\w#])(?:d-\s?)?(\d{6}|\d{5})(?![\w])", "post")
    if not out["post"]:
        take(r"(?<!no )(?<!no\.)(?<![\w#.])(\d{3}[ -]\d{3})(?!\w)(?!\s+\w+\s+(?:road|rd|marg|mg|street|st|lane|ln|cross|str)\b)", "post")
        out["post"] = out["post"].replace("-", "")
    s = re.sub(r"\b(?:cross\s+(?:road|raod|rd)|x\s+rd|cross)\b\.?", " xrd ", s)
    s = re.sub(r"\b(?:door|house|h\.?|d\.?)\s*no\b\.?|\bno\b\.?(?=\s*\d)|\bnr\b\.?(?=\s*\d)|#(?=\s*\d)", " ", s)
    tokens = [w for w in re.findall(r"\d+[a-z]?\b|[a-z][a-z']*|,", re.sub(r"[.\-]", " ", s))]
    # German streets: one word with its type, or a name followed by it
    at = None
    for i, w in enumerate(tokens):
        tail = next((g for g in _GERMAN if w.endswith(g) and len(w) - len(g) >= 4), None)
        if tail and not w[0].isdigit() and (tail not in ("str", "pl") or (i + 1 < len(tokens) and (tokens[i + 1].isalnum() and tokens[i + 1][0].isdigit() or tokens[i + 1] == ","))):
            kind = {"str": "street", "strasse": "street", "pl": "platz"}.get(tail, tail)
            at, out["street"], out["kind"] = (i, i + 1), w[: -len(tail)], kind
            break
    if at is None:
        for i, w in enumerate(tokens):
            if i and w in _TYPE and tokens[i - 1].isalpha() and tokens[i - 1] not in DIRECTIONS:
                first = i - 1  # several words where the number stands right before them
                while first > max(0, i - 5) and tokens[first - 1].isalpha() and tokens[first - 1] not in DIRECTIONS:
                    first -= 1
                if not (first and tokens[first - 1][0].isdigit()):
                    first = i - 1
                at, out["street"], out["kind"] = (first, i + 1), " ".join(tokens[first:i]), _TYPE[w]
                break
    if at is None:  # the kind before the name: "12 rue de rivoli"
        for i, w in enumerate(tokens):
            end = i + 1
            while end < len(tokens) and tokens[end] in PARTICLES.split():
                end += 1
            if end < len(tokens) and (w in LEADING_TYPES or (w in _TYPE and end > i + 1)) and tokens[end].isalpha():
                last = end + 1
                while last < min(len(tokens), end + 3) and tokens[last].isalpha():
                    last += 1
                if last < len(tokens) and not (tokens[last] == "," or tokens[last][0].isdigit()):
                    last = end + 1
                at, out["street"], out["kind"] = (i, last), " ".join(tokens[end:last]), LEADING_TYPES.get(w) or _TYPE[w]
                break
    if at is None:
        return None
    a, b = at
    if a and tokens[a - 1] in DIRECTIONS:
        out["direction"] = DIRECTIONS[tokens[a - 1]]
        a -= 1
    elif b < len(tokens) and tokens[b] in DIRECTIONS:
        out["direction"] = DIRECTIONS[tokens[b]]
        b += 1
    numbered = lambda i: 0 <= i < len(tokens) and tokens[i][0].isdigit()
    for i in (b, a - 1, b + 1, a - 2):
        if numbered(i) and (i in (b, a - 1) or tokens[i + 1 if i < a else i - 1] == ","):
            out["number"] = tokens[i]
            a, b = min(a, i), max(b, i + 1)
            break
    else:
        spare = [i for i, w in enumerate(tokens) if w[0].isdigit()]
        if len(spare) == 1:
            out["number"] = tokens[spare[0]]
            tokens[spare[0]] = ","
    left = tokens[:a] + [","] + tokens[b:]
    out["places"] = [w for w in left if w.isalpha() and w not in COUNTRIES.split()]
    return out


def osa(a: str, b: str, most: int = 2) -> int:
    """Edit distance with adjacent transpositions, most + 1 if it is larger than ``most``; only the band of
    cells that near the diagonal is filled, so long texts cost their length."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    n, far = len(b), most + 1
    before, row = [far] * (n + 2), [min(j, far) for j in range(n + 1)] + [far]
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [far] * (n + 2)
        if i <= most:
            row[0] = i
        least = row[0]
        for j in range(max(1, i - most), min(n, i + most) + 1):
            y = b[j - 1]
            best = before[j - 1] + (x != y)
            if before[j] < best:
                best = before[j] + 1
            if row[j - 1] < best:
                best = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and older[j - 2] < best:
                best = older[j - 2] + 1
            row[j] = best
            if best < least:
                least = best
        if least > most:
            return far
    return min(row[n], far)


def deletions(word: str, most: int) -> set[str]:
    out = layer = {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out = out | layer
    return out


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in the assignment of least total cost (rows <= columns), by shortest augmenting paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    up, down, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j0]:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - up[i0] - down[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    up[match[j]] += delta
                    down[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


FAR = 99.0  # the cost of words that cannot be one


def word_cost(x: str, y: str) -> float:
    most = 2 if min(len(x), len(y)) > 5 else 1
    far = osa(x, y, most)
    return float(far) if far <= most else FAR


def matched(a: list[str], b: list[str]) -> tuple[list[float], int, int]:
    """Costs of the words of two sides that are assigned to each other, and how many are left on either side."""
    if not a or not b:
        return [], len(a), len(b)
    if len(a) > len(b):
        costs, left, right = matched(b, a)
        return costs, right, left
    table = [[word_cost(x, y) for y in b] for x in a]
    costs = [c for i, j in enumerate(assign(table)) if (c := table[i][j]) < FAR]
    return costs, len(a) - len(costs), len(b) - len(costs)


#: Costs of the components: an edit in the street, an edit in the town, towns that differ, a building or area that differs,
#: that is the same; and the most a link may cost.
STREET, TOWN, OTHER_TOWN, OTHER_EXTRA, SAME_EXTRA, MOST = 1.0, 0.5, 0.75, 0.25, -0.25, 3.0


def link_cost(a: Address, b: Address) -> float:
    """The cost of the optimal assignment of the components of two addresses of one block."""
    costs, left, right = matched(a.street, b.street)
    if left or right:
        return FAR
    total = STREET * sum(costs)
    towns, left, right = matched(a.towns, b.towns)
    same_post = a.post != "" and a.post == b.post
    if not same_post and not towns and (a.towns and b.towns or not (a.post or b.post) and (a.towns or b.towns)):
        return FAR  # without a post code in common the towns must be one; a post code that names none has that of its block
    total += TOWN * sum(towns) + (OTHER_TOWN * min(left, right) if not towns else 0.0)
    for sort in ("building", "area"):
        x, y = ([e.split(":", 1)[1] for e in s.extras if e.startswith(sort)] for s in (a, b))
        told, left, right = matched(x, y)
        total += SAME_EXTRA * len(told) + OTHER_EXTRA * min(left, right)
    return total


PARTS = ["number", "floor", "unit", "plot", "direction", "kind"]
_SCHEMA = "address string, number string, floor string, unit string, plot string, direction string, kind string, street string, post string, places array<string>, extras array<string>"


def parsed_addresses(addresses: DataFrame) -> DataFrame:
    """``addresses``(address) distinct -> address and its parts; addresses without a street drop out.
    A batch function: the optimiser cannot copy it below the distinct."""
    columns = ["address", *PARTS, "street", "post", "places", "extras"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(a, *[p[c] for c in columns[1:]]) for a in pdf.address if (p := parse(a))]
            yield pd.DataFrame(rows, columns=columns)

    return addresses.mapInPandas(run, _SCHEMA)


def one_less(word: Column) -> Column:
    """The word and what is left of it without one letter."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.array_append(cut, word))


def with_localities(parts: DataFrame) -> DataFrame:
    """Adds ``towns`` (place words that are no regions) and ``localities``, the blocks an address goes to."""
    prefix = F.concat(F.length("post").cast("string"), F.lit("-"), F.substring("post", 1, 3))
    words = parts.select("address", "post", prefix.alias("prefix"), F.explode(F.array_distinct("places")).alias("word")).filter(F.length("word") > 3)
    seen = stage(words.filter("post <> ''").groupBy("word", "prefix").agg(F.count("*").alias("n")))
    breadth = seen.groupBy("word").agg(F.count("*").alias("breadth"), F.sum("n").alias("all"))
    # a town is the most specific word of most of its addresses
    of = words.filter("post <> ''").join(breadth, "word").withColumn("least", F.min("breadth").over(Window.partitionBy("address")))
    towns = stage(of.groupBy("word").agg((F.count_if(F.col("breadth") == F.col("least")) * 2 >= F.count("*")).alias("town"), F.first("all").alias("all")))
    regions = towns.filter("not town").select("word")
    known = towns.filter("town").select(F.col("word").alias("town"), "all")
    index = known.select(F.explode(one_less(F.col("town"))).alias("key"), "town", "all")
    # words of addresses without post code only
    wanted = words.filter("post = ''").select("word").distinct().join(regions, "word", "left_anti")
    hits = wanted.select("word", F.explode(one_less(F.col("word"))).alias("key")).join(index, "key").select("word", "town", "all").distinct().withColumn("far", F.levenshtein("word", "town"))
    nearest = hits.groupBy("word").agg(F.min_by("town", F.struct("far", (-F.col("all")).alias("n"), "town")).alias("town"), F.min("far").alias("far"))
    blocks = nearest.join(seen.withColumnRenamed("word", "town"), "town").groupBy("word", "far").agg(F.collect_set("prefix").alias("near"))
    flat = words.join(regions, "word", "left_anti").join(blocks, "word", "left")
    told = flat.groupBy("address").agg(F.sort_array(F.collect_set("word")).alias("towns"), F.min_by("near", F.when(F.col("near").isNotNull(), F.struct("far", F.size("near"), "word"))).alias("near"))
    x = parts.join(told, "address", "left").withColumn("towns", F.coalesce("towns", F.array().cast("array<string>")))
    own = F.when(F.col("post") != "", F.array(prefix)).otherwise(F.coalesce("near", F.array(F.concat(F.lit("?"), F.array_join("towns", " ")))))
    return x.withColumn("localities", own).drop("near", "places")


class Address:
    """Street words, post code, towns and extras of one distinct parsed address."""

    def __init__(self, street: str, post: str, towns: str, extras: str):
        self.street, self.post, self.towns, self.extras = street.split(), post, towns.split(), extras.split()
        self.key = "|".join((street, post, towns, extras))


def link_block(rows: list[Address]) -> list[tuple[int, float]]:
    """For each row of one block its cluster (a row's number) and the cost of the link that joined it."""
    root = list(range(len(rows)))
    joined = [0.0] * len(rows)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index: dict[str, set[int]] = {}
    streets: dict[tuple[str, ...], list[int]] = {}
    for i, r in enumerate(rows):
        streets.setdefault(tuple(r.street), []).append(i)
    names = sorted(streets)
    for k, street in enumerate(names):
        for word in street:
            for d in deletions(word, 2 if len(word) > 5 else 1):
                index.setdefault(d, set()).add(k)
    close = {(a, b) for ks in index.values() if len(ks) > 1 for a in ks for b in ks if a < b} | {(k, k) for k in range(len(names))}
    pairs = []
    for a, b in close:
        costs, left, right = matched(list(names[a]), list(names[b]))
        if left or right:
            continue
        x, y = streets[names[a]], streets[names[b]]
        if a == b:  # equal streets with one post code: each with the one before
            by_post: dict[str, int] = {}
            for i in x:
                post = rows[i].post
                if post and post in by_post:
                    pairs.append((by_post[post], i))
                if post:
                    by_post[post] = i
            bare = [i for i in x if not rows[i].post]
            pairs += [(min(i, j), max(i, j)) for i in bare for j in x if rows[j].post or i < j]
        else:
            pairs += [(i, j) for i in x for j in y if not rows[i].post or not rows[j].post or rows[i].post == rows[j].post]
    posts = [{r.post} - {""} for r in rows]
    scored = [(c, i, j) for i, j in pairs if (c := link_cost(rows[i], rows[j])) <= MOST]
    # told post codes first, then the cheapest, so that an address without one joins its nearest premises
    for cost, i, j in sorted(scored, key=lambda x: (not (rows[x[1]].post and rows[x[1]].post == rows[x[2]].post), x)):
        a, b = find(i), find(j)
        if a == b or len(posts[a] | posts[b]) > 1:
            continue
        for k in (i, j):
            joined[k] = joined[k] or cost
        root[b] = a
        posts[a] |= posts[b]
    return [(find(i), joined[i]) for i in range(len(rows))]


def premises(records: DataFrame, id_col: str, address_col: str) -> DataFrame:
    """id and premises (a hash) of every record whose address denotes a place."""
    recs = stage(records.select(F.col(id_col).alias("id"), F.col(address_col).alias("address")).filter("id is not null and address is not null").distinct())
    parts = stage(parsed_addresses(spread(recs.select("address"), "address").distinct()))
    own = F.concat_ws("|", *PARTS).alias("parts")
    signature = stage(with_localities(parts).select("address", own, "localities", "street", "post", F.array_join("towns", " ").alias("towns"), F.array_join(F.array_sort("extras"), " ").alias("extras")))
    sort = ["street", "post", "towns", "extras"]
    distinct = signature.select("parts", F.explode("localities").alias("locality"), *sort).distinct()

    def each(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        rows = [Address(*r) for r in zip(*[pdf[c] for c in sort])]
        found = link_block(rows)
        members: dict[int, list[int]] = {}
        for i, (c, _) in enumerate(found):
            members.setdefault(c, []).append(i)
        # a cluster with a post code is named by its block, one without by its least member, the same in every block
        told = {c: any(rows[i].post for i in m) for c, m in members.items()}
        name = {c: f"{key[1]}|{rows[c].key}" if told[c] else "?" + min(rows[i].key for i in m) for c, m in members.items()}
        return [(key[0], *[pdf[c].iat[i] for c in sort], told[k], cost, name[k]) for i, (k, cost) in enumerate(found)]

    linked = stage(by_group(distinct, ["parts", "locality"], sort, each, "parts string, street string, post string, towns string, extras string, told boolean, cost double, cluster string"))
    rank = F.struct(F.when(F.col("told"), 0).otherwise(1).alias("a"), "cost", "cluster")
    best = stage(linked.groupBy("parts", *sort).agg(F.min_by("cluster", rank).alias("cluster"), F.max("told").alias("told"), F.collect_set(F.when(~F.col("told"), F.col("cluster"))).alias("others")))
    # addresses that met each other without any post code in different blocks are one all the same
    name = lambda c: F.concat_ws("|", "parts", c)
    links = best.filter("not told and size(others) > 1").select("parts", F.explode("others").alias("other"), "cluster").select(name("cluster").alias("a"), name("other").alias("b")).filter("a <> b")
    links = stage(links)
    best = best.withColumn("name", name("cluster"))
    if not links.isEmpty():
        united = components(links, "a", "b").withColumnRenamed("vertex", "name")
        best = best.join(united, "name", "left").withColumn("name", F.coalesce("component", "name")).drop("component")
    place = signature.join(best, ["parts", *sort]).select("address", F.md5("name").alias("premises"))
    return recs.join(place, "address").select(F.col("id").alias(id_col), "premises").distinct()


def same_premises(records: DataFrame, id_col: str, address_col: str) -> DataFrame:
    """Pairs a < b of records at one premises. The result is all pairs by definition; it is the only step that grows with them."""
    x = stage(premises(records, id_col, address_col))
    a, b = x.select(F.col(id_col).alias("a"), "premises"), x.select(F.col(id_col).alias("b"), "premises")
    return a.join(b, "premises").filter("a < b").select("a", "b").distinct()
