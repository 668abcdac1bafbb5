"""Variant spellings of names typed by people (problem 5).

Merge-and-rematch resolution inside one scope (an organisation):

1. A vocabulary is learned from labelled pairs of names that mean one entity (``learn_vocabulary``): words
   found beside many different others describe (trades, given names), words that stand for each other in
   labelled pairs are one class. It is fitted on at most ``most_pairs`` pairs, those of least hash; no
   word of any trade or given name is built in.
2. A name is parsed into a profile: kind (firm, person, or open where nothing tells), core words, classes of
   trades, legal form, given name and initials. Equal parses are one profile from the start.
3. Blocking: every spelling of a profile's core levelled by sound, its one-character deletions and those
   of up to two characters of the spelling itself are keys, each with the trade or first initial that a match
   must share; cores of more than ``LONG`` letters have shifted segments as keys instead, which miss nothing
   either. Names of several words have the one-character deletions of each word as keys besides, so the
   order of words is free. In a key's group profiles are matched against clusters grown so far.
4. Linked profiles merge: spellings, trades, forms, given names and initials are united. Merged profiles
   have more keys and more to match with, so they go back to step 3, until a round merges nothing.

Vetoes: other kind, contradicting legal forms, trades of which neither set contains the other, other
given names, contradicting initials. A component in which links contradict is split again by the
vetoes. A group holds distinct parses with one key in one scope, so hot scopes and often repeated names
do not fill it. Defined results: null, blank or noise-only names -> no entity; names of one word match
names of equal parts only; empty tables -> no rows; very long names are parsed whole; extra columns are
ignored; an id repeated with another name takes part with each of them; without labelled pairs the
vocabulary is empty and only spelling, initials, short forms and order are levelled.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.addresses import deletions, osa, plain
from ledgerloom.llm.components import components
from ledgerloom.operators.units import by_group
from ledgerloom.session import spread, stage, unstage

# Legal forms with their spellings.
FORMS = {"pvt": "private pvt", "ltd": "limited ltd", "llp": "llp", "llc": "llc", "inc": "inc incorporated", "gmbh": "gmbh", "corp": "corp corporation", "co": "co company", "ag": "ag", "plc": "plc"}
# Forms of address and bookkeepers' marks.
NOISE = "m/s messrs the mr mrs ms miss dr shri smt a/c ac"
#: Cores up to this length are blocked by their deletions (about LONG^2 / 2 keys), longer ones by segments.
LONG = 24

_FORM = {w: t for t, ws in FORMS.items() for w in ws.split()}
_NOISE = frozenset(NOISE.split())
Vocabulary = dict[str, tuple[str, str]]  # word -> (trade or given, class)


@lru_cache(200_000)
def sound(core: str) -> str:
    """Spelling habits levelled: ee/i, oo/u, w/v, ph/f, ks/x, c/k, z/s, j/g, doubled letters."""
    for a, b in (("ee", "i"), ("oo", "u"), ("ph", "f"), ("w", "v"), ("ks", "x"), ("ck", "k"), ("y", "i"), ("c", "k"), ("z", "s"), ("j", "g")):
        core = core.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", core)


def split_name(name: str) -> tuple[list[str], list[str]]:
    """The words of a name without noise, and its legal forms."""
    s = plain(name).replace("’", "'")
    s = re.sub(r"\bm\s?/\s?s\b\.?|\ba\s?/\s?c\b\.?|\*", " ", s)
    s = re.sub(r"\((?:india|i|p|pvt)\)", lambda m: " pvt " if m.group(0) in ("(p)", "(pvt)") else " ", s)
    s = re.sub(r"\bhead office\b|\bbranch\b|\bh\.?o\.?$", " ", s)
    s = re.sub(r"\bp\.?\s+(ltd|limited)\b", r" pvt \1", s)
    s = re.sub(r"\bg\.\s?m\.\s?b\.\s?h\b\.?", " gmbh ", s)
    s = re.sub(r"\bl\.\s?l\.\s?([pc])\b\.?", r" ll\1 ", s)
    s = re.sub(r"(?:&|\+|\band\b|\bn\b)\s*son'?s?\b'?", " ", s)
    s = re.sub(r"(?<=[a-z]{2})\s+n\s+(?=[a-z]{2})", " and ", s)
    words, forms = [], []
    for w in re.findall(r"[a-z']+", s.replace("-", " ")):
        w = w.replace("'", "")
        if w in _FORM:
            forms.append(_FORM[w])
        elif w and w not in _NOISE and w != "and":
            words.append(w)
    return words, forms


@lru_cache(200_000)
def short_form(a: str, b: str) -> bool:
    """Whether the shorter word is a beginning of the longer (four letters or more), its contraction (first
    and last letter and the order kept, three letters or more), or its beginning with a familiar ending."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 3 or a[0] != b[0] or a == b:
        return False
    if len(a) >= 4 and (b.startswith(a) or (a[-1] == "s" and b.startswith(a[:-1]))):
        return True
    stem = re.sub(r"(?:y|ie|i)$", "", a)
    if len(stem) >= 3 and stem != a and b.startswith(stem):
        return True
    core, end = (a[:-1], b[:-1]) if a[-1] == b[-1] == "s" and len(a) > 3 else (a, b)
    if core[-1] != end[-1] and not (a[-1] != "s" and b[-1] == "s" and core[-1] == b[-2:-1]):
        return False
    rest = iter(b)
    return all(c in rest for c in a) and sum(c in "aeiou" for c in a) < sum(c in "aeiou" for c in b)


@lru_cache(200_000)
def same_word(x: str, y: str) -> bool:
    """Equal words but for spelling habits or one slip."""
    if x == y:
        return True
    short = min(len(x), len(y))
    return short >= 4 and (sound(x) == sound(y) or (short >= 5 and osa(sound(x), sound(y), 1) <= 1))


def learn_vocabulary(pairs: Iterable[tuple[str, str]], least_contexts: int = 5, support: int = 2) -> Vocabulary:
    """word -> (kind, class) from pairs of names of one entity.

    Contexts of a word are the beginnings of the words beside it that are not common themselves. Words of ``least_contexts`` or more
    describe; others join a class only by standing for one of its words in ``support`` pairs with different
    other words, or in one where the one is a short form of the other. A class is one of trades where
    legal forms stand beside it, else one of given names."""
    beside: dict[str, set[str]] = defaultdict(set)
    often: Counter = Counter()
    formed: Counter = Counter()
    stands: dict[tuple[str, str], set[str]] = defaultdict(set)
    seen: set[str] = set()
    for a, b in pairs:
        parts = []
        for name in (a, b):
            words, forms = split_name(name)
            words = [w for w in words if len(w) > 1]
            parts.append(words)
            if name in seen:
                continue
            seen.add(name)
            for w in set(words):
                often[w] += 1
                formed[w] += bool(forms)
                beside[w] |= {v for v in words if v != w}
        left, right = parts
        shared = [w for w in left if any(same_word(w, v) for v in right)]
        if not shared:
            joined = "".join(left) if len(left) > len(right) else "".join(right)
            whole = [w for w in left + right if len(w) >= 7 and w in joined and w != joined]
            if not whole:
                continue
            shared = whole[:1]
        anchor = shared[0] if len(shared[0]) >= 5 else shared[-1]
        x = [w for w in left if not any(same_word(w, v) for v in right) and w not in anchor]
        y = [w for w in right if not any(same_word(w, v) for v in left) and w not in anchor]
        for w in list(x):
            near = [v for v in y if short_form(w, v)]
            if len(near) == 1:
                stands[tuple(sorted((w, near[0])))].add(anchor)
                x.remove(w)
                y.remove(near[0])
        if len(x) == 1 and len(y) == 1:
            stands[tuple(sorted((x[0], y[0])))].add(anchor)
    # the words beside a firm's own word are common themselves, so those do not count
    wide = {w for w, vs in beside.items() if len({v[:2] for v in vs}) >= least_contexts}
    common = {w for w in wide if len({v[:2] for v in beside[w] - wide}) >= least_contexts}
    root: dict[str, str] = {}

    def find(w: str) -> str:
        while root.setdefault(w, w) != w:
            root[w] = root[root[w]]
            w = root[w]
        return w

    def rank(w: str) -> tuple[int, str]:
        return often[w], w

    def unite(a: str, b: str) -> None:
        p, q = sorted((find(a), find(b)), key=rank)
        root[p] = q

    for (a, b), anchors in sorted(stands.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        if not (a in common or b in common):
            continue
        both = a in common and b in common
        # beside legal forms a trade may be left out and another added, given names just stand for each other
        told = len(anchors) >= support or (short_form(a, b) and not both) or not (formed[a] or formed[b])
        if both and (formed[a] or formed[b]):
            told = len(anchors) >= max(support, 0.03 * min(often[a], often[b]))
        if told:
            unite(a, b)
    members = common | set(root)
    for w in sorted(members):  # a common word that begins with another of the same sort
        hosts = {find(v) for v in members if v != w and len(w) >= 5 and v.startswith(w) and len(v) <= 2 * len(w)}
        if len(hosts) == 1 and find(w) == w:
            unite(w, hosts.pop())
    for w in sorted(members, key=rank):  # a common slip of a far commoner word
        hosts = {find(v) for v in members if often[v] > 3 * often[w] and same_word(v, w)}
        if len(hosts) == 1 and find(w) == w:
            unite(w, hosts.pop())
    firms: Counter = Counter()
    total: Counter = Counter()
    for w in members:
        firms[find(w)] += formed[w]
        total[find(w)] += often[w]
    return {w: ("trade" if firms[find(w)] > 0.1 * total[find(w)] else "given", find(w)) for w in members}


class Reader:
    """Parses names with a vocabulary; words one slip away from those of one class belong to it."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.index: dict[str, set[str]] = {}
        for w in vocabulary:
            if len(w) >= 6:
                for d in deletions(w, 2 if len(w) >= 9 else 1):
                    self.index.setdefault(d, set()).add(w)
        self.known: dict[tuple[str, str], str | None] = {}

    def near(self, word: str, kind: str) -> str | None:
        if (word, kind) not in self.known:
            found = self.vocabulary.get(word)
            out = found[1] if found and found[0] == kind else None
            if not found and 5 <= len(word) <= 40:
                most = 2 if len(word) >= 9 else 1
                close = {w for d in deletions(word, most) for w in self.index.get(d, ()) if osa(word, w, 2) <= most}
                classes = {self.vocabulary[w] for w in close}
                out = next(iter(classes))[1] if len(classes) == 1 and next(iter(classes))[0] == kind else None
            self.known[word, kind] = out
        return self.known[word, kind]

    def profile(self, name: str | None) -> dict | None:
        """The parse of a name as a profile of sets, null if nothing is left of it."""
        if name is None:
            return None
        words, forms = split_name(name)
        trades, rest = set(), []
        for w in words:
            t = self.near(w, "trade") if len(words) > 1 else None
            if t:
                trades.add(t)
            else:
                rest.append(w)
        out = {"kind": "firm", "cores": set(), "bags": set(), "trades": trades, "forms": {"pvt" if "pvt" in forms else forms[0]} if forms else set(), "given": set(), "said": set(), "first": set(), "middle": set()}
        if not trades and not forms:
            initials, others = [], []
            for w in rest:
                g = self.near(w, "given") if not out["given"] and len(w) > 1 else None
                if len(w) == 1:
                    initials.append(w)
                elif g:
                    out["given"], out["said"] = {g}, {w}
                else:
                    others.append(w)
            if others and (out["given"] or (initials and len(others) == 1)):
                out["kind"] = "person"
                out["first"] = {g[0] for g in out["given"]} or set(initials[:1])
                out["middle"] = set(initials if out["given"] else initials[1:])
                rest = others
            else:
                out["kind"], out["given"], out["said"], out["middle"] = "open", set(), set(), set(initials if others else ())
                rest = others or rest
        core = "".join(rest)
        if not core:
            return None
        out["cores"] = {core}
        if len(rest) > 1:
            out["bags"] = {" ".join(rest)}
        return out


def same_core(a: set[str], b: set[str]) -> bool:
    for x in a:
        for y in b:
            if x == y:
                return True
            short = min(len(x), len(y))
            if short < 4 or abs(len(x) - len(y)) > 4:
                continue
            u, v = sound(x), sound(y)
            if u == v or osa(u, v, 1) <= 1 or (short >= 8 and osa(x, y, 2) <= 2):
                return True
    return False


def same_bag(a: set[str], b: set[str]) -> bool:
    """Whether the words of a spelling can be given one to one to those of another, in any order: the same
    but for a slip, or a short form; one word of four letters or more must be the same."""
    for x in a:
        for y in b:
            p, q = x.split(" "), y.split(" ")
            if len(p) != len(q) or len(p) > 12:
                if p != q and sorted(p) != sorted(q):
                    continue
            fits = [[same_word(u, v) or short_form(u, v) or (min(len(u), len(v)) == 1 and u[0] == v[0]) for v in q] for u in p]
            taken: dict[int, int] = {}

            def place(i: int, tried: set[int]) -> bool:
                for j, ok in enumerate(fits[i]):  # noqa: B023
                    if ok and j not in tried:
                        tried.add(j)
                        if j not in taken or place(taken[j], tried):  # noqa: B023
                            taken[j] = i  # noqa: B023
                            return True
                return False

            if sorted(p) == sorted(q) or (all(place(i, set()) for i in range(len(p))) and any(len(p[i]) >= 4 and same_word(p[i], q[j]) for j, i in taken.items())):
                return True
    return False


def person_is(person: dict, other: dict) -> bool:
    """Whether an open name of two words is this person: one word is the family name, the other fits what was said."""
    for bag in other["bags"]:
        words = bag.split(" ")
        for i, w in enumerate(words):
            left = words[:i] + words[i + 1 :]
            if len(left) == 1 and same_core({w}, person["cores"]):
                if any(same_word(left[0], g) or short_form(left[0], g) for g in person["said"]) or ((not person["said"] or len(left[0]) == 1) and left[0][0] in person["first"]):
                    return True
    return False


def match(a: dict, b: dict) -> bool:
    if a["forms"] and b["forms"] and not a["forms"] & b["forms"]:
        return False
    kinds = {a["kind"], b["kind"]}
    if kinds == {"person"}:
        for part in ("given", "first", "middle"):
            if a[part] and b[part] and not a[part] & b[part]:
                return False
        return same_core(a["cores"], b["cores"])
    if a["kind"] in ("person", "open") and b["kind"] in ("person", "open") and a["middle"] and b["middle"] and not a["middle"] & b["middle"]:
        return False
    if kinds == {"person", "open"}:
        return person_is(*((a, b) if a["kind"] == "person" else (b, a)))
    if "person" in kinds:
        return False
    if bool(a["trades"]) != bool(b["trades"]) or not (a["trades"] <= b["trades"] or b["trades"] <= a["trades"]):
        return False
    return same_core(a["cores"], b["cores"]) or same_bag(a["bags"], b["bags"])


def unite(a: dict, b: dict) -> dict:
    out = {k: a[k] if k == "kind" else a[k] | b[k] for k in a}
    if a["kind"] == "open":
        out["kind"] = b["kind"]
    return out


def pack(p: dict) -> str:
    return json.dumps({k: v if k == "kind" else sorted(v) for k, v in p.items()}, sort_keys=True)


def unpack(text: str) -> dict:
    return {k: v if k == "kind" else set(v) for k, v in json.loads(text).items()}


def segments(text: str, edits: int) -> set[str]:
    """Keys of which two texts within ``edits`` (transpositions included) share one: an edit spoils two of
    2 x edits + 1 segments at most, and moves the others by ``edits`` at most."""
    n = 2 * edits + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    out = set()
    for size in range(max(len(text) - edits, 1), len(text) + edits + 1):  # where texts of these lengths have their segments
        theirs = [size * i // n for i in range(n + 1)]
        for i in range(n):
            for shift in range(-edits, edits + 1):
                at = theirs[i] + shift
                piece = text[max(at, 0) : at + theirs[i + 1] - theirs[i]]
                if at >= 0 and len(piece) == theirs[i + 1] - theirs[i]:
                    out.add(f"{n}.{i}.{piece}")
    return out | {f"{n}.{i}.{text[cuts[i] : cuts[i + 1]]}" for i in range(n)}


def keys_of(p: dict) -> set[str]:
    """Blocking keys: spellings of the core with what a match must share, and single words with "|*"."""
    near: set[str] = set()
    for c in p["cores"]:
        if len(c) <= LONG:
            near |= deletions(sound(c), 1) | deletions(c, 2 if len(c) >= 8 else 1)
        if len(c) > LONG - 4:  # both ways about the border, as two edits may cross it
            near |= segments(sound(c), 1) | segments(c, 2)
    tags = sorted(p["first"]) if p["kind"] == "person" else sorted(p["trades"]) or ["-"]
    out = {f"{k}|{t}" for k in near for t in tags}
    words = {w for b in p["bags"] for w in b.split(" ")} | (p["cores"] if p["kind"] == "person" else set())
    for w in words:
        if len(w) >= 4:
            s = sound(w)
            out |= {f"{k}|*" for k in (deletions(s, 1) if len(s) <= LONG else set()) | (segments(s, 1) if len(s) > LONG - 2 else set())}
    return out


def agglomerate(items: list[tuple[str, dict]], loose: bool = False) -> list[tuple[list[str], dict]]:
    """Clusters of the items; richer profiles come first, so that poor ones join what they agree with.
    ``loose``: the group of a single word, in which two persons are not compared."""
    rich = lambda x: (x[1]["kind"] == "open", -len(x[1]["trades"]) - len(x[1]["given"]) - len(x[1]["middle"]) - len(x[1]["forms"]), x[0])
    clusters: list[tuple[list[str], dict]] = []
    by_core: dict[str, list[int]] = {}  # clusters that have a core are looked up, so equal names do not meet all others
    for key, p in sorted(items, key=rich):
        met = sorted({i for c in p["cores"] for i in by_core.get(c, ())})
        fits = lambda i: not (loose and clusters[i][1]["kind"] == p["kind"] == "person") and match(clusters[i][1], p)  # noqa: B023, E731
        at = next((i for i in met if (clusters[i][1]["trades"] & p["trades"] or p["kind"] == "person") and fits(i)), None)
        if at is None:
            at = next((i for i in range(len(clusters)) if fits(i)), None)
        if at is None:
            at = len(clusters)
            clusters.append(([key], p))
        else:
            clusters[at] = (clusters[at][0] + [key], unite(clusters[at][1], p))
        for c in p["cores"]:
            if at not in by_core.setdefault(c, []):
                by_core[c].append(at)
    return clusters


def vocabulary_of(labelled: DataFrame, most_pairs: int = 20_000) -> Vocabulary:
    """``labelled``(a, b): names of one entity. A bounded sample, the pairs of least hash, is fitted on the driver."""
    x = labelled.filter("a is not null and b is not null and a <> b and length(a) < 200 and length(b) < 200").select("a", "b").distinct()
    rows = x.orderBy(F.xxhash64("a", "b"), "a", "b").limit(most_pairs).collect()
    return learn_vocabulary([(r.a, r.b) for r in rows])


def resolve(records: DataFrame, id_col: str, scope_col: str, name_col: str, labelled: DataFrame | None = None) -> DataFrame:
    """id, scope and entity (a hash) of every record whose name says something."""
    vocabulary = vocabulary_of(labelled) if labelled is not None else {}

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(vocabulary)
        for pdf in batches:
            profiles = [None if (p := reader.profile(n)) is None else pack(p) for n in pdf.name]
            yield pd.DataFrame({"name": pdf.name, "profile": profiles}).dropna()

    recs = records.select(F.col(id_col).alias("id"), F.col(scope_col).alias("scope"), F.col(name_col).alias("name")).filter("id is not null and name is not null").distinct()
    names = spread(recs.select("name"), "name").distinct().mapInPandas(parsed, "name string, profile string")
    named = stage(recs.join(names, "name").select("id", "scope", F.md5(F.concat_ws("|", F.coalesce("scope", F.lit("")), "profile")).alias("entity"), "profile"))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [sorted(keys_of(unpack(t))) for t in pdf.profile]
            yield pd.DataFrame({"e": pdf.e, "scope": pdf.scope, "keys": found})

    def link(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        return [(m, members[0]) for members, _ in agglomerate([(e, unpack(p)) for e, p in zip(pdf.entity, pdf.profile)], bool(pdf.loose.iat[0])) for m in members[1:]]

    def merge(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        out = []
        for members, p in agglomerate([(e, unpack(t)) for e, t in zip(pdf.entity, pdf.profile)]):
            out += [(m, min(members), pack(p)) for m in members]
        return out

    # profiles go by 64 bits of their name in the index: of two with one number both come to the match, which decides
    now = stage(named.groupBy("scope", "entity", "profile").agg(F.lit(True).alias("fresh")).withColumn("e", F.xxhash64("entity")))
    moves = named.select("id", "scope", "entity")
    held = None  # the index of profiles that have not changed
    while True:
        wide = spread(now.filter("fresh").select("e", "scope", "profile"), "e").mapInPandas(keys, "e long, scope string, keys array<string>").select("e", "scope", F.explode("keys").alias("key"))
        new = stage(wide.select("e", F.xxhash64("scope", "key").alias("key"), F.col("key").endswith("|*").alias("loose"), F.lit(True).alias("fresh")))
        keyed = new
        if held is not None:  # only its keys that a changed profile has too
            held = held.join(now.filter("not fresh").select("e"), "e", "left_semi")
            keyed = new.unionByName(held.join(new.select("key").distinct(), "key", "left_semi").withColumn("fresh", F.lit(False)))
        # of keys shared by the very same profiles only one goes on to be matched
        groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("e").alias("x"), F.bit_xor(F.xxhash64("e")).alias("y"), F.min("loose").alias("loose"), F.bool_or("fresh").alias("fresh"))
        groups = groups.filter("n > 1 and fresh").groupBy("n", "x", "y", "loose").agg(F.min("key").alias("key")).select("key", "loose")
        blocks = keyed.select("key", "e").join(groups, "key").join(now.select("e", "entity", "scope", "profile"), "e")
        links = stage(by_group(blocks.select("key", "scope", "loose", "entity", "profile"), ["key", "scope"], [], link, "a string, b string", least=2).distinct())
        if links.isEmpty():
            break
        labels = components(links, "a", "b")
        grouped = now.join(labels, now.entity == labels.vertex).select("component", "entity", "profile")
        merged = stage(by_group(grouped, ["component"], ["entity"], merge, "entity string, new string, united string"))
        if merged.filter("entity <> new").isEmpty():
            break
        before, moves = moves, stage(moves.join(merged.select("entity", "new"), "entity", "left").select("id", "scope", F.coalesce("new", "entity").alias("entity")))
        changed = now.drop("fresh", "e").join(merged, "entity", "left").select("scope", F.coalesce("new", "entity").alias("entity"), F.coalesce("united", "profile").alias("profile"), (F.col("united") != F.col("profile")).alias("other"))
        index, held = held, new.drop("fresh") if held is None else stage(held.unionByName(new.drop("fresh")))
        if index is not None:
            unstage(new)
        old, now = now, stage(changed.groupBy("scope", "entity", "profile").agg(F.coalesce(F.bool_or("other"), F.lit(False)).alias("fresh")).withColumn("e", F.xxhash64("entity")))
        unstage(old, links, merged, before)
    return moves.select(F.col("id").alias(id_col), F.col("scope").alias(scope_col), "entity").distinct()


def same_entity(records: DataFrame, id_col: str, scope_col: str, name_col: str, labelled: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of records of one entity. The result is all pairs by definition; it is the only step that grows with them."""
    x = stage(resolve(records, id_col, scope_col, name_col, labelled))
    a, b = x.select(F.col(id_col).alias("a"), "entity"), x.select(F.col(id_col).alias("b"), "entity")
    return a.join(b, "entity").filter("a < b").select("a", "b").distinct()
