"""Driver-side parts of the llm operators, without Spark."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import addresses, names, ocr_text
from ledgerloom.llm.mixing import memberships, next_step, replay
from ledgerloom.llm.packing import plan_containers
from ledgerloom.llm.spans import Hashes, phrases, window_min
from ledgerloom.llm.splitting import cut


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n\tü😀!", max_size=400), st.integers(8, 40), st.integers(0, 7))
def test_pieces_give_the_text_back(text, limit, overlap):
    ends, _ = cut(text, limit, overlap)
    starts = [0, *[e - overlap for e in ends[:-1]]]
    pieces = [text[a:b] for a, b in zip(starts, ends)]
    assert all(len(p) <= limit for p in pieces)
    assert all(p[:overlap] == q[len(q) - overlap :] for q, p in zip(pieces, pieces[1:]))
    assert pieces[0] + "".join(p[overlap:] for p in pieces[1:]) == text


def test_cuts_prefer_natural_boundaries():
    text = "A sentence here. " * 30 + "\n\n" + "Another one there. " * 28
    first = cut(text, 600, 50)[0][0]
    assert text[:first].endswith("\n\n")


def test_containers_hold_every_item_once():
    rng = random.Random(5)
    for _ in range(100):
        capacity = rng.choice([10, 50, 4096])
        counts = {rng.randint(1, capacity): rng.randint(1, 300) for _ in range(rng.randint(1, 50))}
        slots, made = plan_containers(counts, capacity)
        fill, got = Counter(), Counter()
        for size, a, b, first, each in slots:
            for r in range(a, b + 1):
                fill[first + (r - a) // each] += size
                got[size] += 1
        assert got == Counter(counts) and set(fill) == set(range(made)) and max(fill.values()) <= capacity
    assert plan_containers({}, 10) == ([], 0)


def test_hashes_and_minima_meet_brute_force():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abc"), 500))
    h = Hashes([text])
    same = {}
    for a in range(0, 480):
        same.setdefault(text[a : a + 8], set()).add(int(h.span(np.array([a]), np.array([a + 8]))[0]))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)
    x = rng.integers(0, 1 << 60, 97).astype(np.uint64)
    for w in (1, 5, 97, 98):
        assert list(window_min(x, w)) == [min(x[i : i + w]) for i in range(len(x) - w + 1)]


def test_phrases_cover_every_span_start():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (10, 20, 300, 0, 55)]
    t, start, starts, _, _ = phrases(texts, 20, 6)
    got = Counter((int(a), int(s) + i) for a, s, n in zip(t, start, starts) for i in range(n))
    assert got == Counter((i, a) for i, x in enumerate(texts) for a in range(len(x) - 19))


def test_rates_stay_within_caps():
    m = np.array([[1.0, 0], [0, 1.0], [0.5, 0.5]])
    r = replay(m, np.array([1.0, 3.0, 2.0]), [[-9.0, -1.0], [0.5, 0.0]])
    assert list(r) == [0.5, 1.0, 1.75]


def test_rates_meet_labels_and_come_near_the_posteriors():
    rng = np.random.default_rng(3)
    n, k = 3000, 3
    label = rng.integers(-1, k, n)
    member = np.rint(rng.dirichlet([0.4] * k, n) * 64).astype(int)
    member[:, 0] += 64 - member.sum(axis=1)
    v, cap, tokens = memberships(label, member.tolist(), k), np.full(n, 2.0), rng.integers(1, 500, n).astype(float)
    target, mass = np.array([0.5, 0.3, 0.2]), (v * tokens[:, None]).sum(axis=0)[:k]
    total = 0.8 * (2 * mass / target).min()
    goal = np.concatenate([target * total] * 2)

    def fitted(soft: int) -> np.ndarray:
        steps = [np.concatenate([-target * total / mass, np.zeros(k)]).tolist()]
        for done in range(60):
            r = replay(v, cap, steps)
            off = (r * tokens) @ v - goal
            steps.append(next_step(off, (v * tokens[:, None]).T @ v, (tokens * (r > 0)) @ v[:, :k], (tokens * (r < cap)) @ v[:, :k], done >= soft).tolist())
        return ((replay(v, cap, steps) * tokens) @ v - goal) / total

    with_soft, without = fitted(6), fitted(0)
    assert np.abs(with_soft[:k]).max() < 1e-6 and np.abs(with_soft[k:]).max() < 0.5 * np.abs(without[k:]).max()


def test_addresses_parse_to_equal_parts():
    same = ["Suite 501, Door No 42D, Taguvogant Marg, Kogefex Industrial Area, Vugodendabad, 867076, Feribul, Bharat", "STE#501 / 42D Taguvogant Mg. / Vugodendabad - 867 076", "Vugodendabad 867076\n#42D, Taguvogant Marg\nUnit 501\nOpp. Water Tank"]
    parts = [addresses.parse(a) for a in same]
    keys = ("number", "floor", "unit", "plot", "kind", "street", "post")
    assert len({tuple(p[k] for k in keys) for p in parts}) == 1 and parts[0]["number"] == "42d" and parts[0]["unit"] == "501"
    assert addresses.parse("Gonepekot-Allee Nr. 3, D-66954 Sanizast")["kind"] != addresses.parse("Gonepekot Weg 3, D-66954 Sanizast")["kind"]
    french = addresses.parse("12 Rue de Rivoli, 75001 Paris")
    assert (french["number"], french["kind"], french["street"], french["post"], french["places"]) == ("12", "rue", "rivoli", "75001", ["paris"])
    assert addresses.parse("12 Martin Luther King Road, Bigtown")["street"] == "martin luther king" and addresses.parse("Bigtown 12 Sunlop Road")["street"] == "sunlop"
    assert all(addresses.parse(x) is None for x in (None, "", "-", "same as billing", "N/A", "x" * 50000))


def test_blocks_link_slips_and_keep_post_codes_apart():
    rows = [("kemotehuk", "907030", "sizilartnagar", ""), ("kemoteehuk", "907030", "siziartnagar", ""), ("kemotehuk", "", "siilartnagar", ""), ("kemotehuk", "907999", "sizilartnagar", ""), ("vogesulum", "907030", "", "")]
    c = [k for k, _ in addresses.link_block([addresses.Address(*r) for r in rows])]
    assert c[0] == c[1] == c[2] and len({c[0], c[3], c[4]}) == 3
    # the building decides between two post codes of one street and number
    rows = [("sunlop", "500001", "bigtown", "building:bohudam"), ("sunlop", "500002", "bigtown", "building:kogefex"), ("sunlop", "", "bigtown", "building:kogefex"), ("sunlop", "", "", "")]
    c = [k for k, _ in addresses.link_block([addresses.Address(*r) for r in rows])]
    assert c[2] == c[1] != c[0] and len(set(c)) in (2, 3)


def test_assignment_is_of_least_cost():
    from itertools import permutations

    rng = random.Random(8)
    for _ in range(300):
        n, m = rng.randint(1, 4), rng.randint(4, 5)
        cost = [[rng.choice([0.0, 1.0, 2.0, 99.0]) for _ in range(m)] for _ in range(n)]
        got = addresses.assign(cost)
        assert len(set(got)) == n and sum(cost[i][j] for i, j in enumerate(got)) == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(m), n))
    a = addresses.Address
    near = addresses.link_cost(a("sunlop", "1", "bigtown", "building:x"), a("sunlop", "1", "bigtown", "building:x"))
    assert near < addresses.link_cost(a("sunlop", "1", "bigtown", "building:bohudam"), a("sunlap", "1", "bigtown", "building:kogefex")) <= addresses.MOST
    assert addresses.link_cost(a("sunlop", "", "bigtown", ""), a("sunlop", "", "", "")) > addresses.MOST  # no town in common
    assert addresses.link_cost(a("martin luther", "1", "", ""), a("luther martn", "1", "", "")) <= addresses.MOST


def test_edit_distance():
    assert [addresses.osa(a, b, 3) for a, b in (("ab", "ba"), ("abc", "abc"), ("", "ab"), ("kitten", "sitting"), ("abcdef", "x"))] == [1, 0, 2, 3, 4]


def _labelled() -> list[tuple[str, str]]:
    """Pairs of names as a clerk would have confirmed them."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    out = []
    for full, short in [("Engineering", "Engg"), ("Chemicals", "Chem"), ("Services", "Svcs"), ("Printers", "Prtrs"), ("Foods", "Fds"), ("Logistics", "Logs")]:
        out += [(f"{(w := word()).title()} {full} {form}", f"{w.title()} {short}") for form in ("LLP", "Inc", "Pvt Ltd", "GmbH") for _ in range(4)]
    for full, short in [("Nicholas", "Klaus"), ("Josefina", "Fina"), ("Alexander", "Sasha"), ("Robert", "Bob"), ("Elizabeth", "Liz")]:
        out += [(f"{full} {rng.choice('ABKS')}. {(w := word()).title()}", f"{w.title()}, {short}") for _ in range(12)]
    return out


def test_vocabulary_is_learned_from_pairs():
    v = names.learn_vocabulary(_labelled())
    assert v["engg"] == v["engineering"] == ("trade", "engineering") and v["klaus"][0] == "given" and v["klaus"] == v["nicholas"] and v["fds"] != v["svcs"]
    assert names.learn_vocabulary([]) == {} and not any(len(w) == 8 and w not in ("printers", "services", "nicholas", "josefina") for w in v)
    # held out: pairs whose own names were not taught
    reader = names.Reader(v)
    taught = {n for pair in _labelled() for n in pair}
    fresh = [("Rovatimelu Engineering Inc", "ROVATIMELU ENGG"), ("Nicholas A. Tomikare", "Messrs Tomikare Klaus"), ("Josefina Belaruno", "fina belaruno"), ("Gatusomi Fds", "Gatusomi Foods GmbH")]
    assert all(names.match(reader.profile(a), reader.profile(b)) for a, b in fresh) and not taught & {n for p in fresh for n in p}


def test_names_match_and_veto():
    reader = names.Reader(names.learn_vocabulary(_labelled()))
    p, bare = reader.profile, names.Reader({}).profile
    no = [("Sozunefort Printers LLP", "Sozunefort Foods LLP"), ("Elizabeth B. Gohohopon", "Alexander V. Gohohopon"), ("Robert S. Zafunupom", "Robert V. Zafunupom"), ("Acmelot Foods LLP", "Acmelot Foods GmbH"), ("Acmelot Foods", "Bcnelor Foods")]
    assert not any(names.match(p(a), p(b)) for a, b in no) and names.match(p("Zidizerurt Chemicals LLP"), p("Zidizerurt Chem L.L.P."))
    # nothing is taught about these words
    yes = [("Ramesh Kumar", "Kumar Ramesh"), ("R. Kumar", "Ramesh Kumar"), ("Stephanie Brown", "Brown, Stephanie"), ("Andrew Smith", "Smith, Andy"), ("Sunrise Pharma Pvt Ltd", "Sunrise Pharmaceuticals Pvt Ltd"), ("Gupta Bros Steel Ltd", "Gupta Brothers Steel Ltd")]
    for a, b in yes:
        assert names.match(bare(a), bare(b)) and names.keys_of(bare(a)) & names.keys_of(bare(b)), (a, b)
    assert not any(names.match(bare(a), bare(b)) for a, b in [("Ramesh Kumar", "Suresh Kumar"), ("S. Kumar", "Ramesh Kumar"), ("Gupta Foods Ltd", "Gupta Steel Ltd"), ("Sunrise Pharma Ltd", "Sunset Pharma Ltd"), ("Sunrise Exports Ltd", "Sunrise Exports Carriers Ltd")])
    assert all(bare(x) is None for x in (None, "", " *", "M/s"))


def test_long_names_have_few_keys_and_miss_nothing():
    rng = random.Random(9)
    for size in (22, 24, 25, 26, 60):
        for _ in range(150):
            a = "".join(rng.choice("abdeghilmnoprstu") for _ in range(size))
            b = list(a)
            for _ in range(2):
                i = rng.randrange(len(b) - 1)
                match rng.randrange(4):
                    case 0:
                        del b[i]
                    case 1:
                        b.insert(i, rng.choice("abc"))
                    case 2:
                        b[i] = rng.choice("abc")
                    case _:
                        b[i], b[i + 1] = b[i + 1], b[i]
            reader = names.Reader({})
            p, q = reader.profile(a + " ltd"), reader.profile("".join(b) + " ltd")
            assert not names.match(p, q) or names.keys_of(p) & names.keys_of(q), (a, b)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000))
    assert len(names.keys_of(names.Reader({}).profile(long + " ltd"))) < 500


SHAPES = ocr_text.with_slips({"4 year " + ocr_text.skeleton(w) for w in ("statement", "annex", "schedule")} | {"reference " + ocr_text.skeleton("confidential")})


def test_scanned_words_are_repaired():
    lex = ocr_text.Lexicon({w: 400 for w in "the primary site from responsible hardware cross-check freight requires document under clause of each order part-load a shall be delivered".split()})
    text = "The prirnary s1te from the respons-\nVojedump duty statement 2026\nible hard ware\nreqiiires a cross-\ncheck unclcr clàuse 8 of\npart-load 0rder.\n- 4 -"
    skip = ocr_text.furniture(text.split("\n"), False, None, None, shapes=SHAPES)
    assert skip == {1, 6}
    fixes, words = ocr_text.repair(text, lex, skip)
    assert fixes == [(0, "primary"), (0, "site"), (0, "responsible"), (2, "hardware"), (3, "requires"), (3, "cross-check"), (4, "under"), (4, "clause"), (5, "order")]
    assert ocr_text.paragraphs(text, words, skip) == ["The primary site from the responsible hardware requires a cross-check under clause 8 of part-load order."]
    assert ocr_text.repair("", lex, set()) == ([], []) and ocr_text.paragraphs("", [], set()) == []
    # blanks in the wrong place, several words run together, a word in four parts
    told = lambda t: [w for _, w in ocr_text.repair(t, lex, set())[0]]
    assert told("under th edocument") == ["the", "document"] and told("thedocumentundertheclause") == "the document under the clause".split() and told("shallbedelivered") == ["shall", "be", "delivered"]
    assert told("the re spon si ble order") == ["responsible"] and told("the responsibleord-\ner") == ["responsible", "order"] and told("the Bipovis order") == []
    # a rare word that stands, and one that is read as another
    assert [w for _, w in ocr_text.repair("freigbt of Zernblat", lex, set(), {"freigbt": "freigbt", "zernblat": "zemblat"})[0]] == ["zemblat"]


def test_paragraphs_follow_their_widths():
    lines = ["a" * 60 + ".", "b" * 58, "c" * 20 + ".", "D" * 59, "e" * 60, "f" * 30 + "."]
    assert ocr_text.breaks(lines, set(), list(range(6))) == [False, False, True, False, False]
    assert ocr_text.breaks(["One line.", "", "Two line."], set(), [0, 2]) == [True] and ocr_text.breaks(["x"], set(), [0]) == []
    # a narrow column after a wide one is no run of short lines
    narrow = ["W" * 80, "w" * 79, "w" * 30 + "."] + ["N" * 25, "n" * 24 + ".", "n" * 25, "n" * 9 + "."]
    assert ocr_text.breaks(narrow, set(), list(range(7))) == [False, False, True, False, False, False]


def test_page_furniture():
    lines = ["Confidential TIHOSUR/377", "29 | Bipovis property annex 2025", "Page 3 of 9", "[3]", "— 18 —", "12", "7", "The goods 2025.", "budget 320", "1983.26", "Sozizes claim schedule 2024   15", "Sozizes  claim  scbedule  2024"]
    assert ocr_text.furniture(lines, True, 5, 2, shapes=SHAPES) == {0, 1, 2, 3, 4, 6, 10, 11}
    assert {5, 6} & ocr_text.furniture(lines, False, None, None, shapes=SHAPES) == set()
    # without recurrence no line goes by its looks
    body = ["Payment due 2025", "Goods received in March 2025", "Fiscal year 2024", "16 Apr 2025"]
    assert ocr_text.furniture(body, False, None, None, shapes=SHAPES) == ocr_text.furniture(body, False, None, None) == set()
    assert ocr_text.furniture(body, False, None, None, frozenset({ocr_text.header_key("Fiscal year 2024")})) == {2}
