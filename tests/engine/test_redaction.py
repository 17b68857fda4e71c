"""Aliases, known values, labels, boxes and chat messages."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import labels
from tidemark.functions.streams import compact, spaced, unspaced
from tidemark.operators import aliases, boxes, known_values, redaction
from tidemark.operators.known_values import Known


def test_streams():
    text = "É \t a-1\n(x) ß"
    for stream, want, places in ((compact, "ea1xß", [0, 4, 6, 9, 12]), (spaced, "é a-1 (x) ß", [0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12]), (unspaced, "Éa1xß", [0, 4, 6, 9, 12])):
        chars, at = stream(text)
        assert chars == want and at.tolist() == places
    assert compact("Zoë-Ann 5")[0] == "zoeann5" and compact("")[0] == "" and compact("🙂")[0] == "" and len(spaced("İx")[0]) == 2


def test_apply_aliases():
    a = aliases.Aliases([("Ann", "[A]"), ("Li", "[L]"), ("Jane Q. Doe", "[J]"), ("416 555 0199", "[P]"), ("12 Main Street", "[S]"), ("Doe", "[D]"), ("ann", "[X]"), ("x", "[Y]"), (" ", "[Z]")])
    for text, want in (
        ("call Ann or Li", "call [A] or [L]"), ("jane  q.\ndoe;", "[J];"), ("Jane-Q-Doe", "Jane-Q-[D]"), ("lip annex", "lip annex"), ("(416)555-0199", "[P]"),
        ("x(416) 555.0199", "x([P]"), ("14165550199 and 4165550199x", "14165550199 and 4165550199x"), ("12 main STREET", "[S]"), ("x", "x"), ("", ""), ("Zoë Doe", "Zoë [D]"),
    ):
        assert a.apply(text) == want, text
    assert aliases.Aliases([]).apply("some text") == "some text"


def slow_aliases(text, pairs):
    """One pattern of all values, the longest first."""
    tokens, pieces = {}, []
    key = lambda v: re.sub(r"\s+", " ", v.strip()).lower()
    for v, t in pairs:
        if len(v.strip()) >= 2:
            tokens.setdefault(key(v), t)
    for v in sorted((v.strip() for v, _ in pairs if len(v.strip()) >= 2), key=lambda v: -len(re.sub(r"\s", "", v))):
        pieces.append(r"\s+".join(map(re.escape, v.split())))
    if not pieces:
        return text
    return re.sub(rf"(?<![^\W_])(?:{'|'.join(pieces)})(?![^\W_])", lambda m: tokens[key(m[0])], text, flags=re.I)


@settings(max_examples=200, deadline=None)
@given(st.text("aAb -_é\n", max_size=40), st.lists(st.text("abé -", min_size=1, max_size=5), max_size=5))
def test_aliases_equal_one_pattern(text, values):
    pairs = [(v, f"[{i}]") for i, v in enumerate(values)]
    assert aliases.Aliases(pairs).apply(text) == slow_aliases(text, pairs)


def test_aliases_of_groups(spark):
    docs = spark.createDataFrame([(1, "u", "Ann met Bo"), (2, "v", "Ann met Bo"), (3, "w", "Ann"), (4, "u", None)], "doc_id bigint, user string, text string")
    known = spark.createDataFrame([("u", "Ann", "[A]", 1), ("u", "Bo", "[B]", 2), ("v", "Bo", "[C]", 1), ("v", None, "[N]", 2)], "user string, value string, token string, order int")
    got = {r.doc_id: (r.text, len(r.replaced)) for r in aliases.apply_aliases(docs, known, "user").collect()}
    assert got == {1: ("[A] met [B]", 2), 2: ("Ann met [C]", 1), 3: ("Ann", 0), 4: (None, 0)}
    try:
        aliases.apply_aliases(docs, known, "user", most=1)
    except ValueError as e:
        assert "at most 1" in str(e)
    else:
        raise AssertionError


def test_alias_book(spark):
    """Random assignments against a book kept one by one."""
    r = random.Random(3)
    rows = [(r.choice([1, 2]), i, f"[{r.choice('ABC')}]", r.choice(["member", "custom"]), r.choice(["Jo", " jo ", "J-O", "É", "e", "Li", "..", None])) for i in range(60)]
    want = {}
    for b in (1, 2):
        values, kinds, of = {}, {}, {}
        for _, _, token, kind, value in (x for x in rows if x[0] == b):
            key = compact(value or "")[0]
            if not key:
                continue
            kinds.setdefault(token, kind)
            held = values.setdefault(token, [])
            if key in of and of[key] != token:
                values[of[key]] = [v for v in values[of[key]] if compact(v)[0] != key]
            if all(compact(v)[0] != key for v in held):
                held.append(value.strip())
            of[key] = token
        want |= {(b, t): (kinds[t], v, not v) for t, v in values.items()}
    df = spark.createDataFrame(rows, "b int, order int, token string, kind string, value string").repartition(3)
    assert {(x.b, x.token): (x.kind, x["values"], x.removed) for x in aliases.alias_book(df, "b").collect()} == want


def test_damaged_tokens(spark):
    for text, want in (
        ("{NAME A) x [PHONE_B] y IMEMBER-C] but NAME B and [OTHER_A]", "[NAME_A] x [PHONE_B] y [MEMBER_C] but NAME B and [OTHER_A]"),
        ("pre MEMBER_A post (CERT 1) end", "pre [MEMBER_A] post [CERT_1] end"),
        ("MEMBER_AB [MEMBER_A|MEMBER_B] xMEMBER_A MEMBERSHIP_A", "[MEMBER_AB] [MEMBER_A][MEMBER_B] xMEMBER_A [MEMBERSHIP_A]"),
        ("MEMBER D, GROUPCARD_A", "MEMBER D, GROUPCARD_A"), ("IMEMBER-CI", "[MEMBER_C]"), ("", ""), ("no tokens", "no tokens"),
    ):
        got = aliases.Repaired(text)
        assert got.text.replace("]|[", "][") == want, text
        assert [got.text[a:b] for a, b in got.places] == [t for _, _, t in got.found]
        kept = [i for i in range(len(got.text)) if not any(a <= i < b for a, b in got.places)]
        assert all(got.text[i] == text[got.original(i)] for i in kept)
        assert all(got.original(a) == was for (a, _), (was, _, _) in zip(got.places, got.found)) and got.original(len(got.text)) == len(text)
    r = aliases.Repaired("pre MEMBER_A post (CERT 1) end")
    assert r.share(4, 14) == 1.0 and r.share(0, 8) == 0.5 and r.share(3, 3) == 0.0
    docs = spark.createDataFrame([(1, "a MEMBER_A."), (2, None)], "doc_id bigint, text string")
    one, none = aliases.repair_aliases(docs).orderBy("doc_id").collect()
    assert one.text == "a [MEMBER_A]." and one.tokens[0].asDict() == {"token": "[MEMBER_A]", "start": 2, "end": 12, "was_start": 2, "was_end": 10}
    assert none.text is None and none.tokens == []


def test_shouted_words_may_be_tokens():
    """Marks that may be brackets on both sides make a token of a stem and one or two letters, as in the reference; one mark doesn't."""
    for text, want in (("LA!! DOBO!! CI", "LA![DOB_O]! CI"), ("A!! DOBOCI!! CON", "A![DOB_OC]!! CON"), ("LA, DOBO!! CI", "LA, DOBO!! CI"), ("LA!! DOBO CI", "LA!! DOBO CI")):
        assert aliases.Repaired(text).text == want, text


def test_only_places_where_labels_begin_are_looked_at(monkeypatch):
    """Labels are those found by a look at every word, and few words are looked at."""
    r = random.Random(5)
    words = "plan primary member's name of employee insured patient policy holder card full claimant spouse dependant child surname first given family certificate cert. no id number identification group contract division membership client customer reference claim account ref. date birth d.o.b. DOB born employer sponsor company organisation home mailing residential street postal address work daytime telephone phone mobile cell e-mail email social insurance SIN S.I.N. personal health card medicare individual healthcare identifier tax file OHIP PHN IHI RAMQ TFN HCN bank BSB transit institution the of dear ocean".split()
    texts = ["".join(r.choice(words) + r.choice([" ", " ", ": ", "\n", "\t", ".", "_"]) for _ in range(60)) for _ in range(200)]
    texts += ["".join(w + sep for sep in (": ", " no: ", "\n", "") for w in (u, u.upper(), u.title())) for u in words]
    texts += ["social insurance number: 1", "S. I. N. SOCIAL\tInsurance: 2", "d.o. b: x"]
    first, ahead, shapes = labels._scanner()
    got = [labels.found(t) for t in texts]
    monkeypatch.setattr(labels, "_scanner", lambda: (re.compile(r"(?<![^\W_])(?=[A-Za-z])"), ahead, shapes))
    assert got == [labels.found(t) for t in texts] and {x.label for f in got for x in f} == set(labels.BY_ID)
    plain = "Ouwhea thes of rend and threlyes with ocean, dear people. " * 20
    assert len(list(first.finditer(plain))) == 0


def test_values_are_looked_for_once(spark, monkeypatch):
    a = aliases.Aliases([("Ann", "[A]")])
    places = a.places("call Ann")
    monkeypatch.setattr(aliases.Aliases, "places", None)
    assert a.apply("call Ann", places) == "call [A]"


def test_ways():
    texts = lambda *k: [(w.text, w.part) for w in known_values.ways(Known(*k))]
    assert texts("Dr. Jane Q. Doe", "member", True) == [("Dr. Jane Q. Doe", False), ("Jane Doe", False), ("Doe Jane", False), ("Doe Jane Q", False), ("Jane", True), ("Doe", True)]
    assert texts("12 Oak Crescent, Apartment 4", "address")[:4] == [("12 Oak Crescent, Apartment 4", False), ("12 Oak cres, apt 4", False), ("12 Oak Crescent", True), ("12 Oak cres", True)]
    assert ("9 north street", False) in texts("9 N St.", "address") and ("9 n st", False) not in texts("9 N St.", "address")
    for value, other in (("61 2 9876 5432", "0298765432"), ("416 555 0199", "14165550199"), ("1-416-555-0199", "4165550199"), ("02 9876 5432", "61298765432")):
        assert texts(value, "phone")[1:] == [(other, False)]
    assert texts("Jane", "member", True) == [("Jane", False)] and texts(" ", "custom") == [] and texts("Jane Doe", "custom") == [("Jane Doe", False)]


def test_known_places():
    f = known_values.Finder([Known("Li Wu", "member", True), Known("416 555 0142", "phone"), Known("(Acme)", "employer"), Known("x", "custom")])
    text = "Li\tWu and Li  Wu, LI-WU; A4165550142B x14165550142 (acme) Lisa 94165550142 acmeX"
    got = [(text[h.start : h.end], h.part) for h in f.hits(text)]
    whole = [t for t, part in got if not part]
    assert whole == ["Li  Wu", "Wu, LI", "LI-WU", "4165550142", "14165550142", "(acme)"] and {t for t, part in got if part} == {"Li", "Wu", "LI", "WU"}
    printed = "at 4I6 55S 0l42."
    assert f.hits(printed) == [] and [printed[h.start : h.end] for h in f.hits(printed, True)] == ["4I6 55S 0l42"]
    assert f.hits(None) == f.hits("") == []
    far = "Li" + " " * 40 + "Wu"
    assert all(h.part for h in f.hits(far)) and all(h.part for h in f.hits("Li\n\nWu"))


def test_many_known_values_give_the_same(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("ab1 -") for _ in range(r.randint(2, 6)))
    docs = spark.createDataFrame([(i, f"g{i % 3}", " ".join(word() for _ in range(30))) for i in range(40)], "doc_id bigint, g string, text string")
    known = spark.createDataFrame([(f"g{i % 2}", word(), "custom", False, f"[{i}]") for i in range(60)], "g string, value string, kind string, is_name boolean, token string")
    a, b = (sorted(map(tuple, known_values.find_known(docs, known, "g", most=m).collect())) for m in (1000, 1))
    assert a == b and len(a) > 50 and {x[0] % 3 for x in a} == {0, 1}


FORM = """Member name: Jane Q. Doe and Bob
Date of birth: 3 May 1990
Group policy G-40718-2 x, group policy issued in Ontario
address\t12 Main Street
my name: x
Phone no: (416) 555-0199, Employer Acme Corp Ltd member
SIN 046 454 286 sin 046 454 286
ID number\tDate of birth
1234\t1990-01-02
55567\t2001-3-4

BSB
062-000"""


def test_labels():
    got = [(v.label, FORM[v.start : v.end], v.where) for v in labels.values(FORM)]
    assert got == [
        ("member_name", "Jane Q. Doe", "beside"), ("dob", "3 May 1990", "beside"), ("policy", "G-40718-2", "beside"), ("address", "12 Main Street", "beside"),
        ("phone", "(416) 555-0199", "beside"), ("employer", "Acme Corp Ltd", "beside"), ("sin_acronym", "046 454 286", "beside"), ("certificate", "1234", "column"),
        ("certificate", "55567", "column"), ("dob", "1990-01-02", "column"), ("dob", "2001-3-4", "column"), ("bank", "062-000", "under"),
    ]
    one = lambda t: [(x.label, t[x.start : x.end]) for x in labels.found(t)]
    assert one("Member ID no: 12") == [("certificate", "Member ID")] and one("name: a\tname\tb name:") == [("name_generic", "name"), ("name_generic", "name")]
    assert one("surname: x") == [("name_generic", "surname")] and one("a member of") == [] and one("") == []
    text = "medicare card no. : 2123 45670 1"
    assert labels.label_before(labels.found(text), text, 20, ("health",)) and not labels.label_before(labels.found(text), text, 20, ("bank",))
    assert not labels.label_before(labels.found(text), text, 25, ("health",))
    assert [FORM[:0], *(v.label for v in labels.values("Employer. Claims for your spouse"))] == [""]


def test_learned_values(spark):
    docs = spark.createDataFrame(
        [(1, "s", "Policy no: AB-1234-99"), (2, "s", "see ab 1234 99 there"), (3, "t", "see AB-1234-99"), (4, "s", None)], "doc_id bigint, source string, text string"
    )
    got = sorted((r.doc_id, r.start, r.end, r.token) for r in known_values.learn_and_find(docs, "source").collect())
    assert got == [(1, 11, 21, "POLICY"), (2, 4, 14, "POLICY")]


def slow_merge(rows):
    """All that touch merge, again until none do."""
    now = [(*r, 1) for r in rows]

    def one(a, b):
        if a[:4] != b[:4] or "manual" in (a[4], b[4]):
            return False
        ax, ay, aw, ah, bx, by, bw, bh = (*a[5:9], *b[5:9])
        wide, high = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
        shared = max(wide, 0) * max(high, 0) / max(min(aw * ah, bw * bh), 1e-9)
        return shared >= 0.5 or (a[2] is not None and high >= 0.6 * min(ah, bh) and -wide < 0.6 * max(ah, bh))

    while True:
        root = list(range(len(now)))
        for _ in now:
            for i, a in enumerate(now):
                for j, b in enumerate(now):
                    if i != j and one(a, b):
                        root[i] = root[j] = min(root[i], root[j])
        groups = {}
        for i, r in enumerate(root):
            groups.setdefault(r, []).append(now[i])
        if len(groups) == len(now):
            return sorted((*r[:2], r[2] or "", *r[3:5], *(round(v, 6) for v in r[5:10]), r[10]) for r in now)
        now = []
        for g in groups.values():
            x, y = min(b[5] for b in g), min(b[6] for b in g)
            box = x, y, max(b[5] + b[7] for b in g) - x, max(b[6] + b[8] for b in g) - y
            now.append((*g[0][:5], *box, max(b[9] for b in g), sum(b[10] for b in g)))


def test_boxes(spark):
    r = random.Random(2)
    rows = [
        (r.randrange(2), r.randrange(2), r.choice(["[A]", "[B]", None]), r.random() < 0.8, r.choice(["detector", "detector", "manual"]), r.random() * 0.5, r.random() * 0.2, r.random() * 0.1, 0.01 + r.random() * 0.04, r.random())
        for _ in range(90)
    ]
    schema = "doc_id bigint, page bigint, token string, enabled boolean, source string, x double, y double, w double, h double, confidence double"
    got = boxes.merge_boxes(spark.createDataFrame(rows, schema)).collect()
    assert sorted((x.doc_id, x.page, x.token or "", x.enabled, x.source, *(round(v, 6) for v in (x.x, x.y, x.w, x.h, x.confidence)), x.members) for x in got) == slow_merge(rows)
    assert boxes.merge_boxes(spark.createDataFrame([], schema)).collect() == []


def test_boxes_in_tasks_and_by_joins(spark):
    """Groups swept in their tasks write nothing, and give what joins give; so do dense pages, nulls and odd sizes."""
    r = random.Random(9)
    rows = [
        (r.randrange(3), r.choice([1, None]), r.choice(["[A]", None]), True, r.choice(["a", "b", None]), round(r.random(), 1) * 0.5, round(r.random() * 0.3, 2), r.choice([0.0, 0.03, 0.05]), r.choice([0.0, 0.01, 0.02]), r.choice([None, r.random()]))
        for _ in range(600)
    ] + [(9, 1, "[A]", True, "a", None, 0.1, 0.1, 0.1, 0.5), (9, 1, "[A]", True, "a", 0.1, 0.1, 0.1, -0.1, 0.5), (9, 1, "[A]", True, "a", 0.1, 0.1, 0.1, 0.1, 0.5)]
    schema = "doc_id bigint, page bigint, token string, enabled boolean, source string, x double, y double, w double, h double, confidence double"
    df = spark.createDataFrame(rows, schema).cache()
    plain = lambda out: sorted(tuple("-" if v is None else f"{v:.9f}" if isinstance(v, float) else str(v) for v in x) for x in out.collect())
    swept, joined = boxes.merge_boxes(df), boxes.merge_boxes(df, small=0)
    assert plain(swept) == plain(joined) and len(plain(swept)) < len(rows)
    assert sum(x.members for x in swept.collect()) == len(rows)
    plan = boxes.merge_boxes(df.where("doc_id < 9"))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_chat(spark):
    text = "Born on: 1990-01-02, on 1990-01-02; 416-555-0199, 046 454 286, 9876-543-217 AB, 2123 45670 1 a@b.co"
    assert [(k, t, text[a:b]) for k, t, a, b in redaction.chat_check(text)] == [
        ("DateOfBirth", "hard", "Born on: 1990-01-02"), ("PhoneNumber", "advisory", "416-555-0199"), ("CASocialInsuranceNumber", "hard", "046 454 286"),
        ("CAHealthServiceNumber", "hard", "9876-543-217 AB"), ("CAHealthServiceNumber", "hard", "2123 45670 1"), ("Email", "advisory", "a@b.co"),
    ]
    assert redaction.chat_check("dob 3 May 1990", "AU") == [("DateOfBirth", "hard", 0, 14)] and redaction.chat_check("$123456789 or 1.234567890") == []
    rows = spark.createDataFrame([(1, "AU", "sin 046 454 286 a@b.co"), (2, "CA", None), (3, "CA", "x")], "id int, region string, text string")
    assert [(x.id, x.category) for x in redaction.chat_hits(rows, "region").orderBy("start").collect()] == [(1, "AUTaxFileNumber"), (1, "Email")]
