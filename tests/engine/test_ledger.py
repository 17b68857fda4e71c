"""The fold's rules, its invariants, and its equality with the window forms."""

import random
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import temporal as T
from tidemark.operators import fold
from tidemark.operators import ledger as L

YEAR = fold.Period("benefit_year", start_month=1)


def one(benefit, pools=None, effective=None, **line):
    plan = fold.PlanRules({"b": benefit}, pools or {}, effective=effective)
    args = {"day": date(2025, 5, 1), "charged": 10_000} | line
    return fold.estimate(fold.Ledger(plan), "b", "m", args.pop("day"), args.pop("charged"), **args)


@pytest.mark.parametrize(
    "coverage, line, pays, reason",
    [
        (fold.Coverage("percent", 80), {}, 8_000, "coverage"),
        (fold.Coverage("percent", 100), {}, 10_000, None),
        (fold.Coverage("percent", 50), {"charged": 25}, 13, "coverage"),
        (fold.Coverage("percent", 62.5), {"charged": 100}, 63, "coverage"),
        (fold.Coverage("percent_capped", 80, cap=5_000), {}, 5_000, "per_service_cap"),
        (fold.Coverage("percent_capped", 80, cap=3_000), {"quantity": 2}, 6_000, "per_service_cap"),
        (fold.Coverage("fixed_per_service", amount=2_500), {"quantity": 3}, 7_500, "coverage"),
        (fold.Coverage("per_diem", amount=20_000), {}, 10_000, None),
        (fold.Coverage("schedule", schedule=(("011", 4_000),)), {"code": "Item 011"}, 4_000, "schedule"),
        (fold.Coverage("schedule", schedule=(("011", 4_000),)), {"code": "012"}, 0, "schedule"),
        (fold.Coverage("schedule", percent=50, schedule=(("011", 4_000),)), {"code": "012"}, 5_000, "schedule"),
        (fold.Coverage("percent", 80), {"other": 5_000}, 5_000, "other_plan"),
        (fold.Coverage("percent", 80), {"charged": -5}, 0, None),
    ],
)
def test_coverage(coverage, line, pays, reason):
    assert one(fold.Benefit(coverage), **line)[:2] == (pays, reason)


def test_limiters():
    all_of = fold.Coverage("percent", 100)
    assert one(fold.Benefit(all_of, limits=(fold.Limit(4_000, YEAR),)))[:2] == (4_000, "limit")
    assert one(fold.Benefit(all_of, limits=(fold.Limit(1, YEAR, unit="visits"),)), quantity=4)[:2] == (2_500, "limit")
    assert one(fold.Benefit(all_of, pool="p"), {"p": fold.Limit(3_000, YEAR)})[:2] == (3_000, "pool")
    assert one(fold.Benefit(all_of, shares=(fold.Share("d", "deductible", 2_000),))) == (8_000, "deductible", {"d": 2_000})
    assert one(fold.Benefit(all_of, shares=(fold.Share("c", "copay", 500),)), quantity=2)[:2] == (9_000, "deductible")
    assert one(fold.Benefit(all_of, shares=(fold.Share("c", "coinsurance", 500),)))[:2] == (10_000, None)
    assert one(fold.Benefit(all_of, frequency=fold.Limit(0, YEAR, unit="services")))[:2] == (0, "frequency")
    wait = fold.Benefit(all_of, waiting_months=12)
    assert one(wait, effective=date(2025, 1, 31))[:2] == (0, "waiting_period")
    assert one(wait, effective=date(2024, 1, 31))[:2] == (10_000, None)
    assert one(wait, effective=date(2026, 1, 1))[1] == "not_covered"


def test_per_visit_limit_bounds_each_service():
    b = fold.Benefit(fold.Coverage("percent", 100), limits=(fold.Limit(4_000, fold.Period("per_visit")),))
    claims = [{"id": i, "member": "m", "status": "submitted", "created": i, "lines": [{"id": 0, "benefit": "b", "day": date(2025, 1, 1), "charged": 9_000}]} for i in range(3)]
    assert [e.paid for e in fold.replay(fold.PlanRules({"b": b}), claims).entries] == [4_000] * 3


def test_recorded_outcomes_feed_later_limits():
    b = fold.Benefit(fold.Coverage("percent", 100), limits=(fold.Limit(10_000, YEAR),))
    line = lambda i, d: {"id": i, "benefit": "b", "day": d, "charged": 6_000}
    claims = [
        {"id": 1, "member": "m", "status": "paid", "created": 0, "paid": 3_001, "lines": [line(0, date(2025, 1, 1)), line(1, date(2025, 1, 2))]},
        {"id": 2, "member": "m", "status": "submitted", "created": 0, "lines": [line(0, date(2025, 2, 1)), line(1, date(2025, 2, 2))]},
        {"id": 3, "member": "m", "status": "draft", "created": 0, "lines": [line(0, date(2025, 1, 1))]},
    ]
    assert [e.paid for e in fold.replay(fold.PlanRules({"b": b}), claims).entries] == [1_801, 1_200, 6_000, 999]
    assert len(fold.replay(fold.PlanRules({"b": b}), claims, include_submitted=False).entries) == 2


cents, days = st.integers(0, 50_000), st.integers(0, 900)
periods = st.sampled_from([YEAR, fold.Period("lifetime"), fold.Period("rolling_months", months=6), fold.Period("consecutive_benefit_years", years=2), fold.Period("per_visit"), fold.Period("policy_anniversary")])
limits = st.builds(fold.Limit, cents, periods, st.sampled_from(["cents", "visits"]), st.sampled_from(["per_person", "per_family"]))


@st.composite
def plans(draw):
    coverage = st.one_of(
        st.builds(lambda p: fold.Coverage("percent", p), st.sampled_from([50.0, 80.0, 100.0])),
        st.builds(lambda p, c: fold.Coverage("percent_capped", p, cap=c), st.just(80.0), cents),
        st.builds(lambda a: fold.Coverage("fixed_per_service", amount=a), cents),
    )
    shares = st.lists(st.builds(fold.Share, st.sampled_from(["a", "b"]), st.sampled_from(["deductible", "copay"]), cents), max_size=2, unique_by=lambda s: s.name)
    benefit = st.builds(
        fold.Benefit, coverage, st.lists(limits, max_size=2).map(tuple), shares.map(tuple), st.sampled_from([None, "p"]),
        st.one_of(st.none(), st.builds(fold.Limit, st.integers(0, 6), periods, st.just("services"))),
    )
    return fold.PlanRules({0: draw(benefit), 1: draw(benefit)}, {"p": draw(limits)}, effective=draw(st.sampled_from([None, date(2023, 2, 28)])))


@st.composite
def claim_lists(draw):
    lines = st.lists(
        st.fixed_dictionaries({"benefit": st.integers(0, 1), "day": days.map(lambda d: date(2023, 1, 1) + timedelta(d)), "charged": cents, "other": st.integers(0, 20_000), "quantity": st.integers(0, 4)}),
        min_size=1, max_size=3,
    )
    out = []
    for i in range(draw(st.integers(0, 6))):
        own = [x | {"id": k} for k, x in enumerate(draw(lines))]
        status = draw(st.sampled_from(["submitted", "paid", "partially_paid", "draft"]))
        out.append({"id": i, "member": draw(st.sampled_from("mn")), "status": status, "created": 0, "paid": draw(st.one_of(st.none(), cents)), "lines": own})
    return out


def rescanned(ledger, plan, key, limit, member, day):
    """What is used of a rule, by a look at all entries."""
    w = fold.window(limit.period, day, plan)
    if w is None:
        return None
    names = {n for n, b in plan.benefits.items() if b.pool == key[1]} if key[0] == "pool" else {key[1]}
    return sum(
        ledger._measure(e, limit.unit) for e in ledger.entries
        if e.benefit in names and (limit.scope != "per_person" or e.member == member) and w[0] <= e.day <= w[1]
    )


@settings(max_examples=150, deadline=None)
@given(plans(), claim_lists())
def test_invariants(plan, claims):
    ledger = fold.replay(plan, claims)
    lines = {(c["id"], x["id"]): (c, x) for c in claims for x in c["lines"]}
    for e in ledger.entries:
        c, x = lines[e.claim, e.line]
        if c["status"] == "submitted" or c["paid"] is None:
            assert 0 <= e.paid <= max(0, x["charged"] - min(x["charged"], x["other"]))
    for c in claims:
        own = [e for e in ledger.entries if e.claim == c["id"]]
        if c["status"] in ("paid", "partially_paid") and c["paid"] is not None:
            assert sum(e.paid for e in own) == c["paid"]
    for name, b in plan.benefits.items():
        rules = [(("limit", name, i), x) for i, x in enumerate(b.limits)] + ([(("pool", b.pool), plan.pools["p"])] if b.pool else [])
        for key, limit in rules:
            for day in (date(2023, 6, 1), date(2024, 12, 31)):
                assert ledger.used(key, limit, "m", day) == rescanned(ledger, plan, key, limit, "m", day)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.lists(st.integers(-5, 10**6), min_size=1, max_size=8))
def test_allocation_is_exact(total, weights):
    parts = fold.allocate(total, weights)
    assert sum(parts) == total and all(p >= 0 for p in parts)
    whole = sum(w for w in weights if w > 0)
    if whole:
        assert all(abs(p - total * max(0, w) / whole) < 1 + 1e-3 for p, w in zip(parts, weights))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(cents, st.integers(1, 2)), max_size=12), st.integers(0, 60_000))
def test_capped_prefix_is_the_fold(rows, cap):
    plan = fold.PlanRules({0: fold.Benefit(fold.Coverage("percent", 100), limits=(fold.Limit(cap, fold.Period("lifetime")),))})
    claims = [{"id": i, "member": m, "status": "submitted", "created": i, "lines": [{"id": 0, "benefit": 0, "day": date(2025, 1, 1), "charged": c}]} for i, (c, m) in enumerate(rows)]
    run: dict[int, int] = {}
    want = []
    for c, m in rows:
        before = run.get(m, 0)
        run[m] = before + c
        want.append(min(cap, run[m]) - min(cap, before))
    assert [e.paid for e in fold.replay(plan, claims).entries] == want


def test_windows_agree_with_columns(spark):
    """The fold's calendar and the column functions give the same windows."""
    from pyspark.sql import functions as F

    kinds = ["benefit_year", "policy_anniversary", "rolling_months", "consecutive_benefit_years", "lifetime", "per_visit"]
    rows = []
    for i, d in enumerate(date(2019, 12, 25) + timedelta(17 * k) for k in range(90)):
        eff = [date(2020, 2, 29), date(2018, 7, 31), date(2030, 1, 1)][i % 3]
        for kind in kinds:
            for plan_kind, sm in (("benefit_year", 7), ("benefit_year", None), ("policy_anniversary", None)):
                rows.append((d, eff, kind, plan_kind, sm, 31))
    df = spark.createDataFrame(rows, "d date, eff date, kind string, plan_kind string, sm int, sd int")
    w = T.period_window(T.Period(F.col("kind"), F.lit(18), F.lit(3)), F.col("d"), T.Plan(F.col("eff"), F.col("plan_kind"), F.col("sm"), F.col("sd")))
    for r in df.select("*", w.alias("w")).collect():
        plan = fold.PlanRules({}, period=fold.Period(r.plan_kind, start_month=r.sm, start_day=r.sd), effective=r.eff)
        want = fold.window(fold.Period(r.kind, months=18, years=3), r.d, plan)
        assert (want is None) == (r.w is None) and (want is None or want == (r.w.start, r.w.end)), r
        if want:
            assert want[0] <= r.d <= want[1]


def test_bridges(spark):
    pools = spark.createDataFrame([("x", 0, [1, 2]), ("y", 1, [2, 3])], "pool_id string, place int, benefit_ids array<bigint>")
    benefits = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "gone"), (5, None)], "benefit_id bigint, pool_id string")
    assert sorted(tuple(r) for r in L.pool_members(pools, benefits).collect()) == [("x", 1), ("x", 2), ("x", 3)]


def long_family(lines, seed=5):
    """A family's claims in order, one at a time: a plan with rolling windows, years and a lifetime."""
    r = random.Random(seed)
    day = date(1990, 1, 1)
    for i in range(lines // 2):
        day += timedelta(i % 7 == 0)
        status = r.choice(["submitted", "paid"])
        own = [{"id": k, "benefit": k % 2, "day": day + timedelta(k * r.randint(0, 40)), "charged": r.randint(0, 9_000), "quantity": 1} for k in (0, 1)]
        yield {"id": i, "member": r.choice("mnop"), "status": status, "created": i, "paid": r.choice([None, 5_000]) if status == "paid" else None, "lines": own}


LONG_PLAN = fold.PlanRules(
    {
        0: fold.Benefit(fold.Coverage("percent", 80.0), (fold.Limit(30_000, YEAR), fold.Limit(20, fold.Period("rolling_months", months=3), "visits")), pool="p"),
        1: fold.Benefit(fold.Coverage("percent", 50.0), (fold.Limit(9_000_000, fold.Period("lifetime"), scope="per_family"),), pool="p"),
    },
    {"p": fold.Limit(90_000, YEAR, scope="per_family")},
)


def test_ledger_lets_go_of_what_is_over():
    """Claims in a stream give what the whole family gives, and what is held doesn't grow with them."""
    some = list(long_family(4_000))
    ledger = fold.Ledger(LONG_PLAN, listed=False)
    got = [(e.claim, e.line, e.paid, e.limited_by) for own in fold.replay_sorted(ledger, iter(some)) for e in own]
    assert got == [(e.claim, e.line, e.paid, e.limited_by) for e in fold.replay(LONG_PLAN, some).entries]
    most = 0
    ledger = fold.Ledger(LONG_PLAN, listed=False)
    for _ in fold.replay_sorted(ledger, long_family(40_000)):
        most = max(most, len(ledger.totals) + sum(map(len, ledger.of_benefit.values())))
    assert ledger.entries == [] and most < 8_000


def test_families_in_a_stream(spark):
    """Families of all sizes, with drafts, benefits out of the plan and recorded outcomes, as by the fold of each."""
    r = random.Random(9)
    rows, families = [], {}
    for cid in range(400):
        fam = r.choice([1, 1, 1, 2, 3, 4])
        c = {"id": cid, "member": fam * 10 + r.randrange(3), "status": r.choice(["submitted", "paid", "partially_paid", "draft"]), "created": date(2024, 1, r.randint(1, 28)), "paid": None, "lines": []}
        if c["status"] != "submitted" and r.random() < 0.6:
            c["paid"] = r.randrange(9_000)
        for k in range(r.randint(1, 4)):
            line = {"id": k, "benefit": r.randrange(3), "day": date(2024, 1, 1) + timedelta(r.randrange(500)), "charged": r.randrange(9_000), "other": r.randrange(900), "quantity": r.randint(0, 3)}
            c["lines"].append(line)
            rows.append((fam, cid, c["member"], c["status"], c["created"], c["paid"], k, line["benefit"], line["day"], line["charged"], line["other"], line["quantity"]))
        families.setdefault(fam, []).append(c)
    schema = "family_id bigint, claim_id bigint, member_id bigint, status string, created date, paid_cents bigint, line_id bigint, benefit_id bigint, service_date date, charged_cents bigint, other_cents bigint, quantity bigint"
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = sorted(tuple(x) for x in fold.replay_families(df, LONG_PLAN).select("claim_id", "line_id", "member_id", "benefit_id", "paid_cents", "limited_by").collect())
    want = sorted((e.claim, e.line, e.member, e.benefit, e.paid, e.limited_by) for cs in families.values() for e in fold.replay(LONG_PLAN, cs).entries)
    key = lambda rows: [tuple("" if v is None else v for v in x) for x in rows]
    assert sorted(key(got)) == sorted(key(want))


def test_quotes_replay_only_what_counts(spark, monkeypatch):
    """Quotes of families by lines that count are those on the ledger of all; a plan without rules replays nothing."""
    r = random.Random(8)
    year = fold.Period("benefit_year", start_month=1)
    plain = {3: fold.Benefit(fold.Coverage("percent", 80.0)), 4: fold.Benefit(fold.Coverage("percent", 50.0), waiting_months=6)}
    bound = {
        1: fold.Benefit(fold.Coverage("percent", 80.0), limits=(fold.Limit(9_000, year),), shares=(fold.Share("d", "deductible", 2_000, year),)),
        2: fold.Benefit(fold.Coverage("percent", 90.0), shares=(fold.Share("d", "deductible", 2_000, year),)),
    }
    plan = fold.PlanRules({**plain, **bound}, effective=date(2000, 1, 1))
    rows = []
    for i in range(120):
        paid = r.choice([None, r.randrange(9_000)])
        head = (i % 7, i, i % 14, r.choice(["submitted", "paid", "draft"]), date(2000, 1, 1 + i % 28), paid)
        rows += [(*head, n, r.randrange(1, 6), date(2000, r.randint(1, 12), 5), r.randrange(8_000), r.choice([0, 500]), 1) for n in range(r.randint(1, 3))]
    schema = "family_id int, claim_id bigint, member_id bigint, status string, created date, paid_cents bigint, line_id bigint, benefit_id bigint, service_date date, charged_cents bigint, other_cents bigint, quantity bigint"
    df = spark.createDataFrame(rows, schema)
    got = sorted((x.claim_id, x.line_id, x.pays, x.member_pays, x.limited_by, x.limit_left) for x in fold.quote_families(df, plan).collect())
    want, families = [], {}
    for f, cid, member, status, created, paid, line, benefit, day, charged, other, quantity in rows:
        c = families.setdefault(f, {}).setdefault(cid, {"id": cid, "member": member, "status": status, "created": created, "paid": paid, "lines": []})
        c["lines"].append({"id": line, "benefit": benefit, "day": day, "charged": charged, "other": other, "quantity": quantity})
    for claims in families.values():
        for c in claims.values():
            if c["status"] == "submitted":
                want += [(c["id"], x["id"], q.pays, q.member_pays, q.limited_by, q.limit_left) for x, q in zip(c["lines"], fold.estimate_claim(plan, claims.values(), c))]
    assert got == sorted(want)
    replayed = []
    replay = fold.replay
    monkeypatch.setattr(fold, "replay", lambda plan, claims, *a: replayed.extend(known := list(claims)) or replay(plan, known, *a))
    assert len(list(fold.quotes_of(fold.PlanRules(plain), list(families[0].values())))) > 0 and replayed == []


def test_windows_are_made_once_a_date():
    from tidemark.plans.benefits import STATE_RULES

    fold._window.cache_clear()
    lines = [{"day": date(1995, 3, 1 + i % 5), "id": i, "benefit": i % 10, "charged": 9000, "other": 0, "quantity": 1} for i in range(200)]
    assert len(list(fold.replay_sorted(fold.Ledger(STATE_RULES, listed=False), [{"id": 1, "member": 1, "status": "paid", "paid": None, "lines": lines}]))) == 1
    info = fold._window.cache_info()
    assert info.misses <= 5 * 3 < info.hits
