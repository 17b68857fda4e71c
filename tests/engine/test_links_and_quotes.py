"""Names linked, quotes against published figures, ingestion in batches."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fold, linking
from tidemark.sources import store
from tidemark.streaming import ingestion

BENEFITS = "plan_id string, benefit_id string, place int, name string, keywords array<string>"


@pytest.fixture(scope="module")
def benefits(spark):
    rows = [
        ("p", "b1", 1, "Massage therapy", ["RMT", "massage"]), ("p", "b2", 2, "Physiotherapy", [f"k{i}" for i in range(8)] + ["late keyword"]),
        ("p", "b3", 3, "Therapy massage", None), ("q", "b4", 1, "Dental", ["teeth"]),
    ]
    return spark.createDataFrame(rows, BENEFITS)


def test_match_benefits(spark, benefits):
    asked = spark.createDataFrame([("p", n) for n in ("massage THERAPY", "rmt", "late keyword", "Dental", " ", "k7")], "plan_id string, name string")
    got = {r.name: (r.benefit_id, round(r.score, 1)) for r in linking.match_benefits(asked, benefits, ["plan_id"]).collect()}
    # of equals the first; a keyword loses three; only the first eight count; other plans' benefits are not met
    assert got == {"massage THERAPY": ("b1", 100.0), "rmt": ("b1", 97.0), "k7": ("b2", 97.0)}


def test_pools(spark, benefits):
    schema = "plan_id string, row_id int, pool_name string, unit string, amount double, benefit_names string, confidence double, place int"
    rows = [
        ("p", 1, "Paramedical", "dollars", 500.0, "Massage therapy, nothing", 0.5, 1), ("p", 2, "paramedical!", "dollars", 700.0, "Physiotherapy", 0.9, 2),
        ("p", 3, "Other", "visits", 12.5, "Massage therapy\nPhysiotherapy", 0.3, 3), ("p", 4, "Other", None, 1.0, "", 0.4, 4), ("p", 5, "Other", None, 1.0, "", 0.2, 5),
        ("p", 6, "Minus", "dollars", -1.0, "", 0.9, 6),
    ]
    own = spark.createDataFrame([("p", 7, "RMT", "the paramedical"), ("p", 8, "RMT", "paramedical"), ("p", 9, "Physiotherapy", None)], "plan_id string, row_id int, benefit_name string, pool_name string")
    pools, links, issues = linking.build_pools(spark.createDataFrame(rows, schema), own, benefits, ["plan_id"])
    assert sorted((r.pool_id, r.unit, r.value, r["rank"]) for r in pools.collect()) == [("pool-other", "visits", 12, 2), ("pool-paramedical", "cents", 70_000, 1)]
    assert {r.benefit_id: r.pool_id for r in links.collect()} == {"b1": "pool-paramedical", "b2": "pool-paramedical"}
    got = sorted((r.row_id or 0, r.code, r.severity) for r in issues.collect())
    assert [x for x in got if x[0] == 0] == [(0, "unlinked_pool", "info")] * 2
    assert (4, "field_missing", "warning") in got and (5, "field_missing", "warning") not in got and not any(x[0] == 1 for x in got)


def test_share_targets(spark, benefits):
    categories = spark.createDataFrame([("p", "c1", 1, "Health practitioners", "extended_health")], "plan_id string, category_id string, place int, name string, kind string")
    rows = spark.createDataFrame(
        [("p", 1, "Deductible", "extended health, RMT; who knows", 0.9, 1), ("p", 2, "deductible", "Physiotherapy", 0.1, 2), ("p", 3, "Copay", "", 0.5, 3)],
        "plan_id string, row_id int, name string, applies_to string, confidence double, place int",
    )
    links, issues = linking.share_targets(rows, categories, benefits, ["plan_id"])
    assert sorted((r.share_id, r.category_id or "", r.benefit_id or "") for r in links.collect()) == [("cs-deductible", "", "b1"), ("cs-deductible", "c1", "")]
    assert sorted((r.row_id, r.severity) for r in issues.collect()) == [(1, "warning"), (3, "info")]


YEAR = fold.Period("benefit_year", start_month=1)
PLAN = fold.PlanRules(
    {
        "massage": fold.Benefit(fold.Coverage("percent_capped", 80, cap=8_000), (fold.Limit(50_000, YEAR),), pool="para"),
        "physio": fold.Benefit(fold.Coverage("percent", 80), pool="para"), "chiro": fold.Benefit(fold.Coverage("percent", 80), pool="para"),
        "drugs": fold.Benefit(fold.Coverage("percent", 80), shares=(fold.Share("drug", "deductible", 2_500, YEAR, "per_family"),)),
        "eyewear": fold.Benefit(fold.Coverage("percent", 100), (fold.Limit(30_000, fold.Period("consecutive_benefit_years", years=2)),)),
        "recall": fold.Benefit(fold.Coverage("percent", 90), frequency=fold.Limit(1, fold.Period("rolling_months", months=9), "services")),
        "major": fold.Benefit(fold.Coverage("percent", 50), waiting_months=12),
    },
    {"para": fold.Limit(150_000, YEAR)}, YEAR, date(2025, 1, 1), days_after_end=90,
)
TODAY = date(2026, 9, 16)


def claim(number, member, status, lines, paid=None):
    own = [{"id": i, "benefit": b, "day": d, "charged": c, "other": o, "quantity": 1} for i, (b, d, c, o) in enumerate(lines)]
    return {"id": number, "member": member, "status": status, "created": number, "paid": paid, "lines": own}


def ask(benefit, charged, day=TODAY, member="a", other=0, history=()):
    (q,) = fold.estimate_claim(PLAN, history, claim("new", member, "draft", [(benefit, day, charged, other)]), TODAY, include_submitted=False)
    return q


def test_quotes():
    q = ask("massage", 12_000)
    assert (q.pays, q.member_pays, q.limited_by, q.limit_left, q.pool_left, q.deadline) == (8_000, 4_000, "per_service_cap", 42_000, 142_000, date(2027, 3, 31))
    past = [claim(i, "a", "paid", [("massage", date(2026, i, 15), 12_000, 0)], 8_000) for i in range(1, 7)]
    q = ask("massage", 12_000, history=past)
    assert (q.pays, q.limited_by, q.limit_left, q.pool_left) == (2_000, "limit", 0, 100_000)
    past = [claim(1, "a", "paid", [("physio", date(2026, 2, 1), 93_750, 0)], 75_000), claim(2, "a", "paid", [("chiro", date(2026, 3, 1), 87_500, 0)], 70_000)]
    q = ask("massage", 10_000, history=past)
    assert (q.pays, q.limited_by, q.limit_left, q.pool_left) == (5_000, "pool", 45_000, 0) and ask("massage", 10_000, member="b", history=past).pays == 8_000
    q = ask("drugs", 4_250)
    assert (q.pays, q.member_pays, q.limited_by) == (1_400, 2_850, "deductible")
    past = [claim(1, "a", "paid", [("drugs", date(2026, 2, 1), 4_250, 0)], 1_400)]
    assert (ask("drugs", 6_000, member="b", history=past).pays, ask("drugs", 4_250, date(2027, 1, 5), history=past).pays) == (4_800, 1_400)
    past = [claim(1, "b", "paid", [("eyewear", date(2025, 6, 10), 18_000, 0)], 18_000)]
    assert (ask("eyewear", 20_000, member="b", history=past).pays, ask("eyewear", 20_000, date(2027, 1, 15), "b", history=past).limited_by) == (12_000, None)
    past = [claim(1, "a", "paid", [("recall", date(2026, 2, 10), 20_000, 0)], 18_000)]
    q = ask("recall", 20_000, history=past)
    assert (q.pays, q.limited_by, q.warnings) == (0, "frequency", (("not_again_until", date(2026, 11, 10)),))
    assert (ask("recall", 20_000, date(2026, 11, 9), history=past).pays, ask("recall", 20_000, date(2026, 11, 10), history=past).pays) == (0, 18_000)
    q = ask("major", 100_000, date(2025, 10, 1))
    assert (q.pays, q.limited_by, q.warnings) == (0, "waiting_period", (("waiting_until", date(2026, 1, 1)), ("deadline_passed", date(2026, 3, 31))))
    assert ask("major", 12_345, date(2026, 2, 1)).pays == 6_173
    assert (ask("physio", 10_000, other=6_000).pays, ask("physio", 10_000, other=6_000).limited_by) == (4_000, "other_plan")
    assert ask("nothing", 5_000, other=1_000).member_pays == 4_000 and ask("nothing", 1).warnings == (("not_in_plan", None),)
    assert ask("massage", 5_000, date(2024, 5, 1)).warnings == (("before_coverage", date(2025, 1, 1)),)


def test_lines_of_one_claim_see_each_other():
    new = claim("x", "a", "draft", [("massage", date(2026, 9, 2), 12_000, 0), ("massage", date(2026, 9, 1), 60_000, 0), ("nothing", TODAY, 1, 0)] + [("massage", date(2026, 9, 3), 12_000, 0)] * 5)
    quotes = fold.estimate_claim(PLAN, [], new, TODAY)
    assert [q.limit_left for q in quotes] == [34_000, 42_000, None, 26_000, 18_000, 10_000, 2_000, 0] and quotes[-1].pays == 2_000
    # the claim itself, if it is there already, is left out
    assert fold.estimate_claim(PLAN, [new | {"status": "submitted"}], new, TODAY) == quotes


def test_ingestion(spark, tmp_path):
    schema = "source string, section string, text string, fetched string"
    batches = [[("s", "1", "a", "t1"), ("s", "2", "b", "t1"), ("u", "1", "x", "t1")], [("s", "1", "a", "t2"), ("s", "3", "c", "t2"), ("s", "3", "c", "t2")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = ingestion.ingest_stream(stream, str(tmp_path / "index"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        now = store.read_version(spark, str(tmp_path / "index"), store.latest_version(spark, str(tmp_path / "index")))
        got = sorted((r.source, r.text, r.fetched) for r in now.collect())
        assert got == [[("s", "a", "t1"), ("s", "b", "t1"), ("u", "x", "t1")], [("s", "a", "t2"), ("s", "c", "t2"), ("u", "x", "t1")]][i]
    assert store.latest_version(spark, str(tmp_path / "index"), below=0) is None and store.latest_version(spark, str(tmp_path / "none")) is None
    store.write_version(now, str(tmp_path / "copy"), 3)
    store.write_version(now.limit(1), str(tmp_path / "copy"), 3)
    assert store.read_version(spark, str(tmp_path / "copy"), 3).count() == 1


def test_hashes_are_stable(spark):
    from tidemark.operators import ingest

    df = spark.createDataFrame([("s", "1", "a")], "source string, section string, text string")
    import hashlib

    assert ingest.with_hashes(df).first().id == "s-" + hashlib.sha256(b"1\na").hexdigest()[:20]
    assert ingest.with_hashes(df.drop("section")).first().id == "s-" + hashlib.sha256(b"\na").hexdigest()[:20]
    assert df.select(ingest.embedding_text(F.lit("t"), F.lit(None), F.col("text"))).first()[0] == "t\n\na"
