"""Queries over tables of their own: that all of the work is asked for, and rows that the given tables don't have."""

import inspect
import random
import uuid

import duckdb

from tidemark.functions import text
from tidemark.operators import evals, known_values
from tidemark.plans import extras, operations


def test_extraction_accuracy_matches_loosely(spark, monkeypatch):
    """Rows without a partner of the same name are scored with the others, as in ``extraction_matches``."""
    asked, real = [], evals.greedy_match

    def noted(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        asked.append(bound.arguments["threshold"])
        return real(*args, **kwargs)

    monkeypatch.setattr(evals, "greedy_match", noted)
    out = operations.extraction_accuracy(spark, "/root/testdata/sf0.001")
    assert asked == [evals.MATCH_SCORE] and out.count()


def test_empty_pages_of_documents_without_text(spark, tmp_path):
    """Empty, blank and null documents against the SQL."""
    texts = ["", " \n", None, "a password", "words", None, "", "", "", "password", None]
    spark.createDataFrame([*enumerate(texts), (18, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.code) for r in extras.empty_pages(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(extras.EMPTY_SQL).fetchall()) and (1, "kept") in got and (18, "ocr_empty") in got


def test_many_known_values_are_made_ready_once(spark, tmp_path, monkeypatch):
    """Documents of a group share what is made of its values, in however many parts those come."""
    made = tmp_path / "made"
    made.mkdir()
    real = known_values.Finder

    def noted(values):
        (made / uuid.uuid4().hex).touch()
        return real(values)

    monkeypatch.setattr(known_values, "Finder", noted)
    docs = spark.createDataFrame([(i, "g" if i % 50 else None, f"see {i % 7}{i % 5}1 there") for i in range(200)], "doc_id bigint, g string, text string")
    known = spark.createDataFrame([(g, f"{a}{b}1", "custom", False, None) for g in ("g", None, "h") for a in range(7) for b in range(5)], "g string, value string, kind string, is_name boolean, token string")
    rows = known_values.find_known(docs, known, "g", most=1).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200)) and all(r.value == r.known for r in rows) and len(list(made.iterdir())) == 2


def test_scores_of_many_are_those_of_one(monkeypatch):
    """Quotes that cannot reach their floor are told together, by a bound that never exceeds the edits of any part, and are not
    scored one by one."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9)))
    pages = [" ".join(word() for _ in range(r.randint(30, 120))) for _ in range(30)]
    pairs = []
    for k in range(120):
        page, size = r.choice(pages), r.randint(20, 150)
        at = r.randrange(max(1, len(page) - size))
        quote = "".join(c if r.random() > (0.02, 0.14, 0.3)[k % 3] else r.choice(["", "~", c + "x"]) for c in page[at : at + size])
        pairs.append((quote, page if k % 4 else r.choice(pages), (85.0, 97.0, 0.0)[k % 5 % 3]))
    quotes, texts, floors = map(list, zip(*pairs))
    assert text.normal_scores(quotes, texts, floors) == [text.normal_score(*p) for p in pairs]

    def edits(quote, page):
        row = [0] * (len(page) + 1)
        for i, c in enumerate(quote, 1):
            before, row = row, [i]
            for j, d in enumerate(page, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
        return min(row)

    bounds = text.least_edits(quotes[:40], texts[:40]).tolist()
    exact = [edits(q, p) for q, p in zip(quotes[:40], texts[:40])]
    assert all(b <= e for b, e in zip(bounds, exact)) and all(b == e for b, e, q in zip(bounds, exact, quotes) if len(q) <= 64) and any(len(q) <= 64 for q in quotes[:40])
    scored = []
    monkeypatch.setattr(text, "partial_ratio", lambda *x: scored.append(x) or 0.0)
    far = [(" ".join(word() for _ in range(25))[:100].ljust(100, "t"), p, 85.0) for p in [*pages, *pages] if len(p) >= 100]
    assert text.normal_scores(*map(list, zip(*far))) == [0.0] * len(far) and len(far) > 40 and not scored
