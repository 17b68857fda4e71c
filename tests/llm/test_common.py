"""What the operators share: exact quantiles, decisions taken back to rows, the shared folder."""

import math
import random
import time
from pathlib import Path

import pytest

from tidemark.llm import common


@pytest.mark.parametrize("held", [100_000, 3, 1])
def test_exact_quantile(spark, held):
    r = random.Random(1)
    rows = [("a", r.gauss(0, 1)) for _ in range(300)] + [("b", float(r.randrange(4))) for _ in range(200)]
    rows += [("c", 5.5), (None, 1.0), (None, -0.0), (None, 0.0), ("d", None), ("e", 1e300), ("e", -1e300), ("e", 1e-300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    for q in (0.0, 0.01, 0.5, 0.99, 1.0):
        want = {k: sorted(v)[max(1, math.ceil(len(v) * q)) - 1] for k, v in groups.items()}
        assert {x.k: x.quantile for x in common.exact_quantile(df, "v", q, "k", held).collect()} == want
        every = sorted(x for v in groups.values() for x in v)
        (x,) = common.exact_quantile(df, "v", q, held=held).collect()
        assert x.quantile == every[max(1, math.ceil(len(every) * q)) - 1]
    assert common.exact_quantile(df.where("false"), "v", 0.5).collect() == []


def test_rows_are_told_apart_by_id_and_key(spark):
    rows = [(1, "a", "x"), (None, "a", "y"), (2, None, "z"), (1, "a", "x"), (3, "b", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key string").withColumnRenamed("row_key", "ROW_KEY")
    keys = docs.select("doc_id", common.row_key().alias("row_key")).where("doc_id is null or doc_id = 2")
    assert sorted(x.doc_id for x in common.drop_rows(docs, keys).collect()) == [1, 1, 3]
    same_hash = keys.selectExpr("99L doc_id", "row_key")
    assert common.drop_rows(docs, same_hash).count() == 5 and common.drop_rows(docs, keys).columns == docs.columns


def test_no_local_folder_on_a_cluster():
    class Stub:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "local-cluster[2,1,1024]"

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: Stub)

    Stub.getCheckpointDir = staticmethod(lambda: type("None_", (), {"isEmpty": lambda self: True})())
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.ensure_checkpoint_dir(Stub)


def test_shuffles_go_once_their_rows_are_written(spark):
    """They would stay until the driver collects its garbage, all those of a long call at once."""
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f.name for d in folders for f in Path(d).glob("*/shuffle_*")}
    before = files()
    counts = spark.range(5000).selectExpr("id % 100 AS k").groupBy("k").count()
    with common.Scratch(spark) as kept:
        one, two = kept.keep(counts), common.cut(counts.where("k < 50"))
        for _ in range(50):
            if not files() - before:
                break
            time.sleep(0.1)
        assert not files() - before
        assert (one.count(), two.count()) == (100, 50)
