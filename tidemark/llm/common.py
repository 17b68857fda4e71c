"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; where it is unset, a folder of its own on a local master alone, as in
    tests. A cluster must name a folder that all its machines share.
    """
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))


@contextlib.contextmanager
def last_use(spark: SparkSession) -> Iterator[None]:
    """What is written within is read from there, so that its shuffles go once it is, not when the driver collects garbage."""
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors.

    Spark removes its files once nothing refers to it any more: the switch for that is turned on here, unless the session
    has set it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    conf = df.sparkSession.sparkContext._jsc.sc().conf()
    if not conf.contains(CLEAN):
        conf.set(CLEAN, "true")
    with last_use(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame follows the setting under which it was made


class Scratch:
    """Tables that one call writes in the shared folder and reads again, all removed when it is over.

    Like a checkpoint they outlive lost executors and cut the lineage. Unlike one they forget what the optimiser derived of
    sizes, which in loops of joins grows with every round.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.count, self.places = spark, 0, []
        self.path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        at = f"{self.path}/{self.count}"
        with last_use(self.spark):
            df.write.parquet(at)
        table = self.spark.read.schema(df.schema).parquet(at)
        self.places.append((table, at))
        return table

    def drop(self, table: DataFrame) -> None:
        """Remove a table that is needed no more before the call is over."""
        at = next(at for kept, at in self.places if kept is table)
        remove(self.spark, at)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The columns an operator works on, under fixed names; extra columns cannot clash with results."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        *[F.col(f"`{c}`").alias(c) for c in more],
    )


def compact(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """``cut``, then read in as many tasks as the rows need, so that small tables don't shuffle from many."""
    done = cut(df)
    return done.coalesce(max(1, -(-done.count() // rows)))


SMALL_KEYS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark itself uses for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a row, together with its id, for taking decisions back to rows; equal rows share it."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def few(keys: DataFrame, most: int = SMALL_KEYS) -> DataFrame:
    """``keys`` (of a few numbers), marked for broadcast only if a count shows that they are at most ``most``."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def by_key(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` joined (left_anti or left_semi) with ``keys`` (doc_id, row_key); ids are compared too, so that texts of
    equal hash are told apart. Texts are only shuffled if the keys are many.
    """
    keys = few(cut(keys.select(F.col("doc_id").alias("key_id"), "row_key").distinct()))
    name = free_name(docs, "row_key")
    named = docs.withColumn(name, row_key(id_col, text_col)).alias("d")
    same = (F.col(f"d.`{name}`") == keys.row_key) & F.col(f"d.`{id_col}`").eqNullSafe(keys.key_id)
    return named.join(keys, same, how).select(*[F.col(f"d.`{c}`") for c in docs.columns])


def drop_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows named by ``keys`` (doc_id, row_key)."""
    return by_key(docs, keys, "left_anti", id_col, text_col)


def exact_quantile(values: DataFrame, value: str, quantile: float, by: str | None = None, held: int = 100_000) -> DataFrame:
    """(by, quantile): in each group of ``by``, or in all rows, the least value that at least this share of the
    values do not exceed. Nulls don't count; groups without values are left out. ``values`` should be checkpointed.

    Exact, and the same however rows are dealt: counts over 4,096 equal parts of the range that is left close in on the
    rank, until at most ``held`` values a group remain to be sorted.
    """
    group = F.lit(0) if by is None else F.col(f"`{by}`")
    # adding 0 turns -0.0 into 0.0
    rows = values.select(group.alias("g"), (F.col(f"`{value}`") + F.lit(0.0)).alias("x")).dropna(subset=["x"])
    rank = F.greatest(F.lit(1), F.ceil(F.count("*") * quantile)).cast("bigint").alias("k")
    state = rows.groupBy("g").agg(rank, F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    many = state.agg(F.max("n")).first()[0] or 0
    within = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    on = rows.g.eqNullSafe(F.col("s.g"))
    if many > held:
        state = cut(state)
        while state.where((F.col("n") > held) & (F.col("lo") < F.col("hi"))).limit(1).count():
            part = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 4096), F.lit(4095))
            part = F.when(F.col("lo") < F.col("hi"), part).otherwise(0)
            inside = rows.join(few(state).alias("s"), on & within).select("s.g", "k", part.alias("part"), "x")
            counts = inside.groupBy("g", "k", "part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            upto = F.sum("n").over(Window.partitionBy("g").orderBy("part"))  # at most 4,096 rows a group
            reached = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
            state = cut(reached.select("g", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "n", "lo", "hi"))
        # where all that is left is one value, it need not be listed
        left = rows.join(few(state.where("lo < hi")).alias("s"), on & within).groupBy("s.g", "k").agg(F.collect_list("x").alias("xs"))
        one = state.where("lo = hi").select("g", F.col("lo").alias("quantile"))
    else:
        left, one = rows.groupBy("g").agg(rank, F.collect_list("x").alias("xs")), None
    out = left.select("g", F.element_at(F.sort_array("xs"), F.col("k").cast("int")).alias("quantile"))
    out = out if one is None else out.unionByName(one)
    return out.select("quantile") if by is None else out.select(F.col("g").alias(by), "quantile")


def split_join(rows: DataFrame, keyed: DataFrame, key: str, size: str, how: str = "inner", share: int = 5000) -> DataFrame:
    """``rows`` joined with ``keyed``, a written table of one row for each ``key``, whose column ``size`` tells how
    many of the rows have that key. Keys with more than one in ``share`` of the rows, of which there are fewer than that,
    are broadcast, so that their rows stay where they are; all others meet in a shuffle.
    """
    total = keyed.agg(F.sum(size)).first()[0] or 0
    often = F.col(size) > max(50, total // share)
    hot = F.broadcast(keyed.where(often))
    if keyed.where(often).isEmpty():
        return rows.join(keyed, key, how)
    if how == "left":
        # rows of hot keys leave by the first join, the rest by the second
        named = hot.withColumn("is_hot", F.lit(True))
        got = rows.join(named, key, "left")
        rest = rows.join(hot.select(key), key, "left_anti").join(keyed.where(~often), key, "left")
        return got.where("is_hot").drop("is_hot").unionByName(rest)
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed.where(~often), key)
    return rows.join(hot, key).unionByName(rest)
