"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on all trusted text. Tasks count the n-grams of the highest order; joins and aggregates over
tables keyed by n-gram then give continuation counts, discounts, context totals and interpolated probabilities, order
by order. For scoring, the table is dealt into shards by the two characters before the predicted one, which all of
its entries of three or more share; shorter entries go to every shard. The texts are read once for each shard, with one
shard of at most about ``shard_rows`` rows sent out at a time; partial sums of a document meet by its key.

Thresholds come from a second model, of half of the trusted texts, on the other half, since texts that a model has seen
have too low a perplexity. Perplexities of short texts spread more, so that the other half is also scored in pieces of 1,
2, 4 and on characters: a document is rejected if its perplexity is above the ``quantile`` of trusted pieces of its
language and its length class.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compact, cut, exact_quantile, few, keyed_texts
from .common import row_key as key_of
from .quality_rules import trusted_ids

ORDER = 5
START, END = "\x02", "\x03"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Characters that are counted, and scored, at once.
COUNTED, SCORED = 1 << 19, 1 << 17


Part = tuple[int, str, str]  # index of the text, the characters before, characters that are predicted


def _parts(texts: list[str], order: int, most: int) -> Iterator[list[Part]]:
    """Texts and their ends in lists of about ``most`` characters; longer texts go on in the next, with what was before."""
    out: list[Part] = []
    size, pad = 0, START * (order - 1)
    for i, t in enumerate(texts):
        for at in range(0, len(t) + 1, most):
            body = t[at : at + most] + (END if at + most > len(t) else "")
            out.append((i, (pad + t[max(0, at - order + 1) : at])[-(order - 1) :], body))
            size += len(body)
            if size >= most:
                yield out
                out, size = [], 0
    if out:
        yield out


def _codes(parts: list[Part], order: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Parts joined, as a string and code points; which places are predicted; the text of each of these."""
    joined = "".join(before + body for _, before, body in parts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(body) for *_, body in parts), np.int64, len(parts))
    ends = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(parts) + 1) * (order - 1), sizes)
    return joined, codes, ends, np.repeat(np.fromiter((i for i, *_ in parts), np.int64, len(parts)), sizes)


def _hash(codes: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters that end at each of ``ends``; lengths differ in hash."""
    h = np.full(len(ends), size, np.uint64)
    for back in range(size - 1, -1, -1):
        h = h * _BASE + codes[ends - back]
    return h


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of batches, so that few texts are objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def count_ngrams(docs: DataFrame, order: int = ORDER, held: int = 500_000) -> DataFrame:
    """(gram, half, n) of all texts, by ``half`` of docs (text, half): tasks send the counts they hold, at the latest
    when these are ``held``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bool, Counter[str]] = {False: Counter(), True: Counter()}

        def out() -> Iterator[pa.RecordBatch]:
            for half, own in counts.items():
                cols = [pa.array(list(own), pa.string()), pa.array([half] * len(own), pa.bool_())]
                cols.append(pa.array(list(own.values()), pa.int64()))
                own.clear()
                yield pa.RecordBatch.from_arrays(cols, names=["gram", "half", "n"])

        for b in slices(batches):
            rows = list(zip(b.column("text").to_pylist(), b.column("half").to_pylist()))
            for half, own in counts.items():
                for parts in _parts([t for t, h in rows if t and h == half], order, COUNTED):
                    joined, codes, ends, _ = _codes(parts, order)
                    _, first, n = np.unique(_hash(codes, ends, order), return_index=True, return_counts=True)
                    for e, k in zip(ends[first].tolist(), n.tolist()):
                        own[joined[e - order + 1 : e + 1]] += k
                if len(own) >= held:
                    yield from out()
        yield from out()

    got = docs.select("text", "half").mapInArrow(run, "gram string, half boolean, n bigint")
    return got.groupBy("gram", "half").agg(F.sum("n").alias("n"))


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4; usual
    values where there are none.
    """
    if not n[0]:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


def train(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(m, gram, lp, lg) from (m, gram, n) of the highest order, for all models m at once.

    lp: log probability of a gram's last character after the others; lg: log weight of what is left to shorter contexts
    after the whole gram; null where there is none. The row of gram '' has the unseen character's.
    """
    levels = [counts]
    for size in range(order - 1, 0, -1):
        suffix = F.substring("gram", 2, size).alias("gram")
        levels.insert(0, compact(levels[0].groupBy("m", suffix).agg(F.count("*").alias("n"))))
    none = F.lit(None).cast("double")
    probs, tables = None, []
    for size, level in enumerate(levels, 1):
        n = F.col("n")
        told = level.groupBy("m").agg(F.count("*").alias("v"), *[F.count_if(n == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        off, unseen_too = F.lit(0.0), F.lit(1)
        for r in told.collect():  # a row a model
            d = _discounts(list(r[2:]))
            off = F.when(F.col("m") == r.m, F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])).otherwise(off)
            unseen_too = F.when(F.col("m") == r.m, r.v + 1).otherwise(unseen_too)
        rows = level.withColumns({"context": F.substring("gram", 1, size - 1), "off": off})
        totals = rows.groupBy("m", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("left"))
        rest, own = F.col("left"), (n - F.col("off")) / F.col("total")
        if size == 1:
            one = F.broadcast(totals.drop("context"))  # a row a model, that of the empty context
            probs = rows.join(one, "m").select("m", "gram", (own + rest / unseen_too).alias("p"))
            tables.append(totals.select("m", F.lit("").alias("gram"), F.log(rest / unseen_too).alias("lp"), none.alias("lg")))
        else:
            lower = probs.select("m", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            rows = rows.join(totals, ["m", "context"]).withColumn("suffix", F.substring("gram", 2, size - 1))
            probs = rows.join(lower, ["m", "suffix"]).select("m", "gram", (own + rest * F.col("q")).alias("p"))
            tables.append(totals.select("m", F.col("context").alias("gram"), none.alias("lp"), F.log(rest).alias("lg")))
        probs = compact(probs)
        tables.append(probs.select("m", "gram", F.log("p").alias("lp"), none.alias("lg")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("m", "gram").agg(F.max("lp").alias("lp"), F.max("lg").alias("lg"))


class Table:
    """Open addressing over numpy arrays: hash to (lp, lg); nan where there is none."""

    def __init__(self, keys: np.ndarray, lp: np.ndarray, lg: np.ndarray):
        if not len(keys):  # a row that says nothing
            keys, lp, lg = np.zeros(1, np.uint64), np.full(1, np.nan), np.full(1, np.nan)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.at = np.full(1 << bits, -1, np.int32)
        self.keys, self.lp, self.lg = keys, lp.astype(np.float32), lg.astype(np.float32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]  # of several for one slot the last stays
            lost = self.at[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._slot(keys)
        row = self.at[slot]
        todo = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            row[todo] = self.at[slot[todo]]
            todo = todo[(row[todo] >= 0) & (self.keys[row[todo]] != keys[todo])]
        return row


def _log_probs(codes: np.ndarray, ends: np.ndarray, table: Table, order: int, unseen: float) -> np.ndarray:
    """Log probability of the character at each end: the longest gram seen, plus what longer contexts leave."""
    out = np.zeros(len(ends))
    todo = np.arange(len(ends))
    for size in range(order, 0, -1):
        here = ends[todo]
        row = table.find(_hash(codes, here, size))
        lp = np.where(row >= 0, table.lp[row], np.nan)
        hit = ~np.isnan(lp)
        out[todo[hit]] += lp[hit]
        todo = todo[~hit]
        if size > 1 and len(todo):
            row = table.find(_hash(codes, ends[todo] - 1, size - 1))
            lg = np.where(row >= 0, table.lg[row], np.nan)
            out[todo] += np.nan_to_num(lg)
    out[todo] += unseen
    return out


def _keyed(model: DataFrame) -> DataFrame:
    """(key, lp, lg) of a model's rows, with the hash of each gram in place of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column("gram")
            sizes = pc.utf8_length(grams).to_numpy()
            keys = np.zeros(len(grams), np.uint64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                joined = "".join(grams.take(pa.array(own)).to_pylist())
                codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                keys[own] = _hash(codes, np.arange(1, len(own) + 1) * size - 1, int(size))
            cols = [pa.array(keys.view(np.int64)), *(b.column(c).cast(pa.float32()) for c in ("lp", "lg"))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "lp", "lg"])

    return model.select("gram", "lp", "lg").mapInArrow(run, "key bigint, lp float, lg float")


def _shard(model: DataFrame, s: int, shards: int) -> DataFrame:
    """Rows of a model that scoring in shard ``s`` looks up: as a gram a row predicts its last character, as a context the
    next, so that it may be needed for one, the other or both."""
    part = model.where("gram <> ''")
    if shards == 1:
        return part
    a, b = F.substring("gram", -3, 2), F.substring("gram", -2, 2)
    of = lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(shards)) == s
    as_gram, as_context = (F.length("gram") < 3) | of(a), (F.length("gram") < 2) | of(b)
    none = F.lit(None).cast("double")
    lp, lg = F.when(as_gram, F.col("lp")).otherwise(none), F.when(as_context, F.col("lg")).otherwise(none)
    return part.select("gram", lp.alias("lp"), lg.alias("lg")).where("lp is not null or lg is not null")


def _in_shard(codes: np.ndarray, ends: np.ndarray, s: int, shards: int) -> np.ndarray:
    """Which of ``ends`` have two characters before them that are dealt to shard ``s``."""
    pair = (codes[ends - 2] << np.uint64(32)) | codes[ends - 1]
    which, back = np.unique(pair, return_inverse=True)
    raw = ((chr(int(p) >> 32) + chr(int(p) & 0xFFFFFFFF)).encode("utf-8", "surrogatepass") for p in which)
    return np.array([zlib.crc32(x) % shards == s for x in raw], bool)[back]


def perplexities(docs: DataFrame, model: DataFrame, order: int = ORDER, shard_rows: int = 4_000_000) -> DataFrame:
    """Adds n (characters and the end) and log_prob to docs (doc_id, row_key, text, ...), without the text; checkpointed.

    Rows of equal doc_id and row_key must have equal texts, as they have if row_key is ``common.row_key``. A model of
    several shards costs a pass over the texts each; a shard is the most that the driver or a task ever holds.
    """
    sc = docs.sparkSession.sparkContext
    first = model.where("gram = ''").first()
    unseen = float(first[1]) if first and first[1] is not None else -20.0
    shards = max(1, -(-model.count() // shard_rows))
    keep = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", n bigint, log_prob double"
    out, more = None, None
    for s in range(shards):
        got = _keyed(_shard(model, s, shards)).toArrow()
        key, lp, lg = (got.column(c).to_numpy() for c in ("key", "lp", "lg"))
        shared = sc.broadcast((key.view(np.uint64), lp, lg))
        del got, key, lp, lg

        def run(batches: Iterator[pa.RecordBatch], s: int = s, shared=shared) -> Iterator[pa.RecordBatch]:
            table = Table(*shared.value)
            for b in slices(batches):
                texts = [t or "" for t in b.column("text").to_pylist()]
                total = np.zeros(len(texts))
                for parts in _parts(texts, order, SCORED):
                    _, codes, ends, owner = _codes(parts, order)
                    if shards > 1:
                        own = _in_shard(codes, ends, s, shards)
                        ends, owner = ends[own], owner[own]
                    found = _log_probs(codes, ends, table, order, unseen)
                    first = parts[0][0]
                    sums = np.bincount(owner - first, found)
                    total[first : first + len(sums)] += sums
                n = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
                cols = [b.column(c) for c in names] + [pa.array(n), pa.array(total)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n", "log_prob"])

        scored = cut(docs.select(*names, "text").mapInArrow(run, schema))
        shared.destroy()
        if out is None:
            out = scored
        else:  # equal rows have equal sums, so that one of them will do
            scored = scored.groupBy("doc_id", "row_key").agg(F.struct(F.lit(s).alias("s"), F.max("log_prob").alias("p")).alias("p"))
            more = scored if more is None else more.unionByName(scored)
    if more is None:
        return out
    # added up in the order of the shards, so that sums are the same whenever they are made
    more = more.groupBy(F.col("doc_id").alias("id"), F.col("row_key").alias("rk")).agg(F.sort_array(F.collect_list("p")).alias("p"))
    joined = out.join(more, (F.col("row_key") == F.col("rk")) & F.col("doc_id").eqNullSafe(F.col("id")))
    total = F.aggregate("p", F.col("log_prob"), lambda a, x: a + x["p"])
    return cut(joined.select(*names, "n", total.alias("log_prob")))


def _class(n: Column) -> Column:
    """Length class of ``n`` characters and the end: c for 2^c to 2^(c+1) - 1."""
    return (F.length(F.bin(n)) - 1).cast("int")


def pieces_of(texts: DataFrame) -> DataFrame:
    """(doc_id, row_key, lang, text, class): of each text a piece of 2^c - 1 characters for each class c up to its own.

    Where a piece begins is drawn by a hash of the text's key.
    """
    n = F.length("text") + 1
    each = texts.select("*", F.explode(F.sequence(F.lit(0), _class(n.cast("bigint")))).alias("class"))
    size = F.expr("shiftleft(1, class)")
    at = F.pmod(F.xxhash64("row_key", "class"), (n - size + 1).cast("bigint")).cast("int")
    return each.select("doc_id", F.xxhash64("row_key", "class").alias("row_key"), "lang", F.substring("text", at + 1, size - 1).alias("text"), "class")


def thresholds(marked: DataFrame, wanted: DataFrame, quantile: float, least: int) -> DataFrame:
    """(lang, class, limit) for each wanted (lang, class): the exact quantile of log_ppl in ``marked`` (lang, class).

    That of the language's longest class not above the wanted one with ``least`` pieces or more; without any, of the
    longest such class of all languages; without any, of the longest class there is.
    """
    some = F.struct("lang", "class").alias("g")
    every = F.struct(F.lit(None).cast("string").alias("lang"), "class").alias("g")
    both = marked.where("lang is not null").select(some, "log_ppl").unionByName(marked.select(every, "log_ppl"))
    told = cut(exact_quantile(both, "log_ppl", quantile, "g").join(both.groupBy("g").count(), "g"))
    told = told.select("g.lang", F.col("g.class").alias("of"), "quantile", (F.col("count") >= least).alias("enough"))
    own = wanted.join(told.where("enough").withColumnRenamed("lang", "l"), (F.col("lang") == F.col("l")) & (F.col("of") <= F.col("class")))
    own = own.groupBy("lang", "class").agg(F.max_by("quantile", "of").alias("own"))
    # a row a class at most
    rest = wanted.select("class").distinct().join(F.broadcast(told.where("lang is null")), F.col("of") <= F.col("class"))
    rest = rest.groupBy("class").agg(F.max_by("quantile", F.struct("enough", "of")).alias("rest"))
    key = ["lang", "class"]
    out = wanted.join(own.select(*[F.col(c).alias(f"_{c}") for c in key], "own"), F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("class") == F.col("_class")), "left")
    return out.join(rest, "class", "left").select(*key, F.coalesce("own", "rest").alias("limit"))


def classify(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = 0.999, least: int = 50,
    shard_rows: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, lang, n, perplexity, threshold, kept, row_key): one row for each row of ``docs``.

    A document is rejected if its perplexity is above the ``quantile`` of those of pieces of trusted texts, which the
    second model hasn't seen, of its language and length class; see ``thresholds`` for classes of under ``least``
    pieces. Languages without trusted texts, null ones among them, take the quantile of all. Null and empty texts have
    the perplexity of an immediate end and are judged alike. Without trusted texts in both halves all are kept, with
    null perplexity. row_key hashes id and text, for taking decisions back to rows. Repeated rows count and are judged
    each. An empty table gives no rows.
    """
    base = keyed_texts(docs, id_col, text_col, lang_col).withColumnRenamed(lang_col, "lang")
    base = base.withColumn("row_key", key_of())
    ids = trusted_ids(labels)
    trusted = base.join(ids, "doc_id", "left_semi").withColumn("half", F.xxhash64("doc_id") % 2 == 0)
    counts = compact(count_ngrams(trusted, order))
    # model 0 of all trusted texts, model 1 of one half
    both = counts.withColumn("m", F.explode(F.when(F.col("half"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    models = compact(train(compact(both.groupBy("m", "gram").agg(F.sum("n").alias("n"))), order))
    of = lambda m: models.where(F.col("m") == m).drop("m")
    log_ppl = (-F.col("log_prob") / F.col("n")).alias("log_ppl")
    scored = perplexities(base, of(0), order, shard_rows).select("*", log_ppl, _class(F.col("n")).alias("class"))
    unseen = trusted.where("not half and text <> ''").drop("half")
    unseen = unseen.where("false") if of(1).isEmpty() else unseen
    marked = perplexities(pieces_of(unseen), of(1), order, shard_rows).select("*", log_ppl)
    limits = cut(thresholds(marked, cut(scored.select("lang", "class").distinct()), quantile, least))
    limits = limits.select(F.col("lang").alias("l"), F.col("class").alias("c"), "limit")
    out = scored.join(few(limits), F.col("lang").eqNullSafe(F.col("l")) & (F.col("class") == F.col("c")), "left")
    known = F.col("limit").isNotNull()
    return out.select(
        "doc_id", "lang", (F.col("n") - 1).alias("n"), F.when(known, F.exp("log_ppl")).alias("perplexity"),
        F.exp("limit").alias("threshold"), (~known | (F.col("log_ppl") <= F.col("limit"))).alias("kept"), "row_key",
    )
