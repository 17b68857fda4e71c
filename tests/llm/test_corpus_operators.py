"""Quality rules, perplexity, decontamination and the pipeline against brute force on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination, kneser_ney, packing, pii, quality_rules, simhash


def prose(r, n, vocab):
    return " ".join(r.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    words = ["".join(r.choice(["ta", "ri", "mo", "len", "sk", "u"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    good = [prose(r, r.randint(60, 200), words) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(r, 80, words).split()) for _ in range(8)]
    return good, bad


def brute_rules(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def bucket(*words, n=quality_rules.BUCKETS):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if len(h) > 1:
        h = [xxhash.xxh64_intdigest(h[1].to_bytes(8, "little"), xxhash.xxh64_intdigest(h[0].to_bytes(8, "little"), 42))]
    return (h[0] - (1 << 64) if h[0] >> 63 else h[0]) % n


def test_rules_and_ratio(spark, documents, odd_texts, corpus):
    good, bad = corpus
    r = random.Random(2)
    texts = good + bad + odd_texts + [" ".join(r.choice("ab") for _ in range(n)) for n in range(0, 90, 7)]
    texts += ["x y\n x y\nx y\n\n \nz #*$%&|<>", "a b c " * 30, "one two three four " * 2]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40)] + [(60, 0)], "doc_id bigint, quality int")
    rows = {x.doc_id: x for x in quality_rules.quality(documents(texts), labels).collect()}
    grams = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        grams.append([bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:])])
    raw, target = Counter(x for g in grams for x in g), Counter(x for g in grams[:40] for x in g)
    n, m, size = sum(raw.values()), sum(target.values()), quality_rules.BUCKETS
    ratio = lambda x: math.log((target[x] + 1) / (m + size)) - math.log((raw[x] + 1) / (n + size))
    for i, t in enumerate(texts):
        x = rows[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute_rules(t), t
        assert x.score == pytest.approx(sum(map(ratio, grams[i])) / len(grams[i]) if grams[i] else 0.0, abs=1e-9)
        assert x.kept == (not x.base_failed and x.score >= x.threshold)
    assert all(rows[i].kept for i in range(60))
    assert not any(rows[i].kept for i in range(60, 68))


def test_threshold_is_the_unseen_quantile(spark, documents, corpus):
    texts = corpus[0] + corpus[1]
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int")
    got = quality_rules.quality(documents(texts), labels).first().threshold
    grams = [[bucket(x) for x in t.split()] + [bucket(*p) for p in zip(t.split(), t.split()[1:])] for t in texts]
    half = {i for i in range(40) if xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) % 2 == 0}
    raw, target = Counter(x for g in grams for x in g), Counter(x for i in half for x in grams[i])
    n, m, size = sum(raw.values()), sum(target.values()), quality_rules.BUCKETS
    ratio = lambda x: math.log((target[x] + 1) / (m + size)) - math.log((raw[x] + 1) / (n + size))
    # 1 % of under a hundred texts is the lowest
    assert got == pytest.approx(min(sum(map(ratio, grams[i])) / len(grams[i]) for i in range(40) if i not in half), abs=1e-9)


def test_native(spark, documents, corpus):
    labels = spark.createDataFrame([(0, 1)], "doc_id bigint, quality int")
    plan = quality_rules.quality(documents(corpus[0]), labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over dictionaries."""
    top = Counter()
    for t in texts:
        s = "\x02" * (order - 1) + t + "\x03"
        top.update(s[i : i + order] for i in range(len(s) - order + 1))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    p, left = {}, {}
    for k in range(1, order + 1):
        c = levels[k]
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [min(max(j - (j + 1) * y * n[j] / n[j - 1] if n[j - 1] else j * 0.5, 0.05), j - 0.05) for j in (1, 2, 3)] if n[0] else [0.5, 1.0, 1.5]
        total, off = Counter(), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            off[g[:-1]] += d[min(v, 3) - 1]
        for h in total:
            left[h] = off[h] / total[h]
        for g, v in c.items():
            lower = p[g[1:]] if k > 1 else 1 / (len(c) + 1)
            p[g] = (v - d[min(v, 3) - 1]) / total[g[:-1]] + left[g[:-1]] * lower
    unseen = left[""] / (len(levels[1]) + 1)

    def prob(s, i):
        weight = 1.0
        for k in range(order, 0, -1):
            g = s[i - k + 1 : i + 1]
            if g in p:
                return weight * p[g]
            if k > 1:
                weight *= left.get(g[:-1], 1.0)
        return weight * unseen

    def score(t):
        s = "\x02" * (order - 1) + t + "\x03"
        return sum(math.log(prob(s, i)) for i in range(order - 1, len(s)))

    return score


@pytest.mark.parametrize("most", [1, 3, 7, 100])
def test_texts_in_parts(most):
    """However long the parts, every character and end is predicted once, after the characters before it."""
    texts, order = ["", "a", "abcdefg", "xy" * 9, "", "zz\U0001f642z"], 5
    got = {i: [] for i in range(len(texts))}
    for parts in kneser_ney._parts(texts, order, most):
        assert sum(len(b) for *_, b in parts) <= most + max(most, 1) + 1
        joined, codes, ends, owner = kneser_ney._codes(parts, order)
        assert len(codes) == len(joined)
        for e, i in zip(ends.tolist(), owner.tolist()):
            got[i].append(joined[e - order + 1 : e + 1])
    for i, t in enumerate(texts):
        s = "\x02" * (order - 1) + t + "\x03"
        assert got[i] == [s[k : k + order] for k in range(len(t) + 1)]


@pytest.mark.parametrize("shard_rows", [4_000_000, 150])
def test_perplexity(spark, documents, corpus, shard_rows, monkeypatch):
    if shard_rows == 150:
        monkeypatch.setattr(kneser_ney, "SCORED", 64)
    good, bad = corpus
    texts = [t[:200] for t in good[:12]] + [t[:200] for t in bad[:2]] + ["", "漢字 unseen", "tamo ri"]
    docs = documents(texts).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    counts = kneser_ney.count_ngrams(docs.where("doc_id < 8").selectExpr("text", "doc_id % 2 = 0 half"))
    docs = docs.unionByName(docs.where("doc_id = 3"))
    model = kneser_ney.train(counts.selectExpr("0 m", "gram", "n").groupBy("m", "gram").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"))
    model = model.drop("m")
    score = brute_model(texts[:8], kneser_ney.ORDER)
    rows = kneser_ney.perplexities(docs, model, shard_rows=shard_rows).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.log_prob == pytest.approx(score(texts[r.doc_id]), rel=1e-5), r


def test_probabilities_sum_to_one(spark, corpus):
    """Of the trained model: over the characters that may follow a context, and one that is unseen."""
    texts = [t[:100] for t in corpus[0][:5]]
    order = kneser_ney.ORDER
    counts = kneser_ney.count_ngrams(spark.createDataFrame([(t, True) for t in texts], "text string, half boolean"))
    model = {r.gram: r for r in kneser_ney.train(counts.selectExpr("0 m", "gram", "n")).collect()}
    alphabet = [g for g, r in model.items() if len(g) == 1 and r.lp is not None]
    unseen = model[""].lp

    def p(context, c):
        weight = 0.0
        for k in range(len(context), -1, -1):
            h = context[len(context) - k :]
            if h + c in model and model[h + c].lp is not None:
                return math.exp(weight + model[h + c].lp)
            if k and h in model and model[h].lg is not None:
                weight += model[h].lg
        return math.exp(weight + unseen)

    contexts = sorted({g[: order - 1] for g in model if len(g) == order})
    for context in [*contexts[:: max(1, len(contexts) // 40)], "", "zzzz", contexts[0][1:]]:
        left = p(context, "\U0001f642")
        assert sum(p(context, c) for c in alphabet) + left == pytest.approx(1.0, abs=1e-9), context


def test_hash_table():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 63, 5000).astype(np.uint64))
    t = kneser_ney.Table(keys, np.arange(len(keys)), np.arange(len(keys)))
    assert (t.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(r.integers(0, 1 << 63, 5000).astype(np.uint64), keys)
    assert (t.find(other) == -1).all()


def test_classify(spark, documents, corpus):
    """Perplexities, thresholds and verdicts against the plain model; two languages, one of them seldom."""
    good, bad = corpus
    texts = [*good, *bad, "mo ri", "ta", None, "", good[3]]
    langs = ["xx" if i in (2, 5, 61) else None if i == 70 else "en" for i in range(len(texts))]
    docs = documents(texts).drop("lang").join(spark.createDataFrame(list(enumerate(langs)), "doc_id bigint, lang string"), "doc_id")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id bigint, quality int")
    least, quantile = 10, 0.9
    rows = {r.doc_id: r for r in kneser_ney.classify(docs, labels, quantile=quantile, least=least).collect()}
    keys = {r.doc_id: r.row_key for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key")).collect()}
    half = {i for i in range(50) if xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) % 2 == 0}
    whole, part = brute_model(texts[:50], kneser_ney.ORDER), brute_model([texts[i] for i in sorted(half)], kneser_ney.ORDER)
    marked = defaultdict(list)
    for i in sorted(set(range(50)) - half):
        n = len(texts[i]) + 1
        for c in range(n.bit_length()):
            h = xxhash.xxh64_intdigest(c.to_bytes(4, "little"), xxhash.xxh64_intdigest((keys[i] & (1 << 64) - 1).to_bytes(8, "little"), 42))
            at = (h - (1 << 64) if h >> 63 else h) % (n - 2**c + 1)
            piece = texts[i][at : at + 2**c - 1]
            for group in (langs[i], None):
                marked[group, c].append(-part(piece) / 2**c)
    q = {k: sorted(v)[math.ceil(len(v) * quantile) - 1] for k, v in marked.items()}
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        own = [c for c in range(n.bit_length()) if len(marked.get((langs[i], c), ())) >= least] if langs[i] else []
        every = [c for c in range(n.bit_length()) if len(marked[None, c]) >= least] or [max(c for g, c in q if g is None and c < n.bit_length())]
        limit = q[langs[i], own[-1]] if own else q[None, every[-1]]
        ppl = -whole(t or "") / n
        assert rows[i].perplexity == pytest.approx(math.exp(ppl), rel=1e-4) and rows[i].threshold == pytest.approx(math.exp(limit), rel=1e-4), i
        assert rows[i].kept == (ppl <= limit) or abs(ppl - limit) < 1e-4
    usual = {r.doc_id: r.kept for r in kneser_ney.classify(docs, labels).collect()}
    assert all(usual[i] for i in range(60)) and not any(usual[60 + i] for i in range(8))
    assert usual[68]  # a few words are little evidence
    none = kneser_ney.classify(docs, labels.where("doc_id = 1")).collect()
    assert all(r.kept and r.perplexity is None for r in none)


def brute_sw(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_smith_waterman():
    r = np.random.default_rng(4)
    sizes = r.integers(1, 12, 40)
    items, texts = np.full((40, 12), -1), r.integers(1, 5, (40, 25))
    for i, s in enumerate(sizes):
        items[i, :s] = r.integers(1, 5, s)
    # a band that holds every diagonal
    score, _, _ = decontamination.smith_waterman(items, sizes, np.pad(texts, ((0, 0), (12, 12))))
    assert score.tolist() == [brute_sw(items[i, :s].tolist(), texts[i].tolist()) for i, s in enumerate(sizes)]


def test_recall_of_edited_copies():
    """Items of 12 to 60 words, edited by substitution alone or by all three edits, among the text of others: how many of
    those whose full alignment reaches the least score are found."""
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(600)]
    weights = [1 / (i + 3) for i in range(600)]
    items = [" ".join(r.choices(vocab, weights, k=r.randint(12, 60))) for _ in range(120)]
    block = decontamination.Items(list(enumerate(items)))
    for share, floor in ((0.1, 0.99), (0.2, 0.99), (0.3, 0.99)):
        for mixed in (False, True):
            hit = total = 0
            texts = []
            for item in items:
                out = []
                for w in item.split():
                    kind = r.random() if mixed else 0.0
                    if r.random() >= share:
                        out.append(w)
                    elif kind < 1 / 3:
                        out.append(f"new{r.random()}")
                    elif kind < 2 / 3:
                        out += [w, f"new{r.random()}"]
                texts.append(" ".join([*r.choices(vocab, weights, k=40), *out, *r.choices(vocab, weights, k=40)]))
            got = {(t, i) for t, i, *_ in decontamination._align(block, *block.read(texts))}
            for i, t in enumerate(texts):
                a, b = decontamination.words_of(items[i]), decontamination.words_of(t)
                if brute_sw(a, b) >= decontamination.least_score(len(a)):
                    total += 1
                    hit += (i, i) in got
            assert total > 20 and hit >= floor * total, (share, mixed, hit, total)


def test_long_and_repeated_items(spark, documents):
    """Items of many words are found whole, cut short or edited; those of one word over and over cost no more than they hold."""
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    long = [r.choice(vocab) for _ in range(6000)]
    items = [" ".join(long), "again " * 3000, "x", "p q", "a b c"]
    noise = [r.choice(vocab) for _ in range(3000)]
    edited = [w for k, w in enumerate(long[2000:4000]) if k % 9 != 4]
    texts = [" ".join(noise), " ".join(noise + long), " ".join(noise[:500] + edited + noise[:500]), " ".join(noise[:50] + long[1019:1049] + noise[:50]),
             "again " * 4000, "again " * 9, "x p q", "say a b c", " ".join(noise[:90] + long[:8] + noise[:90])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x for x in decontamination.matches(documents(texts), bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (4, 1), (7, 4)}
    assert got[3, 0].score == 30 and (got[3, 0].start_word, got[3, 0].end_word) == (50, 79)
    assert got[1, 0].score >= 512 and got[4, 1].score >= 512 and got[2, 0].score > 300


@pytest.mark.parametrize("block_bytes", [1 << 24, 600])
def test_matches(spark, documents, corpus, block_bytes):
    r = random.Random(5)
    good, _ = corpus
    vocab = sorted({w for t in good for w in t.split()})
    items = [prose(r, r.randint(14, 50), vocab) for _ in range(12)]
    texts, planted = [], set()
    for d in range(60):
        w = good[d % len(good)].split()
        if d % 2:
            k = d // 2 % len(items)
            copy = items[k].split()
            if d % 3 == 0:  # edited: a word changed, one dropped, one put in, case and marks
                copy[len(copy) // 2] = "changed"
                del copy[3]
                copy.insert(7, "new")
                copy = [c.upper() + "," for c in copy]
            at = r.randrange(len(w))
            w[at:at] = copy
            planted.add((d, k))
        texts.append(" ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = decontamination.matches(documents(texts), bench, block_bytes=block_bytes).collect()
    got = {(x.doc_id, x.item_id): x for x in rows}
    want = {}
    for d, t in enumerate(texts):
        for k, i in enumerate(items):
            a, b = decontamination.words_of(i), decontamination.words_of(t)
            if (s := brute_sw(a, b)) >= decontamination.least_score(len(a)):
                want[d, k] = s
    assert planted <= set(want) and set(got) == set(want) and len(rows) == len(got)
    assert all(got[k].score == s for k, s in want.items())
    d, k = next(x for x in planted if x[0] % 3)
    x = got[d, k]
    assert decontamination.words_of(texts[d])[x.start_word : x.end_word + 1] == decontamination.words_of(items[k])


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("every", [4, 5, 6])
def test_edited_copies_alone(spark, documents, corpus, every, exact):
    """Edits destroy seeds; where only edited copies exist, or these and one exact copy, the others still find them."""
    r = random.Random(8)
    good, _ = corpus
    vocab = sorted({w for t in good for w in t.split()})
    items = [prose(r, n, vocab) for n in (8, 16, 25, 60, 120)]
    texts = list(good[:10])
    for item in items:
        copy = [f"edit{k}" if k % every == every - 1 else w for k, w in enumerate(item.split())]
        texts.append(f"{good[11]} {' '.join(copy)} {good[12]}")
    texts += items if exact else []
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontamination.matches(documents(texts), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for k, i in enumerate(items):
            a, b = decontamination.words_of(i), decontamination.words_of(t)
            if (s := brute_sw(a, b)) >= decontamination.least_score(len(a)):
                want[d, k] = s
    assert got == want and {(13, 3), (14, 4)} <= set(want)


def test_item_in_a_third_of_all(spark, documents, corpus):
    good, _ = corpus
    item = " ".join(good[0].split()[:20])
    texts = [f"{good[1 + i % 30]} {item if i % 3 == 0 else ''}" for i in range(90)]
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {x.doc_id for x in decontamination.matches(documents(texts), bench).collect()}
    assert got == set(range(0, 90, 3))


def test_pipeline(spark, tmp_path, corpus):
    """The stages, each on what the one before kept, against the operators' plain versions."""
    good, bad = corpus
    r = random.Random(6)
    vocab = sorted({w for t in good for w in t.split()})
    items = [prose(r, 30, vocab) for _ in range(3)]
    good = [f"{t} write to bob@example.com please" if i in (7, 8, 9, 20, 21, 22) else t for i, t in enumerate(good)]
    texts = [*good[:40], *bad, good[3], good[5], f"{good[41]} {items[1]}", f"{good[42]} write to ann@example.org please"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        ids.append(sorted(x.doc_id for x in docs.select("doc_id").collect()))
    n = len(texts)
    assert ids[0] == [i for i in range(n) if not 40 <= i < 48]
    # of every component of kept documents its smallest id
    fps = {i: simhash.fingerprint(texts[i].encode()) & (1 << 64) - 1 for i in ids[0]}
    assert ids[1] == [i for i in ids[0] if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 2 for j in ids[0])]
    assert not {48, 49} & set(ids[1])
    assert ids[2] == [i for i in ids[1] if i != n - 2] and ids[3] == ids[2]
    last = {x.doc_id: x for x in docs.collect()}
    assert last[n - 1].text.endswith("write to [EMAIL] please") and last[n - 1].n_chars == len(last[n - 1].text)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == set(ids[3])
    encode = packing.public_encoder()
    assert sum(x.length for x in out) == sum(len(encode(x.text)) for x in last.values())
    assert pii.base_spans(last[n - 1].text) == []
