import random

import xxhash

from tidemark.llm import simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            words += [w] if w else []
            w = ""
        else:
            w += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = dict(enumerate(range(len(fps))))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint(spark, odd_texts):
    r = random.Random(1)
    texts = [t for t in odd_texts if t] + [" ".join(r.choice(["a", "B", "cé", "d"]) for _ in range(n)) for n in range(1, 30)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) & (1 << 64) - 1 == brute_fingerprint(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    one = spark.sql("select xxhash64('a b c') h").first().h
    assert signed(xxhash.xxh64_intdigest("a b c", 42)) == one


def near(r, count):
    """Fingerprints in chains and balls, with the top and other bits flipped."""
    fps = {0, (1 << 64) - 1}
    for _ in range(count):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.add(x)
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.choice([0, 31, 32, 63, r.randrange(64)])
    return sorted(fps)


def components_of(spark, fps, dense):
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, dense)).collect()}
    return [got.get(signed(f), signed(f)) for f in fps]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def pairs_of(spark, fps, dense):
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    rows = [(r.a, r.b) for r in simhash.links(df, dense).collect()]
    assert len(rows) == len(set(rows))
    return {tuple(sorted(p)) for p in rows}


def brute_pairs(fps):
    return {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2}


def test_links_and_components(spark):
    fps = near(random.Random(2), 30)
    for dense in (48, 5, 1):
        assert pairs_of(spark, fps, dense) == brute_pairs(fps)
    want = list(brute_components(fps).values())
    for dense in (48, 1):  # 1: every shared bucket takes the way for dense ones
        assert same_partition(components_of(spark, fps, dense), want)


def test_dense_ball(spark):
    r = random.Random(3)
    center = r.getrandbits(64)
    fps = sorted({center ^ (1 << r.randrange(20)) ^ (1 << r.randrange(20)) ^ (1 << r.randrange(40, 60)) for _ in range(150)})
    assert same_partition(components_of(spark, fps, 10), list(brute_components(fps).values()))
    assert pairs_of(spark, fps, 10) == brute_pairs(fps)


def test_long_chain(spark):
    """Far more hops than rounds."""
    x, fps = 0, [0]
    for i in range(400):
        x ^= 0b11 << (2 * i % 62)
        fps.append(x)
    fps = sorted(set(fps))
    assert same_partition(components_of(spark, fps, 48), list(brute_components(fps).values()))


def test_near_duplicates(documents):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(300)] for _ in range(5)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(4):
            c = list(b)
            c[r.randrange(300)] = "changed"
            texts.append(" ".join(c))
    texts += [texts[0], None, ""]
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps)
    docs = documents(texts)
    rows = simhash.near_duplicates(docs)
    got = {x.doc_id: x for x in rows.collect()}
    assert [got[i].component_id for i in range(len(texts))] == [want[i] for i in range(len(texts))]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    distinct = set(fps)
    assert [got[i].n_links for i in range(len(texts))] == [sum(0 < (f ^ g).bit_count() <= 2 for g in distinct) for f in fps]
    kept = simhash.keep_representatives(docs, rows)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))
    twice = docs.union(docs)
    assert sorted(x.doc_id for x in simhash.keep_representatives(twice, simhash.near_duplicates(twice)).collect()) == sorted(set(want.values()))
