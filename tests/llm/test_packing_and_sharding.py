import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing, sharding


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_bins_hold_everything(histogram):
    first = packing.best_fit(histogram, 64)
    bins = packing.local_search(first, 64)
    for b in (first, bins):
        held = Counter()
        for p, n in b.items():
            assert sum(p) <= 64 and n > 0
            for x in p:
                held[x] += n
        assert held == Counter(histogram)
    assert sum(bins.values()) <= sum(first.values())
    table = packing.places(bins)
    for size, n in histogram.items():
        start, _, each, _ = table[size]
        assert start[0] == 0 and (np.diff(start) > 0).all() and start[-1] < n and (each > 0).all()


def test_search_raises_squared_fill():
    bins = {(6, 2): 1, (5, 4): 1, (3,): 1}
    after = packing.local_search(bins, 10)
    assert sum(after.values()) == 2
    r = random.Random(3)
    for _ in range(200):
        bins = dict(Counter(tuple(sorted((r.randint(1, 9) for _ in range(r.randint(1, 2))), reverse=True)) for _ in range(12)))
        bins = {p: n for p, n in bins.items() if sum(p) <= 12}
        after = packing.local_search(bins, 12)
        assert packing._score(after) >= packing._score(bins)
        assert Counter(x for p, n in after.items() for x in p * n) == Counter(x for p, n in bins.items() for x in p * n)


def test_exchanges():
    """One for one, two for one, one for two, and a move: each is found where it alone fits."""
    for low, full, want in (
        ((6,), (5, 2), ((6,), (5,))),
        ((4, 4), (7, 2), ((4, 4), (7,))),
        ((7,), (4, 2, 2), ((7,), (2, 4))),
        ((2,), (8,), ((2,), ())),
    ):
        under = packing._Underfull(10)
        under.add(low), under.add(full)
        taken, other, back = under.best(low, True)
        assert (taken, other, back) == (want[0], full, want[1]), (low, full)


def test_beats_best_fit():
    """Search saves bins that best-fit decreasing alone needs, down to the least number."""
    assert sum(packing.best_fit({4: 2, 3: 4}, 10).values()) == 3
    assert sum(packing.improve(packing.best_fit({4: 2, 3: 4}, 10), 10).values()) == 2
    r = random.Random(4)
    best = found = least = 0
    for _ in range(20):
        sizes = []
        for _ in range(30):  # bins that can be filled whole
            a, b = sorted(r.sample(range(1, 100), 2))
            sizes += [a, b - a, 100 - b]
        first = packing.best_fit(dict(Counter(sizes)), 100)
        best, found, least = best + sum(first.values()), found + sum(packing.improve(first, 100, starts=400).values()), least + 30
    assert least <= found < best


def plain_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pack_round_trip(documents):
    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "be", "çe", "42", "\n"]) for _ in range(r.choice([0, 3, 30, 300, 3000]))) for _ in range(60)]
    texts += [None, "", "漢字 mixed 🙂", "<|endoftext|> in text"]
    docs = documents(texts).repartition(3)
    rows = packing.pack(docs).collect()
    plain = plain_tokenizer()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_bin[x.sequence_id].append(x)
        assert zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 and len(x.ids) == x.length
    for i, t in enumerate(texts):
        own = sorted(by_doc[i], key=lambda x: x.piece)
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert [v for x in own for v in x.ids] == want
        assert [x.piece for x in own] == list(range(len(own)))
        assert all(x.length == 1024 for x in own[1:]) and (len(own) == 1 or len(want) > 1024)
        assert [x.start for x in own] == [sum(y.length for y in own[:k]) for k in range(len(own))]
    for own in by_bin.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 1024
    bins = []  # first-fit decreasing
    for size in sorted((x.length for x in rows), reverse=True):
        at = next((i for i, b in enumerate(bins) if b + size <= 1024), None)
        if at is None:
            bins.append(size)
        else:
            bins[at] += size
    assert len(by_bin) <= len(bins)


def test_encoders_agree(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    encoder, plain = packing.public_encoder(), plain_tokenizer()
    for t in [*(r.text for r in rows), "in <|endoftext|> text", "<|endoftext|>", "<|endoftext|", "漢字 ʼn 🙂", "\u2019s \u00a0 x"]:
        assert encoder(t)[:-1].tolist() == plain.encode(t, add_special_tokens=False).ids
    assert encoder("in <|endoftext|> text").tolist() == [259, 220, 50256, 2420, 2]


def test_equal_rows_and_full_pieces(documents):
    docs = documents(["word " * 3000] * 7 + ["a b c"] * 50, ids=[1] * 57).repartition(3)
    rows = packing.pack(docs, with_ids=False, salt_rows=4).collect()
    places = [(x.sequence_id, x.offset) for x in rows]
    assert len(set(places)) == len(places)
    by_bin = defaultdict(list)
    for x in rows:
        by_bin[x.sequence_id].append((x.offset, x.length))
    for own in by_bin.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 1024
    only = packing.pack(documents([""]), packing.Encoder(packing.public_encoder().path, None), capacity=1).collect()
    assert [(x.length, x.offset) for x in only] == [(1, 0)]


def test_shard(documents):
    r = random.Random(6)
    texts = ["é" * r.randint(0, 300) for _ in range(500)] + [None, ""]
    rows = sharding.shard(documents(texts).repartition(3), shards=8).collect()
    loads, slots = Counter(), defaultdict(list)
    for x in rows:
        raw = (texts[x.doc_id] or "").encode()
        assert x["size"] == len(raw) + 1 and x.text_crc32 == zlib.crc32(raw)
        loads[x.shard] += x["size"]
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert max(loads.values()) - min(loads.values()) <= 601


    assert {x.version for x in rows} == {2}


def test_stored_map_is_used_and_edited(documents, tmp_path):
    """A map stays as it is while shards are balanced; data that skew it make the next version, which moves little."""
    r = random.Random(7)
    texts = ["x" * r.randint(0, 200) for _ in range(4000)]
    path = str(tmp_path / "map")
    docs = documents(texts).repartition(3)
    first = {x.doc_id: x for x in sharding.shard(docs, 4, path=path, tolerance=0.01, slots=256).collect()}
    again = {x.doc_id: x for x in sharding.shard(docs, 4, path=path, tolerance=0.01, slots=256).collect()}
    assert first == again
    version = first[0].version
    hot = [x.doc_id for x in first.values() if x.shard == 0]
    more = [t * 3 if i in set(hot) else t for i, t in enumerate(texts)]
    grown = {x.doc_id: x for x in sharding.shard(documents(more), 4, path=path, tolerance=0.01, slots=256).collect()}
    assert {x.version for x in grown.values()} == {version + 1}
    load = Counter()
    for x in grown.values():
        load[x.shard] += x["size"]
    assert max(load.values()) < 1.02 * sum(load.values()) / 4
    moved = sum(grown[i]["size"] for i in grown if grown[i].shard != first[i].shard)
    over = sum(grown[i]["size"] for i in hot) - sum(load.values()) / 4
    assert moved < 1.1 * over
    assert all(grown[i].shard == 0 or first[i].shard == 0 or first[i].shard == grown[i].shard for i in grown)


def test_one_id_for_all(documents):
    """Rows of a hot id are spread over slots and shards."""
    texts = ["same"] * 3000 + [f"text {i}" for i in range(3000)]
    rows = sharding.shard(documents(texts, ids=[5] * 3000 + [None] * 3000).repartition(3), shards=8).collect()
    load = Counter(x.shard for x in rows)
    assert len(load) == 8 and max(load.values()) < 1.1 * 6000 / 8
    assert max(Counter(x.virtual_slot for x in rows).values()) < 100
    for s in load:
        assert sorted(x.slot for x in rows if x.shard == s) == list(range(load[s]))


def test_rebalance_and_store(spark, tmp_path):
    totals = spark.createDataFrame([(i, (i * 37) % 101 + 1, 1) for i in range(256)], "virtual_slot int, bytes bigint, n bigint")
    path = str(tmp_path / "map")
    assert sharding.last_version(spark, path) is None
    one = sharding.first_map(spark, 8, 256)
    sharding.store_map(one, path)
    sharding.store_map(one, path)  # a write that is tried again
    two = sharding.rebalance(sharding.load_map(spark, path), totals, 9)
    sharding.store_map(two, path)
    every = sharding.load_map(spark, path)
    assert every.count() == 512 and sharding.last_version(spark, path) == 2
    a = {r.virtual_slot: r.shard for r in every.where("version = 1").collect()}
    b = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 2).collect()}
    size = {r.virtual_slot: r.bytes for r in totals.collect()}
    assert a == {i: i % 8 for i in range(256)} and set(b) == set(range(256)) and set(b.values()) == set(range(9))
    load = Counter()
    for s, shard in b.items():
        load[shard] += size[s]
    assert max(load.values()) <= 1.05 * sum(size.values()) / 9
    assert sum(size[s] for s in a if a[s] != b[s]) <= 1.2 * sum(size.values()) / 9
    two = sharding.load_map(spark, path, 2)
    assert not sharding.skewed(two, totals, 9, 0.05) and sharding.skewed(two, totals, 8, 0.5)
    assert sharding.skewed(sharding.load_map(spark, path, 1), totals, 9, 0.5)
    # fewer shards: those of the last are dealt out
    back = {r.virtual_slot: r.shard for r in sharding.rebalance(every, totals, 7).collect()}
    assert set(back.values()) == set(range(7))


def test_dealing_is_greedy(spark):
    """Slots of shards that are gone go, largest first, each to the lightest shard."""
    rows = [(i, b, 1) for i, b in enumerate([9, 7, 7, 5, 3, 3, 2, 0])]
    totals = spark.createDataFrame(rows, "virtual_slot int, bytes bigint, n bigint")
    old = spark.createDataFrame([(1, i, 5) for i in range(8)], "version int, virtual_slot int, shard int")
    got = {r.virtual_slot: r.shard for r in sharding.rebalance(old, totals, 3).collect()}
    load, want = [0, 0, 0], {}
    for i, b, _ in sorted(rows, key=lambda x: (-x[1], x[0])):
        want[i] = load.index(min(load))
        load[want[i]] += b
    assert got == want
