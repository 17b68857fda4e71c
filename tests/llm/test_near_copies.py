"""The pipeline's near copies against brute force over shingle sets."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import near_copies


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= similarity * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def edited(r, words, changes):
    w = list(words)
    for k in r.sample(range(len(w)), changes):
        w[k] = f"edit{r.random()}"
    return " ".join(w)


def corpus(r):
    """Texts of three lengths with copies of one, three and many changed words, some of them beyond the similarity."""
    vocab = [f"w{i}" for i in range(2000)]
    texts = []
    for size in (60, 200, 600):
        for _ in range(8):
            base = [r.choice(vocab) for _ in range(size)]
            texts += [" ".join(base), edited(r, base, 1), edited(r, base, 3), edited(r, base, size // 45), edited(r, base, size // 12)]
    return [*texts, None, "", " ", "one two", "One  two", "one three"]


@pytest.mark.parametrize("dense", [48, 1])
def test_near_copies(documents, dense):
    texts = corpus(random.Random(1))
    rows = near_copies.near_copies(documents(texts), dense=dense).collect()
    assert len(rows) == len(texts)
    got = {x.doc_id: x.component_id for x in rows}
    want = brute(texts)
    if dense == 48:
        assert [got[i] for i in range(len(texts))] == want
    else:  # stars join no pair that is not alike
        assert all(want[i] == want[got[i]] for i in got)


def test_large_keys_are_exact(documents, monkeypatch):
    """A text that is like one at the edge of a large group alone, and those mostly apart from one another, are found."""
    r = random.Random(9)
    base = [f"w{r.randrange(3000)}" for _ in range(200)]
    texts = [edited(r, base, r.choice([0, 5, 6, 7, 8])) for _ in range(60)]
    for t in texts[:30]:
        words = t.split()
        texts += [edited(r, words, 3), edited(r, words, 4)]
    monkeypatch.setattr(near_copies, "BLOCK", 1 << 13, raising=False)
    monkeypatch.setattr(near_copies, "ROUNDS", 1)
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(documents(texts), dense=1).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_dense_group(documents):
    r = random.Random(2)
    base = [f"w{r.randrange(2000)}" for _ in range(200)]
    texts = [edited(r, base, r.randint(1, 3)) for _ in range(120)]
    got = {x.component_id for x in near_copies.near_copies(documents(texts), dense=20).collect()}
    assert set(brute(texts)) == {0} == got


def test_stage_drops_copies_with_a_changed_word(spark, documents):
    texts = corpus(random.Random(3))
    kept = corpus_pipeline.near_dedup(spark, documents(texts), "").collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(brute(texts)))


def test_empty(documents):
    assert near_copies.near_copies(documents([])).count() == 0
