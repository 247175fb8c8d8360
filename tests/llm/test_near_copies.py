import random

import numpy as np
import pytest

from emberfold.llm import near_copies as N
from emberfold.llm.common import picked


def slow_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def slow_kept(rows):
    sets = {k: slow_shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(k for k in sets if find(k) == k)


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("file_rows", [3, 2048])
def test_near_copies_match_all_pairs(spark, file_rows):
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 300, 900]))]
        for _ in range(rng.choice([1, 2, 6])):
            rows.append(" ".join(words))
            words = edited(rng, words, max(1, len(words) * rng.choice([1, 2, 4]) // 100))  # chains, some of them broken
    rows += ["", None, " \n", "one", "ONE ", "two words"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    kept = N.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), file_rows=file_rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == slow_kept(rows)


def test_stage_finds_copies_with_edited_words(spark):
    import corpus_pipeline as P

    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(edited(rng, words, 4))) for i in range(8)] + [(9, " ".join(edited(rng, words, 200)))]
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == slow_kept(rows) == [0, 9]


def test_odd_documents(odd_docs, no_docs):
    kept = N.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    keys = [r["doc_id"] for r in kept.collect()]
    assert sorted(k for k in keys if k is not None) == [1, 4, 7, 8, 9] and keys.count(None) == 1
    assert N.deduplicate(no_docs).count() == 0


def test_only_texts_that_may_link_are_shuffled(spark):
    rng = random.Random(7)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    alone, twin = [text() for _ in range(50)], text().split()
    rows = list(enumerate([*alone, " ".join(twin), " ".join(edited(rng, twin, 2))]))
    docs = N.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Exchange hash" not in docs._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(51))


def test_picked_rows(spark):
    numbers = [0, 1, 63, 64, 127, (5 << 33) + 31, (5 << 33) + 63]
    rows = spark.createDataFrame([(n, f"t{n}") for n in [*numbers, *numbers[2:], 2, 62, 65, (5 << 33) + 30, 5 << 34]], "n long, __word string")
    some = spark.createDataFrame([(n,) for n in numbers + numbers[:2] + [77]], "n long")
    out = picked(rows, some, "n")
    assert out.columns == rows.columns
    assert sorted(r["n"] for r in out.collect()) == sorted(numbers + numbers[2:])
    assert picked(rows, some.where("false"), "n").count() == picked(rows.where("false"), some, "n").count() == 0


def test_fingerprints_are_majorities_of_bits():
    for n in (1, 2, 7, 300):
        shingles = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        rows = [np.unpackbits(r.view(np.uint8)) for r in N._mixed(shingles)]
        want = [2 * sum(int(r[i]) for r in rows) > len(rows) for i in range(N.BITS)]
        assert np.unpackbits(np.frombuffer(N.fingerprint_of(shingles), dtype=np.uint8)).astype(bool).tolist() == want


def test_no_pair_at_the_least_similarity_is_far():
    """The chance that a bit differs, for sets that share `both` shingles and have `x` and `y` of their own."""
    from math import comb, erfc, sqrt

    def over(n, need):  # more than `need` of n bits are set
        return sum(comb(n, k) for k in range(n + 1) if k > need) / 2**n

    def differs(both, x, y):
        chance = 0.0
        for k in range(both + 1):
            p, q = over(x, (both + x) / 2 - k), over(y, (both + y) / 2 - k)
            chance += comb(both, k) / 2**both * (p * (1 - q) + q * (1 - p))
        return chance

    most = max(differs(both, x, y) for both in range(1, 60) for x in range(16) for y in range(16) if both >= N.LEAST * (both + x + y))
    assert 0.15 < most < 0.19
    assert erfc((N.FAR - N.BITS * most) / sqrt(2 * N.BITS * most * (1 - most))) / 2 < 1e-6


def test_pivots_discard_and_lose_no_pair():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (3, 400)).astype(np.uint64)
    sets = [np.unique(np.concatenate([b[: 400 - e], rng.integers(0, 2**63, e).astype(np.uint64)])) for b in base for e in (0, 5, 20, 40, 200)]
    prints = np.stack([np.frombuffer(N.fingerprint_of(x), dtype=np.uint64) for x in sets])
    distances = N.pivot_distances(prints, [prints[0].tobytes(), prints[5].tobytes()])
    a, b = np.triu_indices(len(sets), 1)
    near = N._near(prints[a], prints[b], distances[a], distances[b])
    bits = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1)
    assert (near == (bits <= N.FAR)).all()
    assert all(n for i, j, n in zip(a, b, near) if N.similarity(sets[i], sets[j]) >= N.LEAST)
    discarded = np.abs(distances[a] - distances[b]).max(axis=1) > N.FAR
    assert discarded.any() and not (discarded & (bits <= N.FAR)).any()
    same, root, file = np.arange(len(sets)), np.arange(len(sets)), np.zeros(len(sets), dtype=np.int64)
    links = N._apart_in(file, same, root, prints, distances).to_pylist()
    assert {x["a"] // 5 for x in links} == {0, 1, 2} and all(x["a"] // 5 == x["b"] // 5 for x in links)


def test_a_large_component_is_not_dealt_to_itself(spark):
    """Each two rows of different components meet in a file, and rows of the largest are dealt by the others only."""
    roots = [0] * 400 + [1] * 3 + [2] * 2 + list(range(3, 8))
    rows = spark.createDataFrame([(i, r, g) for g in (5, 6) for i, r in enumerate(roots)] + [(i, 1, 7) for i in range(40)], "same long, root long, g long")
    dealt = [tuple(r) for r in N._dealt(rows, "g", N._mixed_groups(rows, "g", 20)).select("file", "same", "root").collect()]
    files, meet = {}, set()
    for file, same, root in dealt:
        files.setdefault(file, []).append((same, root))
    for members in files.values():
        meet |= {(a, b) for a, x in members for b, y in members if x != y}
    assert meet == {(a, b) for a, x in enumerate(roots) for b, y in enumerate(roots) if x != y}
    assert len(dealt) == 2 * (400 * 1 + 10 * (1 + 40))
    assert max(map(len, files.values())) < 60
