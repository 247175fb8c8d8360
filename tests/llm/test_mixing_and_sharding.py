import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberfold.llm import mixing, sharding
from emberfold.llm.common import cut


def water_fill(sizes: dict, weights=(5, 2, 1), most=3):
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[n] for n in open_)
        over = {n for n in open_ if level * weight[n] > most * sizes[n]}
        if not over:
            return target | {n: level * weight[n] for n in open_}
        for n in over:
            target[n] = most * sizes[n]
        open_ -= over
    return target


def planned(df):
    slim = cut(mixing.marked(df.select("doc_id", "source", "text")).drop("text"))
    wanted = cut(mixing.targets(slim))
    return mixing.apply_plan(slim, mixing.plan(slim, wanted)), wanted


def test_targets_and_taken(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.choice(["a", "b", "c", "d", "\U0001f600", "￮"], p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]), "w " * int(rng.integers(0, 60))) for i in range(900)]
    rows += [(1000 + i, None, "w " * 7) for i in range(40)]
    rows += [(2000 + i, "a", "same text here") for i in range(400)]
    df = spark.createDataFrame([(i, None if s is None else str(s), t) for i, s, t in rows], "doc_id long, source string, text string").repartition(5)
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[None if s is None else str(s)] += len(t.split())
    out, wanted = planned(df)
    want = {("null" if n is None else "=" + n): v for n, v in water_fill(sizes).items()}
    assert {r["__ef_source"]: r["target"] for r in wanted.collect()} == pytest.approx(want)
    got = out.collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert 0 <= r["__ef_copies"] <= 3
        taken[r["__ef_source"]] += r["__ef_size"] * r["__ef_copies"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = planned(df.repartition(7))[0]
    pick = lambda rs: sorted((r["doc_id"], r["__ef_copies"]) for r in rs)
    assert pick(got) == pick(again.collect())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(0, 300))
def test_fit_is_the_best_that_any_choice_reaches(counts, budget):
    lengths, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    reach = {0}
    for length, c in counts.items():
        reach = {s + length * k for s in reach for k in range(c + 1)}
    x = mixing.fit(lengths, n, budget)
    assert (x >= 0).all() and (x <= n).all()
    everything = int((lengths * n).sum())
    assert int((x * lengths).sum()) == (everything if budget >= everything else max(t for t in reach if t <= budget))


def test_fit_gives_dealt_documents_back():
    assert mixing.fit(np.array([3, 10]), np.array([10, 1]), 10).tolist() == [0, 1]
    lengths, n = np.array([70_000, 90_001]), np.array([40, 40])
    x = mixing.fit(lengths, n, 5 * 90_001)
    assert (x * lengths).sum() == 5 * 90_001


def test_a_long_plan_is_joined_without_a_broadcast(spark):
    rows = [(i, "a", "w " * (i % 7 if i % 3 else 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    slim = cut(mixing.marked(df).drop("text"))
    plan = cut(mixing.plan(slim, cut(mixing.targets(slim))))
    pick = lambda most: sorted((r["doc_id"], r["__ef_copies"]) for r in mixing.apply_plan(slim, plan, most).collect())
    assert pick(0) == pick(10**6) and len(pick(0)) == 600


def test_mix_of_odd_documents(odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.where("text IS NULL OR doc_id IN (2, 3)").count() == 0
    assert mixing.mix(no_docs).count() == 0


def sharded(df, shards):
    return sharding.shard_by_bytes(sharding.sized(df), shards).collect()


def test_shards_are_contiguous_and_balanced(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), "é" * int(rng.integers(0, 400))) for i in rng.permutation(3000)]
    got = sorted(sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 24), key=lambda r: r["doc_id"])
    texts, first = dict(rows), 0
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["first_byte"] == first
        first += r["size"]
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    largest = max(r["size"] for r in got)
    assert all(abs(sizes[k] - first / 24) <= largest for k in range(24))
    assert all(v == list(range(len(v))) for v in slots.values())


def test_shards_of_odd_documents(odd_docs, no_docs):
    got = sharded(odd_docs, 4)
    assert len(got) == odd_docs.count() and sum(r["size"] == 8 for r in got) == 2
    assert sharded(no_docs, 4) == []


def test_sharding_has_no_python(odd_docs):
    plan = sharding.shard_by_bytes(sharding.sized(odd_docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_word_counts(spark):
    texts = ["", "  ", "a", " a\tb\x0bc\n", "x" * 9, "é — ü", " a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.n_words().alias("n"), F.col("text"))
    for r in df.collect():
        assert r["n"] == len(re.findall(r"[^\x20\t-\r]+", r["text"]))
