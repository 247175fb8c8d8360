import math
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from emberfold.llm import ctw
from emberfold.llm.common import bucket_of

DEPTH = 3


def slow_model(train):
    """log10 probability of a byte after its context, straight from the definition, node by node."""
    at = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for text in train:
        data = bytes(DEPTH) + text + b"\0"
        for i in range(DEPTH, len(data)):
            for level in range(8):
                bit, prefix = data[i] >> (7 - level) & 1, (1 << level) | data[i] >> (8 - level)
                for d in range(DEPTH + 1):
                    context = data[i - d : i]
                    at[prefix, context][bit] += 1
                    if d:
                        children[prefix, context[1:]].add(context)

    @lru_cache(None)
    def log_e(a, b):
        out = 0.0
        for k in range(a):
            out += math.log((k + 0.5) / (k + 1))
        for k in range(b):
            out += math.log((k + 0.5) / (a + k + 1))
        return out

    @lru_cache(None)
    def log_w(prefix, context):
        own = log_e(*at[prefix, context])
        if len(context) == DEPTH:
            return own
        through = sum(log_w(prefix, c) for c in sorted(children[prefix, context]))
        return np.logaddexp(own, through) + math.log(0.5)

    def bit_probability(prefix, context, bit, d=0):
        here = context[len(context) - d :] if d else b""
        counts = at.get((prefix, here), [0, 0])
        own = (counts[bit] + 0.5) / (sum(counts) + 1)
        if d == DEPTH:
            return own
        deeper = context[len(context) - d - 1 :]
        if sum(at.get((prefix, deeper), [0, 0])) == 0:
            return own
        stop = math.exp(log_e(*counts) + math.log(0.5) - log_w(prefix, here))
        return stop * own + (1 - stop) * bit_probability(prefix, context, bit, d + 1)

    def score(text):
        data, out = bytes(DEPTH) + text + b"\0", 0.0
        for i in range(DEPTH, len(data)):
            for level in range(8):
                out += math.log10(bit_probability((1 << level) | data[i] >> (8 - level), data[i - DEPTH : i], data[i] >> (7 - level) & 1))
        return out

    return score


def test_scores_match_the_definition(spark):
    texts = ["the cat sat", "the cat ran", "a dog sat on the mat", "", None, "the dog", "zebra é", "Cat the SAT", "the cat sat"]
    rows = [(i, t, i % 3 != 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t or "", train) for i, t, train in rows], "doc_id long, text string, train boolean").repartition(3)
    slow = slow_model([(t or "").encode().lower() for _, t, train in rows if train])
    got = {r["doc_id"]: r for r in ctw.score(docs, DEPTH)[0].collect()}
    words = Counter(w for _, t, train in rows if train for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(words.values()), len(words)
    for i, t, _ in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        assert got[i]["score"] == pytest.approx(slow((t or "").encode().lower()), abs=1e-8)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
        assert got[i]["n_tokens"] == len(tokens) and got[i]["n_known"] == sum(words[w] > 0 for w in tokens)


def test_estimates_add_up_to_one():
    assert math.exp(ctw.log_kt(np.array([1.0]), np.array([0.0]))[0]) == pytest.approx(0.5)
    for n in (3, 70_000):
        a = np.arange(n + 1, dtype=float) if n < 10 else np.array([0.0, 1, 35_000, n])
        exact = [math.lgamma(x + 0.5) + math.lgamma(n - x + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n + 1) for x in a]
        assert ctw.log_kt(a, n - a) == pytest.approx(exact, rel=1e-9)


def test_grams_see_contexts_within_their_text_only():
    keys, of = ctw.grams([b"ab", b"", b"c"], 2)
    spell = [(k >> 16, k >> 8 & 255, k & 255) for k in keys.tolist()]
    assert spell == [(0, 0, 97), (97, 0, 98), (98, 97, 0), (0, 0, 0), (0, 0, 99), (99, 0, 0)]
    assert of.tolist() == [0, 0, 0, 1, 2, 2]


def test_chunks_and_steps_change_nothing(odd_docs):
    docs = ctw.split_by_key(odd_docs)
    pick = lambda *sizes: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["score"], 6), round(r["base_score"], 6)) for r in ctw.score(docs, ctw.DEPTH, *sizes)[0].collect())
    assert pick(60, 7) == pick()


def test_packed_values_come_back():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, 1000))
    assert (ctw.unpack(ctw.pack(keys, rising=True), np.int64, rising=True) == keys).all()
    values = rng.normal(size=77)
    assert (ctw.unpack(ctw.pack(values), np.float64) == values).all()
    assert len(ctw.unpack(ctw.pack(np.zeros(0)), np.float64)) == 0


def test_held_out_texts_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "aaa bbb", True), (2, "xyz xyz xyz", False)], "doc_id long, text string, train boolean")
    both, totals = ctw.score(docs, DEPTH)
    alone, _ = ctw.score(docs.where("train"), DEPTH)
    assert both.where("train").first() == alone.first() and totals.train_tokens == 3
    r = both.where("doc_id = 2").first()
    assert r["n_known"] == 1 and r["n_tokens"] == 4


def test_longer_training_helps(spark):
    text = "the quick brown fox jumps over the lazy dog again and again "
    rows = [(i, text * 3, True) for i in range(20)] + [(99, text, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    r = ctw.score(docs)[0].where("doc_id = 99").first()
    assert r["score"] > r["base_score"] and -r["score"] / r["n_bytes"] / math.log10(2) < 0.5


def test_odd_documents(odd_docs, no_docs):
    docs = ctw.split_by_key(odd_docs)
    got = ctw.score(docs)[0].collect()
    assert len(got) == 10 and all(r["score"] < 0 for r in got)
    empty = ctw.split_by_key(no_docs)
    assert ctw.score(empty)[0].count() == 0
    untrained = docs.where("doc_id = 4").selectExpr("doc_id", "text", "false AS train")
    first = ctw.score(untrained)[0].first()
    assert first["score"] == pytest.approx(8 * math.log10(0.5) * first["n_bytes"])


def test_buckets(spark):
    import zlib

    got = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", bucket_of("doc_id", 7).alias("b")).collect()
    assert all(r["b"] == zlib.crc32(str(r["doc_id"]).encode()) % 7 for r in got)
