from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfold.llm import quality_classifier as Q
from emberfold.llm import toxicity as X

INSULTS = ["stupid", "idiot", "worthless", "moron"]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    syllables = ["ra", "to", "ne", "li", "mo", "sa", "ki", "ve", "do", "un"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, toxic = [], []
    for i in range(n):
        words = [word() for _ in range(rng.integers(20, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.integers(len(words)), rng.choice(INSULTS))
        texts.append(" ".join(words) + ".")
        toxic.append(bad)
    return texts, np.array(toxic)


@pytest.fixture(scope="module")
def machine():
    return X.train(*corpus(240, 1))


def slow_kernel(a, b):
    """Common subsequences of ORDER symbols within SPAN, weighted by gaps, of two rows of symbols."""

    def spread(xs):
        out = {}
        for at in combinations(range(len(xs)), X.ORDER):
            if at[-1] - at[0] < X.SPAN:
                u = tuple(xs[i] for i in at)
                out[u] = out.get(u, 0.0) + X.DECAY ** (at[-1] - at[0] + 1 - X.ORDER)
        return out

    x, y = spread(a), spread(b)
    dot = lambda p, q: sum(v * q.get(u, 0.0) for u, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0


def test_subsequences_give_the_string_kernel():
    rows, lengths, word = X.windows(["stupid", "stxupid", "banana", "bananas", "ab", "a.n-a_n!a"])
    row, code, value = X.subsequences(rows, lengths)
    dense = np.zeros((len(rows), X.ALPHABET**X.ORDER))
    dense[row, code] = value
    symbols = [rows[i][: lengths[i]].tolist() for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(len(rows)):
            assert dense[i] @ dense[j] == pytest.approx(slow_kernel(symbols[i], symbols[j]))


def test_windows_cover_whole_words():
    rows, lengths, word = X.windows(["a" * 40, "", "b"])
    assert set(word.tolist()) == {0, 1, 2}
    assert lengths[word == 0].tolist()[0] == X.WINDOW and (lengths <= X.WINDOW).all()
    covered = (np.arange((word == 0).sum()) * X.STRIDE + lengths[word == 0]).max()
    assert covered == 41


def test_insults_are_found_with_gaps_and_insertions(machine):
    found = dict(zip(words := ["stupid", "s.t.u.p.i.d", "stup1d", "STUPID!!".lower(), "stuxpid", "worthxless", "worthless,", "tonerasa", "limove"], machine.values(words)))
    clean = max(found["tonerasa"], found["limove"])
    assert all(found[w] > 0.8 for w in ("stupid", "s.t.u.p.i.d", "stup1d", "stupid!!", "worthless,"))
    assert all(found[w] > clean + 0.3 for w in ("stuxpid", "worthxless"))
    assert "stupid" in X.words_of("so s t u p i d of you")


def test_held_out_accuracy(spark, machine):
    texts, toxic = corpus(200, 2)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["__ef_toxic"] for r in X.score(df, machine).collect()}
    said = np.array([got[i]["score"] >= 0.7 for i in range(len(texts))])
    assert (said == toxic).mean() > 0.97
    assert all(got[i]["worst"].strip(".") in INSULTS for i in np.flatnonzero(toxic & said))


def test_training_without_a_class():
    assert X.train(["a b", "c d"], np.array([0, 0])) == 0.0 and X.train(["a"], np.array([1])) == 1.0 and X.train([], np.array([])) == 0.0


def test_toxicity_of_odd_documents(odd_docs, no_docs, machine):
    got = X.score(odd_docs, machine)
    rows = got.collect()
    assert len(rows) == 10 and all(0 <= r["__ef_toxic"]["score"] < 0.7 for r in rows)
    assert X.score(no_docs, machine).count() == 0
    assert X.score(odd_docs, 0.25).select(F.max("__ef_toxic.score")).first()[0] == 0.25


def labelled(spark, rows):
    """rows: key, text, toxic."""
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame(sorted({(r[0], r[2]) for r in rows}, key=str), "doc_id long, toxic int")


def test_sample_is_bounded_and_repeats(spark, monkeypatch):
    texts, toxic = corpus(80, 3)
    docs, labels = labelled(spark, [(i, t, int(x)) for i, (t, x) in enumerate(zip(texts, toxic))])
    take = lambda d: ([tuple(r) for r in d[0].orderBy("place").collect()], d[1])
    a, b = take(X.sample(docs, labels)), take(X.sample(docs.repartition(5), labels))
    assert a == b and a[1] == pytest.approx(toxic.mean()) and len(a[0]) == 80
    monkeypatch.setattr(X, "SAMPLE_CLEAN", 7)
    monkeypatch.setattr(X, "SAMPLE_BYTES", 600)
    rows, _ = take(X.sample(docs, labels))
    assert sum(r[1] == 0 for r in rows) <= 7
    for value in (0, 1):
        sizes = [len(r[2]) for r in rows if r[1] == value]
        assert sum(sizes[:-1]) < 600


def test_a_key_repeated_often_trains_once(spark):
    texts, toxic = corpus(60, 5)
    rows = [(i, t, int(x)) for i, (t, x) in enumerate(zip(texts, toxic))]
    docs, labels = labelled(spark, rows)
    many = docs.union(spark.range(100_000).selectExpr("CAST(0 AS LONG) AS doc_id", f"'{texts[0]}' AS text"))
    sampled, share = X.sample(many, labels)
    assert sampled.count() == 60 and share == pytest.approx((toxic.sum() + 100_000 * toxic[0]) / 100_060)


def test_long_toxic_texts_train(spark):
    texts, toxic = corpus(40, 6)
    rows = [(i, t * (150 if x else 1), int(x)) for i, (t, x) in enumerate(zip(texts, toxic))] + [(99, None, 1), (None, "stupid", 1)]
    docs, labels = labelled(spark, rows)
    machine = X.fit(docs, labels)
    assert not isinstance(machine, float)
    got = dict(zip(words := ["stupid", "idiot", "tonera"], machine.values(words)))
    assert min(got["stupid"], got["idiot"]) > got["tonera"] + 0.5


def test_fit_without_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 0), (1, 1)], "doc_id long, toxic int")
    assert X.fit(odd_docs, labels) == 0.0  # the toxic row has no text
    assert X.fit(no_docs, labels) == 0.0 and X.fit(odd_docs, labels.where("false")) == 0.0


def test_a_long_word_is_scored_in_pieces(machine):
    import tracemalloc

    word = "nerato" * 170_000 + "stupid" * 4
    tracemalloc.start()
    value = machine.values([word])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows, lengths, _ = X.windows([word])
    tail = [machine.values([word[-60:]])[0]]
    assert peak < 100_000_000 and value >= max(tail) - 0.3
    assert len(rows) == len(X.Windows([word]))


def slow_machine(x, y, cost):
    """The same loss by plain gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, X.PENALTY), 1e-8)
    rate = 1 / ((x * cost[:, None]).T @ x).trace()
    for _ in range(200_000):
        w -= rate * (ridge * w - x.T @ (cost * y * np.maximum(0, 1 - y * (x @ w))))
    return w


def test_the_machine_finds_the_least_loss():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(60, 3)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    x[:, 0] += y
    cost = np.where(y > 0, 0.02, 0.03)
    assert X._machine(x, y, cost) == pytest.approx(slow_machine(x, y, cost), abs=1e-3)


def test_nystroem_map_keeps_the_kernel_of_landmarks():
    """Kernel rows of landmarks, whitened by the inverse root, have the kernel as their products; so do the table's weights."""
    rows, lengths, _ = X.windows(["stupid", "idiot", "banana", "worthless"])
    symbols = [rows[i][: lengths[i]].tolist() for i in range(len(rows))]
    k = np.array([[slow_kernel(a, b) for b in symbols] for a in symbols])
    values, root = np.linalg.eigh(k)
    mapped = k @ (root / np.sqrt(values))
    assert mapped @ mapped.T == pytest.approx(k)


def test_pooling_takes_the_strongest():
    got = X.pooled([np.array([0.1, 0.9, 5.0, -3.0, 0.2, 0.3]), np.zeros(0)])
    assert got[0].tolist() == pytest.approx([X.MOST, 0.9, 0.3, 0.2, 0.1, np.log1p(6), 1.0])
    assert got[1].tolist() == pytest.approx([X.LEAST] * 5 + [0.0, 1.0])


def slow_log_odds(x, rows, labels):
    means, covs, priors = [], [], []
    labels = np.array(labels)
    for k in (0, 1):
        some = rows[labels == k]
        means.append(some.mean(axis=0))
        covs.append(np.cov(some.T, bias=True))
        priors.append((labels == k).mean())
    pooled = sum(p * c for p, c in zip(priors, covs))
    out = 0.0
    for k in (0, 1):
        c = (1 - Q.TO_POOLED) * covs[k] + Q.TO_POOLED * pooled
        c = (1 - Q.TO_IDENTITY) * c + Q.TO_IDENTITY * np.diag(np.diagonal(pooled).clip(Q.LEAST_VARIANCE)) + Q.LEAST_VARIANCE * np.eye(len(c))
        d = x - means[k]
        density = np.log(priors[k]) - 0.5 * d @ np.linalg.inv(c) @ d - 0.5 * np.linalg.slogdet(c)[1]
        out += density if k else -density
    return out


def junk(n, seed):
    rng = np.random.default_rng(seed)
    good, _ = corpus(n, seed)
    bad = [" | ".join("AB$%" + str(rng.integers(99)) for _ in range(rng.integers(5, 60))) for _ in range(n)]
    return [(i, t, 1 - i % 2) for i, t in enumerate(x for pair in zip(good, bad) for x in pair)]


def test_discriminant_matches_the_formula_and_holds_out(spark):
    df = spark.createDataFrame(junk(80, 4), "doc_id long, text string, quality int").repartition(3)
    stats = Q.with_statistics(df)
    model = Q.fit(stats)
    rows = np.array([Q.statistics(r["text"]) for r in df.collect()])
    labels = [r["quality"] for r in df.collect()]
    test = junk(20, 5)
    for _, t, _ in test[:6]:
        x = Q.statistics(t)
        assert model.log_odds(x[None])[0] == pytest.approx(slow_log_odds(x, rows, labels), rel=1e-6)
    held = Q.with_statistics(spark.createDataFrame(test, "doc_id long, text string, quality int"))
    assert all((r["__ef_score"] >= 0.3) == (r["quality"] == 1) for r in Q.score(held, model).collect())


def test_quality_without_a_class(spark, odd_docs, no_docs):
    stats = Q.with_statistics(odd_docs)
    assert all(len(r[0]) == len(Q.STATISTICS) and np.isfinite(r[0]).all() for r in stats.select("__ef_stats").collect())
    assert Q.fit(stats.selectExpr("__ef_stats", "1 AS quality")) == 1.0
    assert Q.fit(stats.selectExpr("__ef_stats", "CAST(NULL AS INT) AS quality")) == 0.5
    assert Q.score(stats, 0.5).count() == 10 and Q.with_statistics(no_docs).count() == 0


def test_decisions_are_sums_over_the_listed_subsequences():
    rng = np.random.default_rng(3)
    words = ["", "a", "abc", "abcd", "aaaaaaaa", "abababababab", "x" * 60, "f.o-o b4r", "größe", *("".join(rng.choice(list("abcé"), rng.integers(1, 40))) for _ in range(300))]
    rows, lengths, _ = X.windows(words)
    weights = rng.normal(size=X.ALPHABET**X.ORDER).astype(np.float32)
    row, code, value = X.subsequences(rows, lengths)
    listed = np.bincount(row, weights=value * weights[code], minlength=len(rows))
    assert np.allclose(X.decisions(rows, lengths, weights), listed, rtol=1e-12, atol=1e-12)
    assert not X.decisions(rows[:2], lengths[:2], weights).any() and len(X.decisions(rows[:0], lengths[:0], weights)) == 0
