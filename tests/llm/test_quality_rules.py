import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from emberfold.llm import quality_rules as Q
from emberfold.llm.common import written


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\t-\r]+", text)
    runs = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\t-\r]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def judged(df):
    measured = Q.features(df)
    return Q.judge(measured, Q.references(measured))


def bases(df):
    return [(r["text"], tuple(r[Q.BASE])) for r in df.collect()]


def test_odd_documents(odd_docs, no_docs):
    out = judged(odd_docs)
    assert set(odd_docs.columns) < set(out.columns)
    for text, got in bases(out):
        assert got[:5] == base(text), text
        assert got[5] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
    assert judged(no_docs).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab \n\t#|é"), max_size=80), min_size=1, max_size=20))
def test_counts_match_brute_force(spark, texts):
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    for text, got in bases(judged(df)):
        assert got[:5] == base(text), repr(text)


def test_divergence_matches_numpy(spark):
    rng = np.random.default_rng(3)
    for _ in range(5):
        p, q = rng.dirichlet(np.ones(6)), rng.dirichlet(np.ones(6))
        p[0], p = 0, p / p[1:].sum()
        p[0] = 0
        m = (p + q) / 2
        kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b) if x > 0)
        df = spark.createDataFrame([(p.tolist(),)], "p array<double>")
        from pyspark.sql import functions as F

        assert df.select(Q.divergence(F.col("p"), q.tolist())).first()[0] == pytest.approx((kl(p, m) + kl(q, m)) / 2)


def test_junk_goes_and_prose_stays(spark):
    rng = np.random.default_rng(4)
    words = Q.COMMON_WORDS["en"] + [f"{a}{b}" for a in ("tion", "ing", "er", "st") for b in ("ea", "ou", "an")]
    prose = lambda n: " ".join(rng.choice(words, n)) + "."
    rows = [(i, prose(80 + 5 * i), "en") for i in range(60)]
    rows += [(100 + i, " | ".join(f"Ab{rng.integers(9999)}$$$" for _ in range(90)), "en") for i in range(3)]
    rows += [(200, "short but fine", "en")]
    kept = {r["doc_id"]: r[Q.BASE]["kept"] for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(3)) and not kept[200]


def test_without_references_the_base_rule_decides(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(60)), None), ("few words", "zz")], "text string, lang string")
    got = {r["text"][:3]: r[Q.BASE]["kept"] for r in judged(df).collect()}
    assert got == {"w0 ": True, "few": False}


def test_no_python_in_the_plan(odd_docs):
    plan = judged(written(Q.features(odd_docs), "q"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_matches_sql(spark):
    from compare import compare, duck

    from emberfold.llm import queries

    folder = "/root/testdata/sf0.001"
    compare(queries.QUERIES["op2_quality_divergence"](spark, folder), duck(folder), queries.ORACLE_SQL["op2_quality_divergence"])
