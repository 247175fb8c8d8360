import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def test_eleven_queries(entry):
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{i}" for i in range(1, 11)] + ["pipeline"])


@pytest.mark.parametrize("n", range(1, 11))
def test_query_returns_every_document(spark, entry, n):
    name = next(x for x in entry.queries() if x.startswith(f"op{n}_"))
    df = entry.queries()[name](spark, FOLDER)
    want = sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in df.collect()) == want


def test_pipeline(spark, entry):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = P.quality(spark, docs, FOLDER)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    clean = P.remove_toxic(spark, kept, FOLDER)
    assert clean.columns == docs.columns and clean.count() <= kept.count()
    one = P.near_duplicates(spark, clean, FOLDER)
    assert one.count() == one.select("doc_id").distinct().count() <= clean.count()
    out = entry.queries()["pipeline"](spark, FOLDER)
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    import corpus_pipeline as P

    for place, (name, stage) in enumerate(P.STAGES):
        out, none = stage(spark, odd_docs, FOLDER), stage(spark, no_docs, FOLDER)
        if place < len(P.STAGES) - 1:
            assert out.columns == odd_docs.columns, name
        assert none.count() == 0 and len(out.collect()) <= 30, name
