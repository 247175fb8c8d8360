import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from emberfold.llm import simhash as S


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """(member, bits) to the smallest member reachable, by comparing all pairs."""
    bits = sorted({b for _, b in prints})
    root = {b: b for b in bits}

    def find(b):
        while root[b] != b:
            b = root[b]
        return b

    for i, a in enumerate(bits):
        for b in bits[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for m, b in prints:
        least[find(b)] = min(m, least.get(find(b), m))
    return {m: least[find(b)] for m, b in prints}


@pytest.mark.parametrize("cap", [1, 2, 5, 2048])
def test_components_match_all_pairs(spark, cap):
    rng = random.Random(7)
    bits, prints = [], []
    for _ in range(30):
        b = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 12])):
            bits.append(b)
            for _ in range(rng.randrange(4)):
                b ^= 1 << rng.randrange(64)  # chains, some of them broken
    bits += [0] * 40 + [1 << k for k in range(8)]
    rng.shuffle(bits)
    signed = lambda b: b - (1 << 64) if b >> 63 else b
    prints = [(i, signed(b)) for i, b in enumerate(bits)]
    got = {r["member"]: r["first"] for r in S.label(spark.createDataFrame(prints, "member long, bits long"), cap).collect()}
    assert got == slow_components(prints)


def test_null_members_are_the_smallest_and_crowds_are_split(spark):
    rng = random.Random(11)
    prints = [(i, 5) for i in range(1, 900)] + [(None, 5), (1000, 7), (1001, 1 << 40)]
    prints += [(2000 + i, rng.getrandbits(62)) for i in range(60)]
    got = {r["member"]: r["first"] for r in S.label(spark.createDataFrame(prints, "member long, bits long").repartition(4)).collect()}
    assert got[None] is None and got[1] is None and got[1000] is None and got[1001] == 1001
    assert len(got) == len(prints) and all(got[2000 + i] == 2000 + i for i in range(60))


def test_hubs_keep_their_links(spark):
    edges = [(i, 0) for i in range(1, 2500)] + [(5000, 2499), (6001, 6000)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(1, 2500)} | {5000: 0, 6001: 6000}


def test_pivots_discard_no_linked_pair():
    rng = random.Random(8)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert max(abs((a ^ int(p)).bit_count() - (b ^ int(p)).bit_count()) for p in S.PIVOTS) <= 2


def test_odd_documents(odd_docs, no_docs):
    for r in odd_docs.select("text", S.hex_of(S.fingerprint()).alias("f")).collect():
        assert r["f"] == f"{slow_fingerprint(r['text']):016x}"
    kept = S.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    keys = [r["doc_id"] for r in kept.collect()]
    assert sorted(k for k in keys if k is not None) == [1, 4, 7, 8, 9] and keys.count(None) == 1
    assert S.deduplicate(no_docs).count() == 0


def test_pivot_distances(spark):
    got = spark.createDataFrame([(-1,), (12345,)], "bits long").select("bits", S.pivot_distances(F.col("bits")).alias("d")).collect()
    for r in got:
        assert list(r["d"]) == [((r["bits"] & (1 << 64) - 1) ^ int(p)).bit_count() for p in S.PIVOTS]
