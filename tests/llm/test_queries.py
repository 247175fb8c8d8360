"""The registered queries against plain Python over the whole smallest tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tokenizers
from test_mixing_and_sharding import water_fill
from test_simhash import slow_components, slow_fingerprint

from emberfold.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}


def rows_of(spark, n):
    name = next(x for x in Q.QUERIES if x.startswith(f"op{n}_"))
    return {r["doc_id"]: r for r in Q.QUERIES[name](spark, FOLDER).collect()}


def bucket(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus


def text_of(doc):
    return (doc["text"] or "").encode()


def test_op1(spark, docs):
    got, words = rows_of(spark, 1), Counter()
    tokens = {k: [*WORD.findall(text_of(d).lower()), None] for k, d in docs.items()}
    for k, t in tokens.items():
        if bucket(k, 7) != 2:
            words.update(t)
    n, v = sum(words.values()), len(words)
    for k, t in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (bucket(k, 7) == 2, len(t), sum(words[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0


def test_op3(spark, docs):
    got, sizes = rows_of(spark, 3), defaultdict(int)
    size = {k: len(WORD.findall(text_of(d))) for k, d in docs.items()}
    for k, d in docs.items():
        sizes[d["source"]] += size[k]
    want, taken = water_fill(sizes), defaultdict(int)
    for k, d in docs.items():
        r = got[k]
        assert (r["size"], r["source_size"]) == (size[k], sizes[d["source"]]) and r["target"] == pytest.approx(want[d["source"]])
        assert r["taken"] % max(1, size[k]) == 0 and 0 <= r["taken"] <= 3 * size[k]
        taken[d["source"]] += r["taken"]
    for s, total in sizes.items():
        # Whole copies, and of what is left the nearest sum below that any choice of documents reaches.
        copies = int(want[s] // total)
        budget, reach = round(want[s] - copies * total), 1
        for k, d in docs.items():
            if d["source"] == s:
                reach |= reach << size[k]
        assert taken[s] == copies * total + max(b for b in range(budget + 1) if reach >> b & 1)


def test_op4(spark, docs):
    got = rows_of(spark, 4)
    for k, d in docs.items():
        assert (got[k]["size"], got[k]["text_crc32"], got[k]["law"], got[k]["grown_shard"]) == (len(text_of(d)) + 8, zlib.crc32(text_of(d)), "bytes", None)
    shards, total = defaultdict(list), sum(len(text_of(d)) + 8 for d in docs.values())
    for r in got.values():
        shards[r["shard"]].append(r)
    assert set(shards) <= set(range(24))
    for rs in shards.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - total / 24) <= max(r["size"] for r in got.values())


@pytest.mark.parametrize("n,modulus,remainder,least", [(5, 3, 1, 0.7), (7, 5, 0, 0.3)])
def test_op5_and_op7(spark, docs, n, modulus, remainder, least):
    for k, r in rows_of(spark, n).items():
        assert k in docs and r["held_out"] == (bucket(k, modulus) == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= least)


def test_op6_and_op8(spark, docs):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    six, eight, start = rows_of(spark, 6), rows_of(spark, 8), 0
    for k in sorted(docs):
        ids = library.encode(text_of(docs[k]).decode(), add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert six[k][1:4] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest())
        assert eight[k][1:4] == (start, len(ids) + 1, zlib.crc32(packed + struct.pack("<I", 1)))
        start += len(ids) + 1


def test_op9(spark, docs):
    for k, r in rows_of(spark, 9).items():
        data = text_of(docs[k])
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] >= len(payload) and r["feature"]


def test_op10(spark, docs):
    got, prints = rows_of(spark, 10), [(k, slow_fingerprint(d["text"])) for k, d in docs.items()]
    want = slow_components(prints)
    for k, f in prints:
        assert (got[k]["fingerprint"], got[k]["component_id"]) == (f"{f:016x}", want[k])
