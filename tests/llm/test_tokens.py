import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from emberfold.llm import bpe, token_files
from emberfold.llm.common import cut, scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def agrees(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    own, theirs = bpe.word_bpe(PATH), token_files.library_encoder(PATH)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == want, repr(text)
    assert np.frombuffer(theirs.encode(text.encode()), "<u4").tolist() == want, repr(text)
    assert own.decode(np.array(want, "<u4").tobytes()).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "a", "Hello, World's best!!", "it's they're I'M 'tis x's", "<|endoftext|>", "<|ENDOFTEXT|> The", "word<|", "I\u0307 E\u0301! \u212a,", "a<|startoftext|>b <|endoftext|", "éa ́", "İstanbul ΣΑΣ ſ ß", "\x1ca\x85b c d", "日本語 テスト １２３", "😀👍🏽", "a\x00b", "x" * 3000, "word.,;word ...word", "1234567 ¼ ²", "﻿bom", "don't_stop __init__"])
def test_chosen_texts(library, text):
    agrees(library, text)


def test_long_stretches_take_time_in_proportion(library):
    import random
    import time

    rng, took = random.Random(4), []
    agrees(library, "".join(rng.choice("etaoinshrdlu") for _ in range(30_000)))
    for n in (100_000, 800_000):
        text, began = "".join(rng.choice("etaoinshrdlu") for _ in range(n)), time.perf_counter()
        bpe.word_bpe(PATH).encode(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * 3 * took[0]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    agrees(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abeinorst'.,<|>endoftx ÉéßñÀ́\t1"), max_size=50))
def test_texts_that_merge(library, text):
    agrees(library, text)


def test_every_token_that_ends_a_word(library):
    own = bpe.word_bpe(PATH)
    words = [t[: -len("</w>")] for t in library.get_vocab() if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha()]
    for w, e in zip(words[::7], library.encode_batch(words[::7], add_special_tokens=False)):
        assert np.frombuffer(own.encode(w), "<u4").tolist() == e.ids


def test_cache_stays_bounded():
    made = []
    cache = bpe.Cache(lambda k: made.append(k) or k.encode(), size=10)
    for i in range(100):
        assert cache[b"_%d" % (i % 35)] == b"_%d" % (i % 35)
    assert len(cache.new) <= 10 and len(cache.old) <= 10


def test_encoding_of_odd_documents(library, odd_docs, no_docs):
    for r in bpe.encode_and_decode(odd_docs).collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["__ef_bpe"]["ids"], "<u4").tolist() == want
    assert bpe.encode_and_decode(no_docs).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.integers(0, 100))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, dtype=np.uint32)
    assert (token_files.unpack(memoryview(token_files.pack(ids, percentile)), 0) == ids).all()


def test_files_round_trip_and_random_access():
    rng = np.random.default_rng(9)
    docs = [(k, rng.integers(0, rng.choice([5, 70_000, 2**32]), n, dtype=np.uint32)) for k, n in enumerate([0, 1, 5000, 3, 200_000, 0, 4096, 1])]
    sink = io.BytesIO()
    writer = token_files.FileWriter(sink)
    for k, ids in docs:
        writer.add(k, ids)
    writer.close()
    reader = token_files.FileReader(pa.BufferReader(sink.getvalue()))
    whole = np.concatenate([ids for _, ids in docs])
    for (k, ids), (got_k, start, got) in zip(docs, reader.documents(at_once=3), strict=True):
        assert k == got_k and (ids == got).all() and (whole[start : start + len(ids)] == ids).all()
    assert (reader.ids(1500, 9000) == whole[1500:9000]).all()
    with pytest.raises(ValueError):
        token_files.FileReader(pa.BufferReader(b"none" + bytes(24)))


def test_files_of_odd_documents(spark, library, odd_docs, no_docs):
    folder = scratch(spark, "tokens")
    files = cut(token_files.write(odd_docs, folder))
    got = sorted(token_files.read(files, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 4, 5, 7, 8, 9]
    texts, start = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}, 0
    for r in got:
        want = np.array(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert r["start"] == start and zlib.crc32(r["ids"]) == zlib.crc32(want)
        start += len(want) // 4
    assert token_files.read(cut(token_files.write(no_docs, folder)), folder).count() == 0
