import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinstrand.llm import packing


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(packing.default_vocabulary())


def check(docs, rows, plain, window=2048):
    """Every id lies in one piece, digests are right, and sequences are gapless and short enough."""
    texts = defaultdict(list)
    for doc, text in docs:
        texts[doc].append([*plain.encode(text or "", add_special_tokens=False).ids, 1])
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        if len(texts[doc]) == 1:
            ids, end = texts[doc][0], 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == end and r["doc_tokens"] == len(ids)
                end += r["length"]
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : end], "<u4").tobytes())
            assert end == len(ids)
        else:
            assert sum(r["length"] for r in own) == sum(map(len, texts[doc]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end <= window
    return len(places), sum(r["length"] for r in rows)


def test_documents(spark, sf_dir, plain):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    n, total = check(docs, packing.pack_documents(df).collect(), plain)
    assert n <= -(-total // 2048) * 1.02 + 1


def test_edges(spark, plain):
    docs = [(1, None), (2, ""), (3, "a b " * 5000), (4, "x" * 20000), (4, "y"), (None, "no id"), (5, "<|endoftext|> \U0001f600 é\n\n  z"), (6, " " * 9000)] + [(7, "same")] * 3
    df = spark.createDataFrame([(d, t, "clash", 5) for d, t in docs], "doc_id long, text string, start string, shard int")
    check(docs, packing.pack_documents(df).collect(), plain)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_render(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).select("doc_id", "text")
    more = spark.createDataFrame([(None, "no id"), (None, "none"), (1, "another text of one id"), (77777, "a "), (77777, "a ")], df.schema)
    df = df.unionByName(more)
    packed = packing.pack_documents(df)
    rendered = {r["sequence_id"]: r for r in packing.render_sequences(df, packed).collect()}
    for r in packed.collect():
        ids = rendered[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
    for r in rendered.values():
        n = r["n_tokens"]
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else 2048)


def test_added_tokens_keep_their_ids(plain):
    assert packing.document_ids("<|endoftext|> hi", packing.default_vocabulary()).tolist() == [50256, *plain.encode(" hi", add_special_tokens=False).ids, 1]


LONG = st.builds(lambda s, n: s * n, st.text(min_size=1, max_size=3), st.integers(1, 3000))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.just("<|endoftext|>"), st.just("<|endoftext|"), LONG), max_size=4).map("".join))
def test_ids_equal_a_fresh_tokenizer(plain, text):
    assert packing.document_ids(text, packing.default_vocabulary())[:-1].tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_equals_a_plain_search(lengths):
    lengths = sorted(lengths, reverse=True)
    number, _ = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    room, want = [], []
    for n in lengths:
        fits = [k for k, r in enumerate(room) if r >= n]
        if not fits:
            room.append(64)
            fits = [len(room) - 1]
        best = min(room[k] for k in fits)
        k = number[len(want)]
        assert room[k] == best if best < 64 else True
        want.append(k)
        room[k] -= n
    assert number.tolist() == want
