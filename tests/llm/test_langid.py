import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from kinstrand.llm import langid


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    got = langid.identify(df).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held)
    assert right > 0.97, right


def brute_bits(counts, text):
    """Code length of one text by walking from the longest context to the empty one; all contexts are kept."""
    b = b"   " + bytes(int(x) for x in langid.FOLD[np.frombuffer(text, np.uint8)])
    tables = [{} for _ in range(4)]
    for key, n in counts.items():
        for k in range(4):
            own = tables[k].setdefault(key[3 - k : 3], {})
            own[key[3]] = own.get(key[3], 0) + n
    total = 0.0
    for i in range(3, len(b)):
        chain = [tables[k].get(b[i - k : i], {}) for k in (3, 2, 1, 0)]

        # an escape's share is dealt over the bytes that its context lacks
        def share(level, byte):
            if level == 4:
                return 1 / langid.FOLDED
            own = chain[level]
            if not own:
                return share(level + 1, byte)
            n, d = sum(own.values()), len(own)
            if byte in own:
                return own[byte] / (n + d)
            left = 1 - sum(share(level + 1, x) for x in own)
            return d / (n + d) * share(level + 1, byte) / left

        total -= np.log2(share(0, b[i]))
    return total


def test_code_lengths_are_exact():
    train = {"aa": b"abracadabra abra", "bb": b"banana bandana 12"}
    rows, every = [], {}
    for lang, text in train.items():
        padded = b"   " + bytes(int(x) for x in langid.FOLD[np.frombuffer(text, np.uint8)])
        own = every[lang] = {}
        for i in range(3, len(padded)):
            key = padded[i - 3 : i + 1]
            own[key] = own.get(key, 0) + 2
        rows += [(lang, int.from_bytes(k, "big"), n) for k, n in own.items()]
    trees = langid.ContextTrees(pd.DataFrame(rows, columns=["lang", "key", "n"]))
    texts = [b"abra", b"banana 7", b"zq\xff", b"Abracadabra bandana"]
    bits, size = trees.code_lengths(pa.array(texts))
    assert size.tolist() == [len(t) for t in texts]
    for k, text in enumerate(texts):
        for x, lang in enumerate(trees.langs):
            assert abs(bits[k, x] - brute_bits(every[lang], text)) < 1e-3


def test_blocks_of_long_texts(monkeypatch):
    counts = pd.DataFrame([("aa", int.from_bytes(k, "big"), 3) for k in (b"  ab", b" aba", b"abab", b"baba", b"aba ")], columns=["lang", "key", "n"])
    trees = langid.ContextTrees(counts)
    texts = pa.array(["ab" * 40, None, "", "x", "aba " * 9, "ab"])
    whole = trees.code_lengths(texts)
    for block in (1, 2, 3, 5, 16, 83):
        monkeypatch.setattr(langid, "BLOCK", block)
        for x, y in zip(whole, trees.code_lengths(texts), strict=True):
            assert np.allclose(x, y)


def test_edges(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !!", "en"), (5, "", None), (6, "the hat", None), (None, "the cat", "en"), (1, "the cat sat on the mat", "en"), (7, "你好", None), (8, "the cat " * 40000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    trees = langid.learn(df)
    assert trees.langs == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, trees).collect()}
    assert got[1] == got[6] == got[8] == "en" and got[2] == "de"
    assert got[3] == got[4] == got[5] == "und" and got[7] in ("de", "en")
    assert langid.predict(df.limit(0), trees).count() == 0
    nothing = langid.learn(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}
    df = df.withColumns({"lettered": df["lang"], "lettered~": df["lang"]})
    kept = langid.accepted(df)
    assert kept.columns == df.columns and {3, 4, 5}.isdisjoint({r["doc_id"] for r in kept.collect()})
