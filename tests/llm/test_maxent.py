import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from kinstrand.llm import maxent


def split(text):
    return [*(text or "").encode().lower().split(), None]


def test_base_scores_and_gain(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
    total = sum(counts.values())
    got = {r["doc_id"]: r for r in maxent.score_held_out(df).collect()}
    assert len(got) == len(rows)
    gain = []
    for i, t in rows:
        w, r = split(t), got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), total)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        base = sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        if r["held_out"]:
            gain.append((r["score"] - r["base_score"]) / len(w))
    assert np.mean(gain) > 0.2


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 3)) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary, 40)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, counts = maxent.train(df)
    known = sorted({w for t in texts for w in t.split()})
    h, rare, first = maxent.tokens(pa.array([f"aab {w}" for w in known]))
    found = model.head.find(h)
    assert (found >= 0).all() and len(model.head.hashes) == len(known) + 1
    f = maxent.features(h, first, model.codes(found, rare))[:, 1:2]  # the context after "aab"
    every = np.concatenate([np.arange(maxent.RARE), maxent.RARE + np.arange(len(model.head.hashes))])
    total = sum(10 ** maxent.path_log10(model, f, model.code[k : k + 1])[0] for k in every.tolist())
    # nothing is left: each word of the head and each rare class, whose words and unseen ones share it, is a leaf
    assert abs(total - 1) < 1e-3 and len(set(model.code.tolist())) == len(every)
    assert (model.mass == 1).all() and counts.count() == len(known) + 1


def test_scores_equal_a_plain_calculation(spark, monkeypatch):
    """Every factor of every token, calculated one by one from the model's numbers."""
    monkeypatch.setattr(maxent, "HEAD", 40)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 30) if k < 500) for _ in range(70)] + [None, "Unseen WORDS only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, counts = maxent.train(df.where("doc_id < 60"))
    count = {r["token"]: r["n"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in maxent.score_texts(df, model, counts).collect()}
    weights = model.full().astype(np.float64)
    for i, text in enumerate(texts):
        h, rare, first = maxent.tokens(pa.array([text], pa.string()))
        found = model.head.find(h)
        code = model.codes(found, rare)
        f, want = maxent.features(h, first, code), 0.0
        for k in range(len(h)):
            for rows, node, branch in model.levels(f[:, k : k + 1], code[k : k + 1]):
                logit = [model.bias[node[0], b] + sum(weights[r[0], b] for r in rows) for b in range(16)]
                want += (logit[branch[0]] - np.log(np.exp(logit).sum())) / math.log(10)
            if found[k] < 0:
                want += math.log10((count.get(int(h[k : k + 1].view(np.int64)[0]), 0) + 1) / model.mass[rare[k]])
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-4)


def test_files_and_tasks_have_no_say(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, other = (maxent.train(x)[0] for x in (df.coalesce(1), df.repartition(7, "text")))
    assert np.array_equal(one.code, other.code) and np.array_equal(one.weights, other.weights)


def test_tree_of_additions(spark, monkeypatch):
    monkeypatch.setattr(maxent, "ADDED", 2)
    df = spark.createDataFrame([(0, m, b"", np.array([m], np.int64).tobytes()) for m in range(11)], maxent._SUMS)
    add = lambda _, values: (b"", sum(np.frombuffer(v, np.int64) for v in values).tobytes())
    got = maxent._added(df, add, 11).collect()
    assert len(got) == 1 and np.frombuffer(got[0]["value"], np.int64)[0] == 55


def test_blocks_of_long_texts(monkeypatch):
    texts = pa.array(["Some words\there and THERE", None, "", "x" * 500 + " end", "a b c " * 50])
    whole = maxent.tokens(texts)
    monkeypatch.setattr(maxent, "BLOCK", 7)
    for a, b in zip(whole, maxent.tokens(texts), strict=True):
        assert np.array_equal(a, b)
    assert whole[0][0] != whole[0][1] and len(whole[0]) == 5 + 1 + 1 + 1 + 3 + 151


def test_rare_words_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"the word{k} and word{k % 7} again") for k in range(60)], "doc_id long, text string")
    want = {r["doc_id"]: r["base_score"] for r in maxent.score_held_out(df).collect()}
    monkeypatch.setattr(maxent, "HEAD", 5)
    got = {r["doc_id"]: r["base_score"] for r in maxent.score_held_out(df).collect()}
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, "w " * 300000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    got = maxent.score_held_out(df).collect()
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert maxent.score_held_out(df.limit(0)).count() == 0
    none = maxent.score_texts(df, *maxent.train(df.limit(0))).collect()
    assert {r["n_known"] for r in none} == {0} and {r["train_tokens"] for r in none} == {0}


def test_steps_equal_plain_ones_and_cost_less():
    """The trainer against the same steps feature by feature; the plain form took as long as the trainer's own once did."""
    rng, bits = np.random.default_rng(6), 18
    words = maxent._mix(np.arange(1, 4001, dtype=np.uint64))
    counts = np.sort(rng.zipf(1.3, len(words)).clip(1, 10**6))[::-1]
    code, depth = maxent.class_tree(rng.normal(size=(maxent.RARE + len(words), 8)))
    head = maxent.Head.of(words, counts)
    bias = maxent._bias(code, depth, np.concatenate([np.ones(maxent.RARE), head.counts]))
    model = maxent.Model(head, int(counts.sum()), len(words), np.ones(maxent.RARE), code, depth, bias, np.zeros((1, 16), np.int8), np.zeros(1, np.float16), 1 << bits)
    h, first = words[rng.choice(len(words), 40_000, p=counts / counts.sum())], np.arange(0, 40_000, 200)
    rare = np.zeros(len(h), np.int64)

    def plain(weights, past):
        path = model.codes(head.find(h), rare)
        f = maxent.features(h, first, path)
        for k in range(0, len(path), maxent.BATCH):
            for rows, node, branch in model.levels(f[:, k : k + maxent.BATCH], path[k : k + maxent.BATCH]):
                own = [weights.take(r, axis=0, mode="clip") for r in rows]
                g = np.exp(model.bias[node] + sum(own))
                g /= g.sum(1, keepdims=True)
                g[np.arange(len(g)), branch] -= 1
                size = (g * g).sum(1) + np.float32(1e-4)
                for r, x in zip(rows, own, strict=True):
                    past[r] = now = past[r] + size
                    weights[r] = x - g * (np.float32(maxent.RATE) / np.sqrt(now))[:, None]

    took = [[], []]
    for _ in range(5):
        weights, past, trainer = np.zeros((1 << bits, 16), np.float32), np.zeros(1 << bits, np.float32), maxent.Trainer(model)
        for own, run in zip(took, (lambda: plain(weights, past), lambda: trainer.text(h, rare, first)), strict=True):  # noqa: B023
            began = time.process_time()
            run()
            own.append(time.process_time() - began)
    # rows that two features share may differ
    same = np.isclose(trainer.weights, weights, rtol=1e-2, atol=1e-2).all(1)
    assert past.any() and same[past > 0].mean() > 0.97
    assert min(took[1]) < 0.85 * min(took[0]), took


def test_rows_of_batches_are_those_of_levels(monkeypatch):
    rng = np.random.default_rng(8)
    code, depth = maxent.class_tree(rng.normal(size=(maxent.RARE + 1, 4)))
    model = maxent.Model(maxent.Head.of(np.zeros(0, np.uint64), np.zeros(0)), 0, 0, np.ones(maxent.RARE), code, depth, np.zeros(0), np.zeros((1, 16), np.int8), np.zeros(1, np.float16), 1 << 18)
    path = code[rng.integers(0, len(code), 50)]
    f = rng.integers(0, 1 << 32, (maxent.FEATURES, 50), dtype=np.uint32)
    whole = list(model.levels(f, path))
    assert all(0 <= r.min() and r.max() < 1 << 18 for r, _, _ in whole)
    monkeypatch.setattr(maxent, "BATCH", 7)
    monkeypatch.setattr(maxent, "AT_ONCE", 3)
    parts = list(model.batches(f, path, np.arange(50)))
    assert np.array_equal(np.concatenate([out for _, out in parts]), np.arange(50))
    for level, want in enumerate(whole):
        for got, x in zip(zip(*(steps[level] for steps, _ in parts), strict=True), want, strict=True):
            assert np.array_equal(np.concatenate(got, axis=-1), x)


def test_blocks_share_their_powers():
    """Tables of powers were made anew whenever a short block followed a long one; a word beyond them still is found whole."""
    assert maxent._powers(100)[0] is maxent._powers(maxent.BLOCK + 20)[0] is maxent._powers(90_000)[0]
    word = "q" * 700_000
    h, _, first = maxent.tokens(pa.array(["a b", f"x {word} b", "b a", word]))
    assert first.tolist() == [0, 3, 7, 10] and h[5] == h[1] == h[7] and h[0] == h[8] and h[4] == h[10]
    assert len(maxent._powers(100)[0]) == 1 << 19
