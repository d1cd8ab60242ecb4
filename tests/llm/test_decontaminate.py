import re

import numpy as np
import pyarrow as pa

from kinstrand.llm import decontaminate as d


def test_canonical_words():
    raw, at = d._with_blank(pa.array(['The "Train" runs 60 km, to Paris.', "ÉCOLE école", None, "Rome wins. Rome"]))
    canonical, literal, slot, name, opener, first = d.words(raw, at, block=16)
    assert first.tolist() == [0, 7, 9, 9, 12]
    assert [i for i, x in enumerate(slot) if x] == [1, 3, 4, 6]  # Train, 60, km, Paris
    assert [i for i, x in enumerate(name) if x] == [1, 6]
    assert canonical[3] == d.NUMBER and canonical[4] == d.UNIT and canonical[6] == d.NAME == canonical[1]
    assert canonical[7] == canonical[8] and literal[9] == literal[11]
    whole = d.words(raw, at)
    assert [i for i, x in enumerate(opener) if x] == [0, 9, 11]
    for x, y in zip((canonical, literal, slot, name, opener, first), whole, strict=True):
        assert np.array_equal(x, y)


def test_documents_against_search(spark):
    path = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: re.sub(r"\W+", "", t.lower())
    items = [(r["item_id"], plain(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, x in items if x in plain(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in d.contamination(docs, bench).collect()}
    assert got == want and want


ITEM = "A train leaves Boston at 60 km per hour and reaches Denver after 12 hours of travel without any stop on the way."


def test_slots(spark):
    docs = spark.createDataFrame(
        [
            (1, "x y z. " + ITEM + " The end"),
            (2, "Now: " + ITEM.replace("Boston", "Lisbon").replace("60", "75").replace("12", "9") + " ok"),
            (3, "something else entirely without the words of any question that we know"),
            (4, ITEM.lower()),
            (5, ITEM.title()),
        ],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(7, ITEM), (8, "Say 5 and 5 then 5 or 5 yes 5 but 5 never 5 ever 5 more 5 so")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in d.contamination(docs, bench).collect()}
    assert got[1, 7] is False and got[2, 7] is True and (3, 7) not in got and (4, 7) in got and (5, 7) in got
    # one value of the item that becomes two in the document is no re-parameterisation
    item = "please add the number 5 to the number 5 and then write the result down here"
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("5", "8")), (2, item.replace("5", "8", 1).replace("5", "4"))], "doc_id long, text string")
    assert {r["doc_id"] for r in d.contamination(docs, bench).collect()} == {1}


def test_verbatim_whatever_the_words(spark):
    """Windows of placeholders match as they are, and names need not look like names on both sides."""
    items = {
        1: "Add 3 km and 5 km and 7 km and 9 km and 11 km",
        2: "What is 12 + 7 * 3?",
        3: "What is the capital of France?",
        4: "Sum 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16",
        5: "Did Anna Bob Cleo and Dora meet Emil Fritz Gerd and Hugo",
    }
    texts = {k: f"we ask you 5) {t} and so on" for k, t in items.items()}
    texts |= {10 + k: t.lower() for k, t in items.items()} | {20 + k: f"First. {t} Then" for k, t in items.items()}
    texts |= {99: "Add 4 km and 6 km and 2 km and 8 km and 10 km", 98: "What is 5 + 6 * 2? Sum 9 8 7 6 5 4 3 2 1"}
    docs, bench = (spark.createDataFrame(list(x.items()), f"{c} long, text string") for x, c in ((texts, "doc_id"), (items, "item_id")))
    rows = d.contamination(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(k + n, k) for k in items for n in (0, 10, 20)}
    assert all(r["n_found"] == r["n_windows"] and not r["reparameterised"] for r in rows)


def test_other_values_of_an_item_rich_in_numbers(spark):
    item = "Take 3 apples 4 pears 5 plums and tell how many fruits she has then: 1 2 3 4 5 6 7 8 9"
    other = item.replace("3", "30").replace("4", "40").replace("5", "50")
    docs = spark.createDataFrame([(1, other), (2, "well and tell how many fruits she has then")], "doc_id long, text string")
    got = d.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["reparameterised"]) for r in got] == [(1, True)]


def test_a_name_that_opens_a_sentence(spark):
    bench = spark.createDataFrame([(1, "Natalia walked home. How far is it?"), (2, "What is 12 + 7 * 31 - 5?"), (3, "Compute 17 * 23 + 4 * 9")], "item_id long, text string")
    docs = {1: "Maria walked home. How far is it?", 2: "so Natalia walked home. How far is it?", 3: "Maria Natalia walked. Home is far", 4: "x What is 12 + 7 * 31 - 5?", 5: "Please compute 17 * 23 + 4 * 9 now"}
    rows = d.contamination(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["reparameterised"]) for r in rows) == [(1, 1, True), (2, 1, False), (4, 2, False), (5, 3, False)]


def test_one_altered_value_costs_its_windows_only(spark):
    words = [f"w{'abcdefghij'[k // 20]}{'abcdefghijklmnopqrst'[k % 20]}" for k in range(200)]
    words[20] = words[150] = "1234"
    words[60] = words[90] = "Boston"
    item = " ".join(words)
    near = item.replace("1234", "77", 1)
    moved = item.replace("1234", "77").replace("Boston", "Lisbon", 1)
    docs = spark.createDataFrame([(1, item), (2, near), (3, moved)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in d.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert (got[1]["n_windows"], got[1]["n_found"], got[1]["reparameterised"]) == (193, 193, False)
    assert (got[2]["n_found"], got[2]["reparameterised"]) == (185, False)
    assert (got[3]["n_found"], got[3]["reparameterised"]) == (185, True)


def test_consistent_against_hand():
    # the value 5 became 8 in two windows and 9 in one; the window without values agrees word by word
    assert d.consistent([(0, [5], [8]), (1, [5, 6], [8, 6]), (2, [5], [9]), (3, [], [])]) == ([0, 1, 3], True)
    assert d.consistent([(0, [5], [5]), (4, [5], [8])]) == ([0], False)
    assert d.consistent([(2, [], [])]) == ([2], False)


def test_edges(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, ITEM), (4, "two words"), (5, "only four words here"), (1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "so only four words here then"), (None, ITEM), (4, "w " * 200000 + ITEM + " v" * 100000), (4, "other"), (5, ITEM), (5, ITEM), (6, "Just 'Two words'.")], "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS slots")
    got = sorted((r["doc_id"], r["item_id"]) for r in d.contamination(docs, bench).collect())
    assert got == [(3, 5), (4, 1), (5, 1), (6, 4)]
    assert d.contamination(docs.limit(0), bench).count() == 0 and d.contamination(docs, bench.limit(0)).count() == 0
    d_rows, d.BROADCAST_ROWS = d.BROADCAST_ROWS, 0
    try:
        assert sorted((r["doc_id"], r["item_id"]) for r in d.contamination(docs, bench).collect()) == got
    finally:
        d.BROADCAST_ROWS = d_rows
