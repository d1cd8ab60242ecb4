import duckdb

from kinstrand.llm import chat


def test_conversations_equal_sql(spark, sf_dir):
    found = chat.rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    got = sorted(tuple(r) for r in found.withColumn("mask", chat.spans_text(chat.F.col("mask"))).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert got == sorted(con.sql(chat.ORACLE).fetchall()) and got


def test_masks_cover_own_turns(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "é <|im_end|>"), (1, 3, "ann", ""), (1, 3, "ann", ""), (1, None, None, None), (2, 0, "system", "alone"), (None, 0, "ann", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {(r["perspective"], r["part"]): r for r in chat.rotate_perspectives(df).collect()}
    assert {p for p, _ in got} == {"ann", "bob", "unknown"} and len(got) == 3
    ann = got["ann", 0]
    own = [ann["text"][s["first"] : s["last"]] for s in ann["mask"]]
    assert own == ["hi<|im_end|>", "<|im_end|>", "<|im_end|>"] and ann["n_turns"] == 6
    assert "<|im_start|>user name=bob\né < |im_end|><|im_end|>" in ann["text"] and ann["text"].startswith("<|im_start|>system\nBe kind")
    assert [got["bob", 0]["text"][s["first"] : s["last"]] for s in got["bob", 0]["mask"]] == ["é < |im_end|><|im_end|>"]
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_long_conversations_are_cut(spark):
    df = spark.range(2000).selectExpr("1L AS conv_id", "id * 1000 AS turn", "concat('p', id % 3) AS role", "cast(id AS string) AS text").unionAll(
        spark.range(700).selectExpr("2L", "0L", "'one'", "'same'")
    )
    rows = chat.rotate_perspectives(df, part_turns=64).collect()
    assert max(r["n_turns"] for r in rows) <= 64
    for p in ("p0", "p1", "p2"):
        own = sorted((r for r in rows if r["perspective"] == p), key=lambda r: r["part"])
        whole = "\n".join(r["text"] for r in own)
        assert [r["first_char"] for r in own] == [sum(len(x["text"]) + 1 for x in own[:k]) for k in range(len(own))]
        said = [whole[s["first"] : s["last"]].removesuffix(chat.END) for r in own for s in r["mask"]]
        assert said == [str(k) for k in range(2000) if k % 3 == int(p[1])]
    assert sum(r["n_turns"] for r in rows if r["conv_id"] == 2) == 700


def test_turn_numbers_far_apart_are_one_dialogue(spark):
    df = spark.createDataFrame([(1, 0, "ann", "a"), (1, 1000, "bob", "b"), (1, 2000, "ann", "c"), (1, -5, "bob", "z")], "conv_id long, turn long, role string, text string")
    got = chat.rotate_perspectives(df).collect()
    assert len(got) == 2 and all(r["n_turns"] == 4 and r["first_char"] == 0 for r in got)
    assert all(r["text"].index("z") < r["text"].index("a<|im_end") for r in got)


def test_native(spark, sf_dir):
    plan = chat.rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
