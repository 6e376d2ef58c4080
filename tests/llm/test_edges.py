"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DOCUMENT, odd_rows
from tripflow.llm import catalog, chat, decontam, kneser_ney, langid, mixing, sharding, simhash, tagpath, vamana, zipwarc
from tripflow.sources.staging import settle


def test_stages_on_odd_rows(spark, odd, benchmark_rows, tmp_path):
    benchmark_rows.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == odd.columns
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r.number for r in placed) == list(range(docs.count()))


def test_stages_keep_clashing_columns(spark, odd_wide, benchmark_rows, tmp_path):
    benchmark_rows.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_wide, str(tmp_path))
        assert out.columns == odd_wide.columns
        assert all(r.fp == "extra fp" for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, odd_wide, str(tmp_path)).count() == len(odd_rows())


def test_stages_on_empty_tables(spark, none, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_queries_on_empty_tables(spark, tmp_path):
    tables = {
        "documents": DOCUMENT, "benchmark": "item_id long, text string",
        "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int",
        "conversations": "conv_id long, turn long, role string, text string", "labels": "doc_id long, quality int, toxic int",
    }
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in catalog.queries().items():
        rows = query(spark, str(tmp_path)).collect()
        assert [r.conv_id for r in rows] == ([-1] if name.startswith("op7") else []), name


def test_language_of_odd_rows(odd):
    model = langid.train(odd)
    found = odd.select("doc_id", "text", langid.predict_column(odd, model).alias("p")).collect()
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.p.lang == "und") == (not letters)
        assert 0 <= r.p.score <= 1
    lettered = sum(any(c.isalpha() for c in t or "") for _, t, *_ in odd_rows())
    assert langid.keep_identified(odd, model, least=0.0).count() == lettered
    assert langid.keep_identified(odd, model).count() == sum(r.p.score >= langid.LEAST for r in found)
    assert langid.keep_identified(odd, langid.train(odd.where("lang = 'none'"))).count() == lettered


def test_near_duplicates_of_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2].component == 1 and by_id[7].component == 6
    # No words: fingerprint zero, one class.
    assert {by_id[k].fp for k in (3, 4, 5)} == {0} and {by_id[k].component for k in (3, 4, 5)} == {3}
    assert {r.component for r in rows if r.doc_id is None and r.fp == 0} == {3}
    kept = simhash.keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 6, 8, 9, 10]
    assert sum(r.doc_id is None for r in kept) == 2


def test_scan_of_odd_rows(odd_wide, benchmark_rows):
    for found in (
        decontam.scan(odd_wide, benchmark_rows),
        decontam.scan_by_join(odd_wide, benchmark_rows),
    ):
        assert len(found.columns) == len(set(found.columns))
        by_id = {r.doc_id: r for r in found.collect() if r.doc_id is not None}
        assert by_id[1].n_hit == 3 and by_id[1]["items"] == ["1"]
        assert by_id[3].n_words == by_id[4].n_words == by_id[3].n_hit == 0
        # The item without an id marks words but is not listed.
        assert by_id[8].n_hit == 2 and by_id[8]["items"] == []
        assert by_id[6]["items"] == ["4"] and by_id[6].n_words == 180_000


def test_join_scan_agrees_with_broadcast_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    columns = ["doc_id", "n_words", "n_hit", "items"]
    one, two = (f(docs, items).select(*columns).collect() for f in (decontam.scan, decontam.scan_by_join))
    assert sorted(map(str, one)) == sorted(map(str, two))
    assert any(r.n_hit for r in one)


def test_mix_of_odd_rows(odd):
    rows = settle(mixing.sized(odd), "sized")
    mixed = mixing.mix(rows, seed_columns=("doc_id", "text_hash")).collect()
    assert len(mixed) == len(odd_rows())
    assert all(0 <= r.taken <= 3 * r["size"] for r in mixed)
    assert all(r.taken == 0 for r in mixed if r["size"] == 0)


def test_shards_of_odd_rows(odd):
    placed = sharding.shard(odd, ["doc_id", "source", "n_chars"], shards=3).collect()
    assert sorted((r.shard, r.slot) for r in placed) == sorted((i % 3, i // 3) for i in range(len(odd_rows())))


def test_keys_of_any_name(spark, odd):
    names = ["times", "number", "start", "block", "inside", "key_0", "text", "score", "n_tokens", "slot"]
    wide = odd.select("doc_id", F.col("text").alias("body"), *[F.col("doc_id").alias(c) for c in names])
    placed = sharding.shard(wide, ["times", "start", "number", "block", "key_0", "slot"], shards=3)
    assert placed.columns == ["times", "start", "block", "key_0", "number", "shard", "slot"]
    assert sorted(r.number for r in placed.collect()) == list(range(len(odd_rows())))
    assert sharding.shard(wide, ["number"]).columns == ["number", "shard", "slot"]
    model = kneser_ney.train(wide, text="body")
    scored = kneser_ney.score(wide, model, ["doc_id", "text", "score", "n_tokens"], text="body")
    assert scored.columns == ["doc_id", "text", "n_tokens", "n_known", "base_score", "score"]
    assert all(r.text == r.doc_id and r.score <= 0 for r in scored.collect())


def test_rows_with_maps(odd):
    mapped = odd.withColumn("map", F.create_map(F.lit("a"), F.col("n_chars")))
    kept = simhash.keep_one(mapped)
    assert kept.columns == mapped.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 6, 8, 9, 10]


@pytest.mark.parametrize("counts", [(10, 5, 20, 40), (0, 0, 0, 0), (5, 0, 1, 1), (1000, 400, 200, 100), (3, 3, 90, 400)])
def test_discounts_leave_mass(counts):
    found = kneser_ney.discounts(*counts)
    assert all(0 < d < k + 1 for k, d in enumerate(found))


def test_no_text_is_impossible(spark):
    """A left word that training saw only in pairs of two and more copies leaves mass for others."""
    texts = ["a b"] * 2 + ["c d"] * 2 + ["a e"] * 3 + [f"s{i} t{i}" for i in range(10)] + ["u v"] * 4 + ["w x"] * 4 + ["y z"] * 3
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = spark.createDataFrame([(1, "a d"), (2, "c b"), (3, "u s1 t1 never seen"), (4, "w")], "doc_id long, text string")
    assert all(-1000 < r.score < 0 for r in kneser_ney.score(asked, model, ["doc_id"]).collect())


def test_scores_of_odd_rows(odd):
    model = kneser_ney.train(odd)
    rows = kneser_ney.score(odd, model, ["doc_id"]).collect()
    assert len(rows) == len(odd_rows())
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (3, 4, 5))
    assert all(r.score <= 0 and r.base_score <= 0 for r in rows)
    untrained = kneser_ney.train(odd.where("doc_id < 0"))
    assert {r.score for r in kneser_ney.score(odd, untrained, ["doc_id"]).collect()} == {0.0}


def test_vectors_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]),
        (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [0.5, 0.5]), (9, [0.5, 0.5]), (20, [0.5, 0.25]),
        (40, [1.0, 2.0, 3.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    valid = vamana.valid_vectors(frame)
    assert sorted(r.vec_id for r in valid.collect()) == [1, 8, 9, 20, 40]
    found = vamana.nearest(valid, valid.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in found] == [(20, 1, 1), (20, 2, 8), (20, 3, 9)]


def test_pages_with_odd_values(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", ""), (3, "u v\r\nX: y", "<p>a</p>"), (5, "x", "<p>a</p>"),
            (4, "x", "<p>a</p>"), (3, "u", "<p>a</p>"), (6, "x", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit("clash"))
    read = zipwarc.read_packages(zipwarc.archive(pages, package_bytes=1000)).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in read)
    assert got == [
        (0, 0, "revisit", 1), (1, 0, "response", 0), (2, 0, "revisit", 1), (3, 8, "response", 0), (3, 8, "response", 0),
        (4, 8, "revisit", 3), (5, 8, "revisit", 3), (6, 600_000, "response", 0),
    ]
    texts = tagpath.extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert {(r.text, r.n_chars) for r in texts} == {("", 0), ("a", 1), ("é" * 300_000, 300_000)}


def test_chats_with_odd_values(spark):
    rows = [
        (1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (1, 1, "assistant", "<|end|>\\"),
        (1, 1, "assistant", "<|end|>\\"), (None, 0, "assistant", ""), (None, 0, "us<|body|>er", "\\[INST]"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumns({"content": chat.text_parts(F.col("text")), "conv": F.lit("clash"), "seq": F.lit(0)})
    chats = chat.format_chats(turns)
    read = {
        r.conv_id: r
        for r in chats.select(
            "conv_id", chat.read_turns(F.col("formatted")).alias("turns"),
            chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
        ).collect()
    }
    assert [tuple(t) for t in read[1].turns] == [
        ("assistant", "first"), ("user", ""), ("", "x"), ("assistant", "<|end|>\\"), ("assistant", "<|end|>\\"),
    ]
    assert read[1].learned == "first<|end|>\\<|end|>\\"
    assert [tuple(t) for t in read[None].turns] == [("assistant", ""), ("us<|body|>er", "\\[INST]")]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_have_one_row_for_each_row(spark, sf_dir, name):
    tables = {"op1": "pages", "op3": "pages"}
    rows = catalog.queries()[name](spark, sf_dir).count()
    if name.startswith("op7"):
        assert rows == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count() + 1
    elif name.startswith("op12"):
        parts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("source", F.lit(""))).distinct().count()
        assert rows == parts * 120 * 5
    elif name.partition("_")[0] not in ("op2", "op11"):
        table = tables.get(name.partition("_")[0], "documents")
        assert rows == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
