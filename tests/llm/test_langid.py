"""Language identification against a plain naive Bayes over the same buckets."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DOCUMENT
from tripflow.llm import langid
from tripflow.llm.common import id_remainder


def _grams(text, bits):
    """Buckets of all n-grams, one by one."""
    out, letters = [], "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    codes = [ord(c) for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
    for size in langid.SIZES:
        for i in range(len(codes) - size + 1):
            value = 0
            for c in codes[i : i + size]:
                value = (value * 0x100000001B3 + c) % 2**64
            out.append(((value + size) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits))
    return out if any(c.isalpha() for c in text or "") else []


def _plain(training, texts, bits):
    """(language, posterior) of every text by the definition."""
    counts, documents = {}, collections.Counter()
    for text, lang in training:
        if lang is not None:
            documents[lang] += 1
            codes = _grams(text, bits) or _grams_of_nothing(text, bits)
            counts.setdefault(lang, collections.Counter()).update(codes)
    out = []
    for text in texts:
        grams = _grams(text, bits)
        if not grams or not counts:
            out.append(("und", 0.0))
            continue
        score = {}
        for lang, seen in counts.items():
            total = sum(seen.values()) + langid.ALPHA * 2**bits
            score[lang] = math.log(documents[lang] / documents.total()) + sum(math.log((seen[g] + langid.ALPHA) / total) for g in grams)
        top = max(score.values())
        out.append((min(k for k, v in score.items() if v == top), 1 / sum(math.exp(v - top) for v in score.values())))
    return out


def _grams_of_nothing(text, bits):
    """A text without letters is one space to the training."""
    return [*np.concatenate([*langid.buckets(langid.normal(text), bits)]).tolist()]


@pytest.mark.parametrize("piece", [50, 1 << 20])
def test_against_plain_bayes(spark, sf_dir, monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "GATHERED", 40 if piece == 50 else 1 << 20)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500 or text is null").select("doc_id", "text", "lang")
    rows = docs.withColumn("held", id_remainder(F.col("doc_id"), 3) == 1).collect()
    extra = ["", None, "12 ?", "Ünïcode wörds", "a", "\U0001f600"]
    training = [(r.text, r.lang) for r in rows if not r.held] + [("only digits 1", "xx"), ("77", "yy"), ("never", None)]
    texts = [r.text for r in rows] + extra
    model = langid.train(spark.createDataFrame(training, "text string, lang string"), bits=12)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    found = frame.select("i", langid.predict_column(frame, model).alias("p")).orderBy("i").collect()
    want = _plain(training, texts, 12)
    for r, (lang, score) in zip(found, want, strict=True):
        assert r.p.lang == lang or abs(score - 0.5) < 1e-3
        assert math.isclose(r.p.score, score, rel_tol=1e-3, abs_tol=1e-6)
    assert len({lang for lang, _ in want}) >= 4


def test_many_languages_keep_their_buckets(spark):
    """Predictions for two languages don't depend on how many others there are."""
    two = [("the cat and the dog", "en"), ("der Hund und die Katze", "de")]
    many = two + [("zq" * 3 + chr(0x4E00 + i), f"x{i:04}") for i in range(1500)]
    few, all_ = (langid.train(spark.createDataFrame(rows, "text string, lang string")) for rows in (two, many))
    assert few.bits == all_.bits == langid.BITS and len(all_.langs) == 1502
    assert all_.predict(["the dog", "und die Katze"])[0] == ["en", "de"]


def test_stage_decides(spark):
    """Texts that no language is likely for go, and so do texts without letters."""
    rows = [(i, "the cat sat on the mat with the dog" if i % 2 else "der Hund und die Katze sind hier", ("en", "de")[1 - i % 2], "s", 1) for i in range(60)]
    odd = [(100, "12345 !!", None, "s", 1), (101, None, None, "s", 1), (102, "", None, "s", 1), (103, "cat mat dog", None, "s", 1)]
    frame = spark.createDataFrame(rows + odd, DOCUMENT)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, frame, "").collect()}
    assert kept == {*range(60), 103}
    # Three languages trained alike: a text is as likely in each, and none has half of the probability.
    alike = [(i, "same words here", f"l{i % 3}", "s", 1) for i in range(30)]
    model = langid.train(spark.createDataFrame(alike, DOCUMENT))
    text = spark.createDataFrame([(1, "same words")], "doc_id long, text string")
    assert langid.keep_identified(text, model).count() == 0 and langid.keep_identified(text, model, least=0.3).count() == 1
    assert langid.keep_identified(text, model, langs=["l9"], least=0.0).count() == 0


def test_letters_stay_where_nothing_was_learned(spark):
    rows = [(1, "some words", None, "s", 1), (2, "12 34", None, "s", 1), (3, None, None, "s", 1), (4, "é", None, "s", 1)]
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, DOCUMENT), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]
