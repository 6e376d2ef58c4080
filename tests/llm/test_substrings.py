"""Substring dedup against comparing all windows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASH, odd_rows
from tripflow.llm import substrings


def _plain(rows, width):
    """(n_words, spans, kept) of every (key, text), by the first place of every window."""
    last = (1 << 63) - 1
    split = [(last if k is None else k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, words in split:
        for i in range(len(words) - width + 1):
            run = tuple(words[i : i + width])
            first[run] = min(first.get(run, (k, i)), (k, i))
    out = []
    for k, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < (k, i):
                gone[i : i + width] = [True] * width
        edges = np.flatnonzero(np.diff([0, *gone, 0]))
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        out.append((len(words), [*zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)], kept))
    return out


def _found(frame, width):
    rows = substrings.remove_repeats(frame, width=width).collect()
    return [(r.doc_id, (r.n_words, [(s.start, s.stop) for s in r.spans], r.kept)) for r in rows]


@pytest.mark.parametrize("held", [50, 4 << 20])
@pytest.mark.parametrize("pages", [40, 2 << 20])
def test_few_words_make_many_repeats(spark, monkeypatch, held, pages):
    """Texts of two words, so that windows repeat within and across texts; tiny pages and flushes."""
    monkeypatch.setattr(substrings, "HELD_WINDOWS", held)
    monkeypatch.setattr(substrings, "PAGE_WINDOWS", pages)
    monkeypatch.setattr(substrings, "SENT_MARKS", 7)
    monkeypatch.setattr(substrings, "PIECE_BYTES", 64)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = [*enumerate(texts), (3, texts[5]), (3, texts[3]), (None, texts[0]), (None, "a b " * 20), (-4, texts[9])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(k, w) for (k, _), w in zip(rows, _plain(rows, 5), strict=True)]
    assert sorted(map(repr, _found(frame, 5))) == sorted(map(repr, want))


def test_odd_rows(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = [(k, w) for (k, _), w in zip(rows, _plain(rows, 20), strict=True)]
    assert sorted(map(repr, _found(odd, 20))) == sorted(map(repr, want))
    assert substrings.remove_repeats(none).count() == 0


def test_clashing_names(odd):
    names = [*CLASH, "text_key", "starts", "page", "entries", "cut", "spans", "kept", "n_removed"]
    wide = odd.select("*", F.create_map(F.lit("a"), F.lit(1)).alias("map"), *[F.lit(f"extra {c}").alias(c) for c in names])
    found = substrings.remove_repeats(wide)
    assert len(found.columns) == len(set(found.columns)) and set(wide.columns) <= set(found.columns)
    for r in found.collect():
        assert r.key == "extra key" and r.page == "extra page" and r.map == {"a": 1} and isinstance(r.n_words, int)


def test_words_and_hashes():
    texts = pa.array(["a\x0bbc\x1cd  é f\n", None, "", "bc\x1cd"])
    data = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode(), dtype=np.uint8)
    edges = np.cumsum([0, *(len((t or "").encode()) for t in texts.to_pylist())])
    numbers, starts = substrings.word_numbers(data, edges)
    assert len(numbers) == 4 and numbers[1] == numbers[3] and len(set(numbers.tolist())) == 3
    hashes, checks, text, start = substrings.windows(pa.array(["x y z y z", "y z", "q"]), 2)
    assert checks[1] == checks[3] == checks[4] and len(set(checks.tolist())) == 3 and checks.max() < 1 << 24
    assert [*zip(text.tolist(), start.tolist(), strict=True)] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)]
    assert hashes[1] == hashes[3] == hashes[4] and len(set(hashes.tolist())) == 3
    for width in (1, 3, 7, 20):
        words = np.arange(1, 60, dtype=np.uint64)
        by_hand = [sum(int(w) * pow(substrings._BASE, width - 1 - j, 1 << 64) for j, w in enumerate(words[i : i + width])) % (1 << 64)
                   for i in range(len(words) - width + 1)]
        assert (substrings.window_hashes(words, width) == substrings._scramble(np.array(by_hand, dtype=np.uint64))).all()


def test_equal_hashes_are_checked(spark, monkeypatch):
    """With hashes of three values only the checks tell windows apart."""
    plain = substrings.window_hashes
    monkeypatch.setattr(substrings, "window_hashes", lambda n, w, b=substrings._BASE: plain(n, w, b) % np.uint64(3) if b == substrings._BASE else plain(n, w, b))
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for k in range(30)]
    want = [(k, w) for (k, _), w in zip(rows, _plain(rows, 5), strict=True)]
    keys, texts = (np.array(c) for c in ([k for k, _ in rows], [0] * len(rows)))
    sent = [*substrings._send(1, 5)(iter([pa.RecordBatch.from_pydict({"key": keys, "text_key": texts, "text": [t for _, t in rows]})]))]
    merged = substrings._merge(5)(substrings._meet(1)(pa.Table.from_batches(sent)))
    spans = {k: [*zip(a, b, strict=True)] for k, a, b in zip(*(merged.column(c).to_pylist() for c in ("key", "starts", "stops")), strict=True)}
    assert [(k, spans.get(k, [])) for k, _ in rows] == [(k, w[1]) for k, w in want]


def test_planted_passage(spark):
    """A passage of 60 words in other documents goes from all but the first; all else stays."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, " ".join(f"u{rng.randrange(10**9)}" for _ in range(80))) for k in range(30)]
    rows = [(k, t if k % 3 else f"{t[:200]} {passage}\t{t[200:]}") for k, t in rows]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        assert r.n_removed == (60 if r.doc_id % 3 == 0 and r.doc_id else 0)
        assert r.doc_id == 0 or "p0 " not in r.kept
