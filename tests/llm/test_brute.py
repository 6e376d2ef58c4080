"""The corpus operators against plain versions of themselves."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import compare, connect
from tripflow.llm import catalog, chat, decontam, kneser_ney, langid, mixing, oracles, sharding, simhash, tagpath, vamana, zipwarc
from tripflow.llm.common import id_remainder
from tripflow.llm.components import components


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, sf_dir, name):
    assert compare(catalog.queries()[name](spark, sf_dir), connect(sf_dir), oracles.ORACLES[name]) is None


def _roots(nodes, edges):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(-5, 7), (9, 9)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == _roots(nodes, [e for e in edges if e[0] != e[1]])
    assert len(found) == len(nodes)


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for r in docs.select("text", simhash.fingerprint_column().alias("fp")).collect():
        assert r.fp % (1 << 64) == _fingerprint(r.text)
    assert simhash.shingles("A b\tC\x0bd") == [b"a b c", b"b c d"] and simhash.shingles("x Y") == [b"x y"]


def test_fingerprint_links_with_large_table_entries(spark):
    """Clouds around a few centres, so that many share a segment, and strangers."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(250):
            bits = rng.sample(range(64) if rng.random() < 0.3 else range(8), rng.randrange(0, 4))
            fps.add(centre ^ sum(1 << b for b in bits))
        fps |= {(centre & 0xFFFFFFFF) | rng.getrandbits(32) << 32 for _ in range(40)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    values = np.array(signed, dtype=np.int64).view(np.uint64)
    pairs = [
        (signed[i], signed[j]) for i in range(len(signed))
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2).tolist() if j > i
    ]
    edges = simhash.near_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all((r.a ^ r.b).bit_count() <= 2 or bin((r.a ^ r.b) % (1 << 64)).count("1") <= 2 for r in edges)
    assert _roots(signed, [(r.a, r.b) for r in edges]) == _roots(signed, pairs)
    assert max(collections.Counter(x & 0xFFFFFFFF for x in signed).values()) > simhash.HOT


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    places = sharding.permute(np.arange(n), n)
    assert sorted(places.tolist()) == list(range(n))
    assert (sharding.unpermute(places, n) == np.arange(n)).all()
    shard, slot = sharding.locate(np.arange(n), n, 3)
    assert (sharding.row_at(shard, slot, n, 3) == np.arange(n)).all()


def test_shards_do_not_depend_on_the_layout(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    one = sharding.shard(rows, ["doc_id", "n_chars"]).collect()
    two = sharding.shard(rows.repartition(5, F.rand()), ["doc_id", "n_chars"]).collect()
    assert sorted(one) == sorted(two)


def test_a_row_repeated_very_often_gets_every_number_once(spark):
    often, once = 2 * sharding.COPIES + 5, 7
    rows = spark.range(often).select(F.lit(None).cast("long").alias("doc_id")).unionByName(spark.range(once).toDF("doc_id"))
    found = sharding.shard(rows, ["doc_id"]).collect()
    assert sorted(r.number for r in found) == list(range(often + once))
    assert sum(r.doc_id is None for r in found) == often
    assert sorted((r.shard, r.slot) for r in found) == sorted((i % 8, i // 8) for i in range(often + once))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), max_size=6), st.integers(0, 120))
def test_knapsack(items, rest):
    lengths, free = np.array([i[0] for i in items], dtype=np.int64), np.array([i[1] for i in items], dtype=np.int64)
    sums = {0}
    for length, count in items:
        sums = {s + k * length for s in sums for k in range(count + 1)}
    take = mixing.fit_rest(lengths, free, rest)
    assert (take <= free).all() and (take >= 0).all()
    most = rest + min((i[0] for i in items), default=0)
    assert int((take * lengths).sum()) == min((abs(s - rest), s) for s in sums if s <= most)[1]


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        share = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * share for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over


@pytest.mark.parametrize(
    "sizes", [{"a": 1, "b": 500, "c": 3, "d": 90, None: 7}, {"a": 5, "b": 5}, {"x": 0, "y": 10}, {"x": 0}, {"a": 1, "b": 2, "c": 9, "d": 900}]
)
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert found == pytest.approx(_targets(sizes))


def test_mix_meets_targets(spark, sf_dir):
    rows = catalog.op8_mixing(spark, sf_dir).collect()
    assert sorted(rows) == sorted(catalog.op8_mixing(spark, sf_dir).collect())
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        source = docs[r.doc_id].source
        assert r["size"] == len((docs[r.doc_id].text or "").encode().split())
        assert r.taken in {k * r["size"] for k in range(4)}
        sizes[source] += r["size"]
        taken[source] += r.taken
        target[source] = r.target
    assert target == pytest.approx(_targets(sizes))
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in target)


def test_large_length_classes_are_cut_by_bucket(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(7).cast("long").alias("size"))
    other = spark.range(6000, 6010).select(F.col("id").alias("doc_id"), F.lit("t").alias("source"), F.lit(7000).cast("long").alias("size"))
    taken = mixing.mix(rows.unionByName(other)).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"))
    assert all(abs(r.n - r.t) < 7000 for r in taken.collect())
    assert {r.source: r.n for r in taken.collect()}["s"] == pytest.approx(80_000, abs=7)


def test_language_on_held_out_documents(spark, sf_dir):
    found = {r.doc_id: r for r in catalog.op4_language_id(spark, sf_dir).collect()}
    right = [
        found[r.doc_id].lang_pred == r.lang
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
        if r.lang and found[r.doc_id].held_out
    ]
    assert all(v.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, v in found.items())
    assert sum(right) / len(right) > 0.95


def test_hashed_features_are_whole_for_long_texts(monkeypatch):
    codes = langid.normal("ab cd " * 50)
    whole = np.sort(np.concatenate([*langid.buckets(codes, 12)]))
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (np.sort(np.concatenate([*langid.buckets(codes, 12)])) == whole).all()


def _counts(texts):
    single, pairs = collections.Counter(), collections.Counter()
    for text in texts:
        words = [*(text or "").encode().lower().split(), None]
        single.update(words)
        pairs.update(zip([0, *words[:-1]], words, strict=True))
    return single, pairs


def test_kneser_ney(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(kneser_ney, "PIECE_BYTES", 500)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Small buckets: many files, and words that are spread over buckets.
    model = kneser_ney.train(docs.where("doc_id % 5 <> 0"), bucket_tokens=2000)
    assert model.buckets > 5 and len(model.heavy) > 1
    rows = docs.collect()
    single, pairs = _counts(r.text for r in rows if r.doc_id % 5)
    follows = collections.Counter(b for _, b in pairs)
    assert model.tokens == sum(single.values()) and model.words == len(single)

    def cut(counts):
        n = collections.Counter(counts.values())
        return (0.0, *kneser_ney.discounts(n[1], n[2], n[3], n[4]))

    d2, d1 = cut(pairs), cut(follows)
    total = sum(follows.values())
    rest1 = sum(d1[min(c, 3)] for c in follows.values()) / total
    context, spared = collections.Counter(), collections.Counter()
    for (a, _), c in pairs.items():
        context[a] += c
        spared[a] += d2[min(c, 3)]

    def word(w):
        return max(follows[w] - d1[min(follows[w], 3)], 0) / total + rest1 / (len(single) + 1)

    def bigram(a, w):
        if not context[a]:
            return word(w)
        c = pairs[a, w]
        return max(c - d2[min(c, 3)], 0) / context[a] + spared[a] / context[a] * word(w)

    some = next(a for a, _ in pairs if a)
    assert sum(bigram(some, w) for w in single) + bigram(some, b"\x00") == pytest.approx(1)
    found = {r.doc_id: r for r in kneser_ney.score(docs, model, ["doc_id"]).collect()}
    for r in rows[:80]:
        words = [*(r.text or "").encode().lower().split(), None]
        own = sum(math.log10(bigram(a, w)) for a, w in zip([0, *words[:-1]], words, strict=True))
        base = sum(math.log10((single[w] + 1) / (model.tokens + model.words + 1)) for w in words)
        got = found[r.doc_id]
        assert (got.n_tokens, got.n_known) == (len(words), sum(single[w] > 0 for w in words))
        assert (got.score, got.base_score) == pytest.approx((own, base))


def test_recall(spark, sf_dir):
    found = collections.defaultdict(set)
    for r in catalog.op2_robust_pruned_graph(spark, sf_dir).collect():
        found[r.query_id].add(r.vec_id)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows])
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        score = vectors @ vectors[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(found[q] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(found)


def test_graph_keeps_degree_and_reaches_all():
    points = np.random.default_rng(1).normal(size=(600, 8)).astype(np.float32)
    edges, start = vamana.build_graph(points, degree=12, beam=30)
    assert edges.shape == (600, 12) and (edges < 600).all()
    seen, todo = {start}, [start]
    while todo:
        near = [x for x in edges[todo.pop()].tolist() if x >= 0 and x not in seen]
        seen.update(near)
        todo.extend(near)
    assert len(seen) > 590
    assert set(edges[edges >= 0].tolist()) | {start} == set(range(600))


@pytest.mark.parametrize("zip64", [False, True])
def test_packages(zip64):
    records = [({"page": i}, zipwarc.warc_record(b"x" * i + b"\r\n\r\n", "u", "response", {"X-Page-ID": i})) for i in range(5)]
    read = [*zipwarc.read_package(zipwarc._Source(pa.BufferReader(zipwarc.package(records, zip64))))]
    assert [body for *_, body in read] == [b"x" * i + b"\r\n\r\n" for i in range(5)]
    with pytest.raises(ValueError, match="no end record"):
        zipwarc.ZipDirectory(zipwarc._Source(pa.BufferReader(b"PK" * 50)))


def test_archives_hold_every_payload(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in catalog.op3_zip_warc(spark, sf_dir).collect():
        digest = hashlib.sha1(pages[r.page_id]).digest()
        assert r.payload_bytes == len(pages[r.page_id])
        assert zipwarc.base64.b32encode(digest).decode() == r.payload_digest
        first = min(k for k, v in pages.items() if v == pages[r.page_id])
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("just text", "just text"), ("<p>a &lt; b<p>c\n d", "a < b\n\nc d"), ('<a href="', ""),
        ("<body><nav><a>Home</a></nav><main><h2>Top</h2><p>Long, plain text.<br>More of it, here.</p>"
         "<div class='cookie-notice'>We use cookies.</div><section id='comments'><p>First, great!</p></section>"
         "<ul><li>one<li>two</ul></main><aside>x</aside><footer>end</footer></body>",
         "Top\n\nLong, plain text. More of it, here.\n\none\n\ntwo"),
        ("<article><h1>T</h1><script>if (a < b) { x('</p>') }</script><p>Body &amp; soul &copy</p><!-- no --></article>",
         "T\n\nBody & soul ©"),
        ("<body><div class='menu'><a>Home</a></div><article><h1>Head</h1><div class='body'><p>Long, plain text, first.</p>"
         "<p>Long, plain text, second.</p></div><div><p>Short end.</p></div></article><div class='ad'>Buy, now.</div></body>",
         "Head\n\nLong, plain text, first.\n\nLong, plain text, second.\n\nShort end."),
        ("<body><div><h1>Head</h1><div><p>Long, plain text, first.</p><p>Long, plain text, second.</p></div></div>"
         "<div class='footer'>End, of page.</div></body>",
         "Head\n\nLong, plain text, first.\n\nLong, plain text, second."),
        ("<div>" * 3000 + "deep, deep text." + "</div>" * 3000, "deep, deep text."),
    ],
)
def test_main_text(html, text):
    assert tagpath.main_text(html) == text


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="\\<|[/INST]s>a\n", max_size=14), min_size=40, max_size=40))
def test_escapes_are_undone(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string")
    said = frame.withColumns({"turn": F.lit(0), "role": F.lit("assistant"), "content": chat.text_parts(F.col("text"))})
    out = chat.format_chats(said).join(frame, "conv_id").select(
        "text", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")
    )
    for r in out.collect():
        assert [tuple(t) for t in r.t] == [("assistant", r.text)] and r.l == r.text
        inner = r.formatted[len("<|turn|>assistant<|body|>") : -len("<|end|>")]
        assert not any(c in inner for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_typed_parts(spark):
    part = f"array<{chat.PART}>"
    rows = [
        (1, 0, "user", [("image", None, "i1", 57, 28, None, None), ("text", "what <|x|>?", None, None, None, None, None), None]),
        (1, 1, "assistant", [(None, "this", None, None, None, None, None)]),
        (1, 2, "user", [("audio", None, "a1", None, None, 2.0, None), ("document", None, "d1", None, None, None, 2)]),
        (2, 0, "user", None),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {part}")
    one, two = chat.format_chats(frame).orderBy("conv_id").collect()
    assert one.formatted == (
        "<|turn|>user<|body|><|image_1|>what <\\|x|>?<|end|><|turn|>assistant<|body|>this<|end|>"
        "<|turn|>user<|body|><|audio_2|><|document_3|><|end|>"
    )
    assert [tuple(a) for a in one.attachments] == [(1, 0, "image", "i1", 3), (2, 2, "audio", "a1", 25), (3, 2, "document", "d1", 1500)]
    assert one.expanded_tokens == 1528 and [one.formatted[s.start : s.start + s.length] for s in one.loss] == ["this"]
    assert two.formatted == "<|turn|>user<|body|><|end|>" and two.attachments == []


def test_chat_plan_has_no_python(spark, sf_dir, plan):
    assert not any(word in plan(catalog.op7_chat_formatting(spark, sf_dir)) for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("broadcast_bytes", [decontam.MAX_BROADCAST_BYTES, 0])
def test_spans_are_cut(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(decontam, "MAX_BROADCAST_BYTES", broadcast_bytes)
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Start, {item.upper()}! and the rest."), (2, "nothing here"), (3, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontam.cut_spans(frame, bench).collect()}
    assert cut == {1: "Start, ! and the rest.", 2: "nothing here", 3: None}


def test_near_duplicates_of_all_documents(spark, sf_dir):
    """Fingerprints and components of the whole table against all pairs of plain fingerprints."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: _fingerprint(r.text) for r in docs}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.op9_simhash_near_dedup(spark, sf_dir).collect()}
    roots = _roots(prints, pairs)
    assert found == {k: (f"{prints[k]:016x}", roots[k]) for k in prints}


def kept_by_jaccard(texts):
    """The keys that stay of texts by key, by the sets of five words of all pairs."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    edges = []
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or (x | y and Fraction(len(x & y), len(x | y)) >= Fraction(4, 5)):
            edges.append((a, b))
    return sorted(set(_roots(sets, edges).values()))


def test_pipeline(spark, sf_dir):
    """Every stage against a plain version, on what the stage before kept."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = [r for r in table.collect()]
    named = {r.doc_id: r for r in docs}
    kept = {r.doc_id for r in stages["language_id"](spark, table, sf_dir).collect()}
    model = langid.train(table.where(id_remainder(F.col("doc_id"), 3) != 1))
    names, scores = model.predict([r.text for r in docs])
    assert kept == {r.doc_id for r, n, s in zip(docs, names, scores, strict=True) if n != "und" and s >= 0.5}
    assert len(kept) > 0.95 * sum(any(c.isalpha() for c in r.text or "") for r in docs)

    single = stages["near_duplicates"](spark, table, sf_dir)
    assert sorted(r.doc_id for r in single.collect()) == kept_by_jaccard({k: r.text for k, r in named.items()})

    items = [decontam.words_of(r.text or "") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {b" ".join(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    clean = {r.doc_id for r in stages["decontamination"](spark, table, sf_dir).collect()}
    for k, r in named.items():
        text = b" " + b" ".join(decontam.words_of(r.text or "")) + b" "
        assert (k in clean) == (not any(b" " + w + b" " in text for w in windows))

    mixed = collections.Counter(r.doc_id for r in stages["mixing"](spark, table, sf_dir).collect())
    sizes = {k: len((r.text or "").encode().split()) for k, r in named.items()}
    by_source, got = collections.Counter(), collections.Counter()
    for k, r in named.items():
        by_source[r.source] += sizes[k]
        got[r.source] += sizes[k] * mixed[k]
        assert mixed[k] <= 3
    assert all(abs(got[s] - t) <= 0.01 * t + 1 for s, t in _targets(by_source).items())

    done = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.number for r in done.collect()) == list(range(done.count()))
    assert sorted(done.collect()) == sorted(corpus_pipeline.run(spark, sf_dir).collect())
