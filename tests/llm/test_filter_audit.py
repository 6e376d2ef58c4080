"""The filter audit against applying every order of the filters document by document."""

from __future__ import annotations

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASH, odd_rows
from tripflow.llm import filter_audit

_LABEL = "doc_id long, quality int, toxic int"


def _fails(text):
    text = text or ""
    words = text.encode().split()
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
    }


def _plain(docs, labels):
    """One row a part, order and step, by removing documents one filter after the other."""
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    parts = collections.defaultdict(list)
    for k, t, s in docs:
        parts[s or ""].append((k, _fails(t) | {"E": k is not None and k > least[t or ""]}))
    out = {}
    for part, rows in parts.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(range(len(rows)))
            for step, letter in enumerate(order, 1):
                lost = [i for i in left if rows[i][1][letter]]
                redundant = sum(rows[i][1][letter] for i in range(len(rows)) if i not in left)
                left = [i for i in left if not rows[i][1][letter]]
                unique = sum(f[letter] and sum(f.values()) == 1 for _, f in rows)
                shapley[letter] += len(lost)
                ids = [rows[i][0] for i in lost]
                out[part, order, step] = [len(left), len(lost), redundant, unique, sum(k in good for k in ids), sum(k in toxic for k in ids)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _found(docs, labels):
    figures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = filter_audit.audit_filters(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in figures) for r in rows}
    assert len(found) == len(rows)
    return found


def _documents(rng):
    texts = ["word " * 300, "A b c", "$", "", None, "One Two $ " * 150, " ".join(f"w{i}" for i in range(250)), "X" + "y " * 220]
    rows = [(k, rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for k in range(120)]
    return rows + [(None, "A b c", "s1"), (None, "$", "s2"), (5, rows[5][1], "s1"), rows[6], (7, "other $", "s2")]


def test_orders_and_cells(spark):
    rng = random.Random(4)
    docs = _documents(rng)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 140, 2)] + [(4, 1, 1), (None, 1, 1)]
    found = _found(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, _LABEL))
    assert found == _plain(docs, labels)
    assert len(found) == 3 * 600


def test_odd_rows(spark, odd, none):
    labels = [(1, 1, 0), (6, 1, 1), (7, 0, 1), (10, None, None)]
    frame = spark.createDataFrame(labels, _LABEL)
    want = _plain([(r[0], r[1], r[3]) for r in odd_rows()], labels)
    assert _found(odd, frame) == want
    names = [*CLASH, "part", "mask", "bits", "digest", "key", "quality", "toxic", "prefix", "cells"]
    wide = odd.select("*", F.create_map(F.lit("a"), F.lit(1)).alias("map"), *[F.lit("x").alias(c) for c in dict.fromkeys(names)])
    assert _found(wide, frame.withColumn("bits", F.lit("x"))) == want
    assert _found(none, frame) == {}
    assert all(v[4:6] == (0, 0) for v in _found(odd, frame.limit(0)).values())


def test_more_parts_than_the_row_limit_of_recursion(spark):
    """4,000 parts make 1.3 million prefixes, over the default limit on rows of a recursive query."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("source"))
    labels = spark.createDataFrame([], _LABEL)
    found = filter_audit.audit_filters(docs, labels)
    total = found.agg(F.count("*"), F.sum("removed"), F.sum("kept")).first()
    # One text: all but the first are copies; every document is short.
    assert tuple(total)[:2] == (4000 * 600, 4000 * 120)


@pytest.mark.parametrize("letters", ["AB", "E"])
def test_fewer_filters(spark, letters):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 17, 3, 0, 2)], "part string, mask int, n long, good long, toxic long")
    rows = filter_audit.audit(cells, letters).orderBy("filter_order", "step").collect()
    if letters == "E":
        assert [tuple(r) for r in rows] == [("p", "E", 1, 5, 3, 0, 0, 0, 2, 3)]
    else:
        assert [(r.filter_order, r.step, r.kept, r.removed) for r in rows] == [("AB", 1, 5, 3), ("AB", 2, 5, 0), ("BA", 1, 8, 0), ("BA", 2, 5, 3)]
