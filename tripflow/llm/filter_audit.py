"""Filter interaction audit: what every filter removes in every order, by a recursive CTE.

A document's filters are judged once, each on its own, and become the bits of a mask. Documents are
counted by part and mask: at most 2^k cells a part for k filters, whatever the number of documents.
All orders are audited on the cells alone. A recursive CTE starts with the empty prefix of every part
and extends each prefix by every filter it doesn't hold yet, carrying the bits applied so far. Every
extension joins the part's cells and emits the figures of that step: a document reaches the step if
its mask has none of the applied bits. With five filters that is 325 prefixes a part, which the 120
orders share; a last join lays them out by order and step.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import WORD
from tripflow.sources.staging import setting, settle

#: The filter that a whole table decides, not a row.
DUPLICATE = "E"
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of one text, by letter. The thresholds of the audit."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _tallied(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, part, bits, digest, n): documents alike in all of these, a written table.

    Only 32 bytes stand for a text from here on, so that no text is shuffled.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        _bits(text_filters(whole)).alias("bits"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
    )
    return settle(rows.groupBy("key", "part", "bits", "digest").agg(F.count("*").alias("n")), "tallied")


def bit_of(letter: str) -> int:
    return 1 << (ord(letter) - ord("A"))


def _bits(failed: dict[str, Column]) -> Column:
    bits = F.lit(0)
    for letter, condition in failed.items():
        bits = bits + F.when(condition, bit_of(letter)).otherwise(0)
    return bits


def mask_cells(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail.

    The copy filter asks for an equal text with a smaller key. The smallest key of every text is found
    first, and a document is spared if it holds that very pair, so that no join has a key which all
    copies of a text share. Rows without a key are no copies and have no label.
    """
    tallied = _tallied(docs, key, text, part)
    known = tallied.where("key is not null")
    firsts = known.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    copied = F.when(F.col("first").isNull(), bit_of(DUPLICATE)).otherwise(0)
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(
        F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic")
    )
    marked = (
        known.join(firsts, ["digest", "key"], "left")
        .select("key", "part", "n", (F.col("bits") + copied).alias("mask"))
        .join(flags, "key", "left")
        .select("part", "mask", "n", "is_good", "is_toxic")
    )
    without = tallied.where("key is null").select(
        "part", F.col("bits").alias("mask"), "n", F.lit(None).cast("boolean").alias("is_good"),
        F.lit(None).cast("boolean").alias("is_toxic"),
    )
    return marked.unionByName(without).groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def _total(field: str, condition: str) -> str:
    """The sum of a field over the cells for which the condition on ``x`` and the step holds."""
    return f"aggregate(filter(cells, x -> {condition}), 0L, (sum, x) -> sum + x.{field})"


_REACHED = "x.mask & applied = 0"
_FAILS = "x.mask & bit <> 0"
_PREFIXES = f"""
WITH RECURSIVE prefixes AS (
  SELECT part, '' AS prefix, 0 AS applied, 0 AS step, 0L AS kept, 0L AS removed, 0L AS redundant,
         0L AS unique_fails, 0L AS good_lost, 0L AS toxic_lost
  FROM {{cells}}
  UNION ALL
  SELECT part, prefix || letter, applied | bit, step + 1,
         {_total('n', f'{_REACHED} AND x.mask & bit = 0')},
         {_total('n', f'{_REACHED} AND {_FAILS}')},
         {_total('n', f'x.mask & applied <> 0 AND {_FAILS}')},
         {_total('n', 'x.mask = bit')},
         {_total('good', f'{_REACHED} AND {_FAILS}')},
         {_total('toxic', f'{_REACHED} AND {_FAILS}')}
  FROM prefixes JOIN {{cells}} USING (part) JOIN {{unused}} USING (applied)
)
SELECT * FROM prefixes WHERE step > 0
"""
_ORDERS = """
SELECT o.part, filter_order, p.step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY o.part, right(p.prefix, 1)) AS shapley
FROM (
  SELECT part, prefix AS filter_order, explode(sequence(1, step)) AS at FROM {prefixes} WHERE step = {last}
) o JOIN {prefixes} p ON p.part = o.part AND p.prefix = left(filter_order, at)
"""


def audit(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    for every part, every order of ``letters`` and every step of it, zeros included.

    ``cells`` has (part, mask, n, good, toxic), one row a part and mask, none null. No cells: no rows.
    """
    spark = cells.sparkSession
    # The letters that a set of applied bits leaves: a table of its own, so that they join by equality.
    sets = [sum(map(bit_of, some)) for n in range(len(letters)) for some in itertools.combinations(letters, n)]
    left = [(bits, c, bit_of(c)) for bits in sets for c in letters if not bits & bit_of(c)]
    unused = spark.createDataFrame(left, "applied int, letter string, bit int")
    listed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    listed = settle(listed, "cells")
    # The limit on rows is for queries that may not end; this one has as many levels as letters.
    with setting(spark, _ROW_LIMIT, "-1"):
        prefixes = settle(spark.sql(_PREFIXES, cells=listed, unused=unused), "prefixes")
    return spark.sql(_ORDERS.replace("{last}", str(len(letters))), prefixes=prefixes)


def audit_filters(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """``audit`` of the four text filters and the copy filter over whole texts, for every part.

    A null text counts as empty, a null part as the empty string. Labels of one key count together:
    good or toxic if any of them says so. Repeated rows count as often as they occur, and are copies of
    a smaller key only, never of each other. Empty documents: no rows. Other columns are not read.
    """
    return audit(mask_cells(docs, labels, key, text, part))
