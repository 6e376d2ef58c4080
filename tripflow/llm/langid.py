"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are summed per task in dense arrays and then over tasks by Spark, from all
training rows. The model is one matrix of log probabilities, buckets by languages, sent to the
workers once; it has 256 KB a language and never depends on the number of documents. Labels are
names of languages, so there are thousands at most. Scoring takes many texts at a time: the buckets
of all of them gather rows of the matrix, which are summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tripflow.llm.common import restore

BITS = 16
SIZES = (1, 2, 3)
ALPHA = 0.5
#: Code points worked on at once.
PIECE = 1 << 20
#: Numbers of the matrix gathered at once.
GATHERED = 1 << 20
#: Posterior probability from which on a stage keeps a document: its likeliest language is then more
#: probable than all others together.
LEAST = 0.5
UNKNOWN = "und"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_state: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if "letters" not in _state:
        flags = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        _state["letters"] = flags
    return _state["letters"]


def normal(text: str | None) -> np.ndarray:
    """Lower-cased code points, each run of anything but letters as one space, ends too."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return np.where(letter, codes, np.uint32(32))[keep]


def buckets(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of ``normal`` code points, in pieces of bounded size."""
    for start in range(0, len(codes), PIECE):
        part = codes[start : start + PIECE + max(SIZES) - 1].astype(np.uint64)
        value, grams = np.zeros(len(part), dtype=np.uint64), []
        for size in range(1, max(SIZES) + 1):
            value = value[: len(part) - size + 1] * np.uint64(0x100000001B3) + part[size - 1 :]
            if size in SIZES:
                grams.append(value[: min(PIECE, len(codes) - start)] + np.uint64(size))
        yield (np.concatenate(grams) * _MULTIPLIER >> np.uint64(64 - bits)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            # The last place counts documents.
            total = sums.setdefault(lang, np.zeros((1 << bits) + 1, dtype=np.int64))
            total[-1] += 1
            for piece in buckets(normal(text), bits):
                total[:-1] += np.bincount(piece, minlength=1 << bits)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})


class Model:
    """Languages in code-point order, the log probabilities of every bucket in each, and their log priors."""

    def __init__(self, langs: list[str], counts: np.ndarray, documents: np.ndarray, alpha: float = ALPHA):
        self.langs, self.bits = langs, max(counts.shape[1].bit_length() - 1, 0)
        smooth = counts + alpha
        self.matrix = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32).T)
        self.prior = np.log(np.maximum(documents, 1) / max(documents.sum(), 1))

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log joint probability of every text and language, which texts have a letter)."""
        score = np.tile(self.prior, (len(texts), 1))
        lettered = np.zeros(len(texts), dtype=bool)
        held, owners, size = [], [], 0

        def add() -> None:
            grams, owner = np.concatenate(held), np.concatenate(owners)
            step = max(1, GATHERED // max(1, len(self.langs)))
            for at in range(0, len(grams), step):
                part = owner[at : at + step]
                first = np.flatnonzero(np.diff(part, prepend=-1))
                rows = self.matrix[grams[at : at + step]]
                score[part[first]] += np.add.reduceat(rows, first, axis=0, dtype=np.float64)

        for i, text in enumerate(texts):
            codes = normal(text)
            lettered[i] = len(codes) > 1
            for piece in buckets(codes, self.bits) if lettered[i] and self.langs else ():
                held.append(piece)
                owners.append(np.full(len(piece), i))
                size += len(piece)
                if size >= PIECE:
                    add()
                    held, owners, size = [], [], 0
        if held:
            add()
        return score, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of every text (of equals the first) and its posterior probability;
        ``und`` and 0 without a letter, or if no language was learned."""
        score, lettered = self.scores(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = score.argmax(axis=1)
        top = 1.0 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.langs[k] if known else UNKNOWN for k, known in zip(best.tolist(), lettered, strict=True)]
        return names, np.where(lettered, top, 0.0)


def train(rows: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS) -> Model:
    """Fit on all of ``rows`` with a non-null ``lang``; a null text counts as empty."""
    known = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    languages = [r[0] for r in known.groupBy("lang").count().select("lang").collect()]
    counted = known.mapInPandas(lambda batches: _count(batches, bits), "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(languages)
    counts = np.zeros((len(langs), (1 << bits) + 1), dtype=np.int64)
    place = {name: k for k, name in enumerate(langs)}
    counts[table["lang"].map(place).to_numpy(dtype=np.int64), table["bucket"].to_numpy(dtype=np.int64)] = table["n"]
    return Model(langs, counts[:, :-1], counts[:, -1])


_RESULT = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def predict_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct (lang, score) over the text alone; ``und`` and 0 for texts without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf(_RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = restore(Model, shared.value)
        for batch in batches:
            langs, scores = known.predict(batch.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores}, index=batch.index)

    return predict(F.col(text))


@F.pandas_udf(BooleanType())
def _has_letter(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([len(normal(t)) > 1 for t in batch], index=batch.index)


def keep_identified(docs: DataFrame, model: Model, langs: list[str] | None = None, least: float = LEAST,
                    text: str = "text") -> DataFrame:
    """The rows with an identified language, of those in ``langs`` if given, scored ``least`` or more.

    Null texts and texts without a letter are rejected; all columns stay as they are. A model that has
    learned no language can reject no text that has letters: then all of those stay.
    """
    if not model.langs:
        return docs.where(_has_letter(F.col(text)))
    found = predict_column(docs, model, text)
    keep = (found.getField("lang") != UNKNOWN) & (found.getField("score") >= least)
    if langs is not None:
        keep = keep & found.getField("lang").isin(langs)
    return docs.where(keep)
