"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored over mapped arrays.

Tokens are the words between ASCII white space, A-Z lower-cased, and one end per text, each a
64-bit number made from its bytes. Three passes:

1. words: every task sums its tokens and sends them by hash bucket; a bucket's task merges them.
2. bigrams: likewise, as (left, right, count). A bucket's task merges its bigrams, writes their
   64-bit hashes in order with their counts as one file in the shared folder, and returns what the
   next pass needs: per left word how many bigrams occur once, twice, more often; per right word
   how many different words it follows. The bigrams of a left word share a bucket, but for those
   words with more than a bucket's share of all tokens, which are spread by the whole bigram.
3. vocabulary: words, left and right sums meet by bucket and become files like those of bigrams.

A bucket holds about ``BUCKET_TOKENS`` tokens, so the number of buckets, files and tasks follows
the corpus and no task grows. Workers map the files and look up the sorted distinct words and
bigrams of many texts at once; nothing of the model is sent through the driver but its scalars and
the list of files. Where the shared folder is not a mounted one, a worker maps a private copy.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import restore
from tripflow.llm.files import store, write_file
from tripflow.sources.staging import new_path, settle

#: Tokens, and so at most distinct bigrams, of a bucket on average.
BUCKET_TOKENS = 4 << 20
#: Tokens that a task sums before it sends them.
HELD_TOKENS = 4 << 20
#: Tokens, counted as six bytes of text each, that are scored at once.
SCORED_TOKENS = 2 << 20
#: Bytes of text turned into words at once.
PIECE_BYTES = 1 << 21
END, BEGIN = np.uint64(0), np.uint64(1)
_BASE = 0xA0761D6478BD642F
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_state: dict[str, object] = {}


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _scramble(_scramble(left) + right)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (_scramble(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(20)) % np.uint64(buckets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if "powers" not in _state or len(_state["powers"][0]) < n:
        size = max(n, PIECE_BYTES + 1)
        found = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, np.uint64(base))
            out[0] = 1
            found.append(np.multiply.accumulate(out))
        _state["powers"] = tuple(found)
    return _state["powers"]


_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in ``data`` and where they start; words also end at ``breaks``."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_FOLD[data] * powers[: len(data)], out=sums[1:])
    value = (sums[stops] - sums[starts]) * inverse[starts]
    number = _scramble(value + (stops - starts).astype(np.uint64) * _ODD)
    return np.maximum(number, np.uint64(2)), starts


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a column of texts, an end after each, and for each text where its tokens start."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, buffer = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffer or b"", dtype=np.uint8)
    found, places, at, stop = [], [], int(offsets[0]), int(offsets[-1])
    while at < stop:
        end = min(at + PIECE_BYTES, stop)
        if end < stop and not _SPACE[data[end]]:
            # A piece ends at white space or between texts; a longer word makes it longer.
            spaces = np.flatnonzero(_SPACE[data[at:end]])
            edges = offsets[(offsets > at) & (offsets <= end)]
            best = max(int(spaces[-1]) + at if len(spaces) else at, int(edges[-1]) if len(edges) else at)
            while best == at and end < stop and not _SPACE[data[end]] and end not in offsets:
                end += 1
            end = best if best > at else end
        inner = offsets[(offsets > at) & (offsets < end)] - at
        numbers, starts = _words(data[at:end], inner)
        found.append(numbers)
        places.append(starts + at)
        at = end
    numbers = np.concatenate(found) if found else np.zeros(0, np.uint64)
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    before = np.searchsorted(places, offsets)  # words before each text, and all of them
    owner = np.repeat(np.arange(len(column)), np.diff(before))
    out = np.zeros(len(numbers) + len(column), dtype=np.uint64)
    out[np.arange(len(numbers)) + owner] = numbers
    return out, before[:-1] + np.arange(len(column))


def _pack(*columns: np.ndarray) -> bytes:
    """Unsigned columns as byte planes, compressed; the first in ascending order, as differences."""
    first, *rest = columns
    steps = np.diff(first, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes() for c in (steps, *rest)]
    return len(first).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, width: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]) if n else b"", dtype=np.uint8)
    columns = [
        np.ascontiguousarray(p.reshape(8, n).T).view("<u8").reshape(n) for p in raw.reshape(width, 8 * n)
    ]
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns


def _by_bucket(kind: int, buckets: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(kind, bucket, blob) for columns that are in ascending order of the first."""
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order], prepend=np.uint64(_MASK), append=np.uint64(_MASK)))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield kind, int(buckets[order[a]]), _pack(*(c[order[a:b]] for c in columns))


_SENT = "kind int, bucket int, blob binary"


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())],
        names=["kind", "bucket", "blob"],
    )


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and text starts of many texts at a time."""
    parts, starts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            numbers, firsts = tokens(batch.column("text").slice(at, 1000))
            parts.append(numbers)
            starts.append(firsts + size)
            size += len(numbers)
            if size >= HELD_TOKENS:
                yield np.concatenate(parts), np.concatenate(starts)
                parts, starts, size = [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(starts)


def _left(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each token; a text's first follows BEGIN."""
    left = np.empty_like(numbers)
    left[1:] = numbers[:-1]
    left[starts] = BEGIN
    return left


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and sums of the counts of equal ones."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts]
    return keys[first], *sums


def _send_words(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, _ in _held(batches):
            words, counts = np.unique(numbers, return_counts=True)
            yield _sent([*_by_bucket(0, _bucket(words, buckets), words, counts.astype(np.uint64))])

    return run


_WORDS = "bucket int, blob binary, tokens long, words long, top array<long>, top_count array<long>"
_TOP = 64


def _merge_words(table: pa.Table) -> pa.Table:
    columns = [_unpack(b, 2) for b in table.column("blob").to_pylist()]
    words, counts = _summed(*(np.concatenate(c) for c in zip(*columns, strict=True)))
    top = np.argsort(-counts.astype(np.int64), kind="stable")[:_TOP]
    return pa.table({
        "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
        "blob": pa.array([_pack(words, counts)], pa.binary()),
        "tokens": pa.array([int(counts.sum())], pa.int64()), "words": pa.array([len(words)], pa.int64()),
        "top": pa.array([words[top].astype(np.int64).tolist()], pa.list_(pa.int64())),
        "top_count": pa.array([counts[top].astype(np.int64).tolist()], pa.list_(pa.int64())),
    })


class Routes:
    """Which bucket a word or a bigram belongs to."""

    def __init__(self, buckets: int, heavy: np.ndarray):
        self.buckets, self.heavy = buckets, np.sort(heavy.astype(np.uint64))

    def bigrams(self, left: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        heavy = np.isin(left, self.heavy) if len(self.heavy) else np.zeros(len(left), dtype=bool)
        return np.where(heavy, _bucket(pairs, self.buckets), _bucket(left, self.buckets))


def _send_bigrams(routes: Routes) -> Callable:
    state = vars(routes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = restore(Routes, state)
        for numbers, starts in _held(batches):
            left = _left(numbers, starts)
            pairs, first, counts = np.unique(_pair(left, numbers), return_index=True, return_counts=True)
            left, right = left[first], numbers[first]
            order = np.argsort(left, kind="stable")
            left, right, pairs, counts = left[order], right[order], pairs[order], counts[order]
            rows = _by_bucket(0, known.bigrams(left, pairs), left, right, counts.astype(np.uint64))
            yield _sent([*rows])

    return run


_FILES = "kind int, bucket int, blob binary, path string, sums array<long>"


def _files(rows: list[tuple[int, int, bytes | None, str | None, list[int] | None]]) -> pa.Table:
    kinds, buckets, blobs, paths, sums = zip(*rows, strict=True)
    return pa.table({
        "kind": pa.array(kinds, pa.int32()), "bucket": pa.array(buckets, pa.int32()),
        "blob": pa.array(blobs, pa.binary()), "path": pa.array(paths, pa.string()),
        "sums": pa.array(sums, pa.list_(pa.int64())),
    })


def _narrow(column: np.ndarray) -> np.ndarray:
    """The column in as few bytes a value as its largest needs."""
    most = int(column.max(initial=0))
    return column.astype(next(f"<u{n}" for n in (1, 2, 4, 8) if most < 1 << 8 * n))


def _write_arrays(folder: str, name: str, *columns: np.ndarray) -> str:
    """One file: the number of rows, eight bytes for the width of each column, then the columns one
    after the other. Fresh for each attempt."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}.bin"
    widths = [c.itemsize.to_bytes(8, "little") for c in columns]
    write_file(path, [len(columns[0]).to_bytes(8, "little"), *widths, *(c.tobytes() for c in columns)])
    return path


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


_LEFT, _RIGHT, _FILE, _WORD = 1, 2, 3, 4


def _merge_bigrams(folder: str, buckets: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        columns = [_unpack(b, 3) for b in table.column("blob").to_pylist()]
        left, right, counts = (np.concatenate(c) for c in zip(*columns, strict=True))
        del columns
        pairs = _pair(left, right)
        order = np.argsort(pairs, kind="stable")
        pairs, left, right, counts = pairs[order], left[order], right[order], counts[order]
        first = np.flatnonzero(np.diff(pairs, prepend=~pairs[:1]))
        pairs, left, right, counts = pairs[first], left[first], right[first], np.add.reduceat(counts, first)
        path = _write_arrays(folder, f"bigrams-{bucket}", pairs, _narrow(counts))
        rows = [(_FILE, bucket, None, path, _of_counts(counts))]
        ones = [(counts == 1).astype(np.uint64), (counts == 2).astype(np.uint64), (counts > 2).astype(np.uint64)]
        lefts = _summed(left, *ones)
        rights = _summed(right, np.ones(len(right), dtype=np.uint64))
        for kind, sums in ((_LEFT, lefts), (_RIGHT, rights)):
            rows += [(k, b, blob, None, None) for k, b, blob in _by_bucket(kind, _bucket(sums[0], buckets), *sums)]
        return _files(rows)

    return run


def _merge_vocabulary(folder: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = {_WORD: [], _LEFT: [], _RIGHT: []}
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            parts[kind].append(_unpack(blob, {_WORD: 2, _LEFT: 4, _RIGHT: 2}[kind]))
        keys, columns = [], []
        for kind, at in ((_WORD, [0]), (_LEFT, [1, 2, 3]), (_RIGHT, [4])):
            for key, *values in parts[kind]:
                wide = np.zeros((5, len(key)), dtype=np.uint64)
                wide[at] = values
                keys.append(key)
                columns.append(wide)
        words, *sums = _summed(np.concatenate(keys), *np.concatenate(columns, axis=1))
        count, one, two, more, follows = sums
        path = _write_arrays(folder, f"words-{bucket}", words, *map(_narrow, (count, one, two, more, follows)))
        return _files([(_WORD, bucket, None, path, [*_of_counts(follows), int(follows.sum()), int((follows > 2).sum())])])

    return run


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts, each above 0 and below what it is taken from.

    A half each where the counts of counts don't give such: where few words are seen once and many
    often. A discount of 0 would leave no mass for what has not been seen, and probabilities of 0.
    """
    n = (ones, twos, threes, fours)
    if not all(n):
        return 0.5, 0.5, 0.5
    share = ones / (ones + 2 * twos)
    found = tuple(k + 1 - (k + 2) * share * n[k + 1] / n[k] for k in range(3))
    return found if all(0 < d < k + 1 for k, d in enumerate(found)) else (0.5, 0.5, 0.5)


class Model:
    """Scalars and file lists of a trained model; the arrays stay in their files."""

    def __init__(self, buckets: int, heavy: np.ndarray, tokens: int, words: int, texts: int,
                 files: dict[str, dict[int, str]], bigram_sums: list[int], word_sums: list[int]):
        self.buckets, self.heavy = buckets, heavy
        self.tokens, self.words, self.texts, self.files = tokens, words, texts, files
        self.discounts = (0.0, *discounts(*bigram_sums))
        self.word_discounts = (0.0, *discounts(*word_sums[:4]))
        self.follows = word_sums[4]
        d = self.word_discounts
        spared = d[1] * word_sums[0] + d[2] * word_sums[1] + d[3] * word_sums[5]
        self.word_rest = spared / self.follows if self.follows else 1.0


class Scorer:
    """Look-ups in the mapped files of a model."""

    COLUMNS: ClassVar = {"words": 6, "bigrams": 2}

    def __init__(self, model: Model):
        self.model, self.open = model, {}
        self.routes = Routes(model.buckets, model.heavy)

    def _map(self, kind: str, bucket: int) -> list[np.ndarray] | None:
        if (kind, bucket) not in self.open:
            path = self.model.files[kind].get(bucket)
            self.open[kind, bucket] = path and _mapped(path, self.COLUMNS[kind])
        return self.open[kind, bucket]

    def _look_up(self, kind: str, keys: np.ndarray, buckets: np.ndarray, columns: int) -> np.ndarray:
        out = np.zeros((columns, len(keys)), dtype=np.float64)
        order = np.argsort(buckets, kind="stable")
        edges = np.flatnonzero(np.diff(buckets[order], prepend=np.uint64(_MASK), append=np.uint64(_MASK)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = order[a:b]
            arrays = self._map(kind, int(buckets[rows[0]]))
            if arrays is None or not len(arrays[0]):
                continue
            at = np.minimum(np.searchsorted(arrays[0], keys[rows]), len(arrays[0]) - 1)
            hit = arrays[0][at] == keys[rows]
            for k in range(columns):
                out[k, rows[hit]] = arrays[k + 1][at[hit]]
        return out

    def score(self, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score and score, both log10."""
        m = self.model
        left = _left(numbers, starts)
        words, place = np.unique(np.concatenate([numbers, left]), return_inverse=True)
        count, one, two, more, follows = self._look_up("words", words, _bucket(words, m.buckets), 5)
        base = np.log10((count + 1) / (m.tokens + m.words + 1))
        d = np.array(m.word_discounts)
        seen = np.maximum(follows - d[np.minimum(follows, 3).astype(np.int64)], 0)
        single = seen / max(m.follows, 1) + m.word_rest / (m.words + 1)
        context = np.where(words == BEGIN, float(m.texts), count)
        d = m.discounts
        # A left word that training never saw leaves everything to the single words.
        rest = np.where(context > 0, (d[1] * one + d[2] * two + d[3] * more) / np.maximum(context, 1), 1.0)
        right_at, left_at = place[: len(numbers)], place[len(numbers) :]
        pairs, first, again = np.unique(_pair(left, numbers), return_index=True, return_inverse=True)
        met = self._look_up("bigrams", pairs, self.routes.bigrams(left[first], pairs), 1)[0]
        met = np.maximum(met - np.array(d)[np.minimum(met, 3).astype(np.int64)], 0)
        l1, r1 = left_at[first], right_at[first]
        p = met / np.maximum(context[l1], 1) + rest[l1] * single[r1]
        sizes = np.diff(starts, append=len(numbers))
        total = lambda values: np.add.reduceat(values, starts) if len(starts) else values[:0]
        return sizes, total((count[right_at] > 0).astype(np.int64)), total(base[right_at]), total(np.log10(p)[again])


def _mapped(uri: str, number: int) -> list[np.ndarray]:
    """The columns of an array file, mapped into memory."""
    system, path = store(uri)
    own = not isinstance(system, fs.LocalFileSystem)
    if own:
        handle, copy = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, system.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                out.write(block)
        path = copy
    whole = np.memmap(path, dtype=np.uint8, mode="r")
    if own:
        os.unlink(path)  # the mapping holds what it needs
    n, *widths = np.frombuffer(whole[: 8 + 8 * number].tobytes(), dtype="<u8").tolist()
    at, columns = 8 + 8 * number, []
    for width in widths:
        stop = at + n * width
        columns.append(np.frombuffer(whole, dtype=f"<u{width}", count=n, offset=at))
        at = stop
    return columns


def train(texts: DataFrame, text: str = "text", bucket_tokens: int = BUCKET_TOKENS) -> Model:
    """Count ``texts`` and write the model's files. Null texts count as empty: just an end."""
    spark = texts.sparkSession
    column = texts.select(F.col(text).alias("text"))
    size = column.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    # A word and its space take two bytes or more, six as a rule.
    buckets = int(((size[1] or 0) / 6 + size[0]) // bucket_tokens) + 1
    folder = new_path(spark, "model")

    def by_bucket(sent: DataFrame):
        # A task a bucket, so that none grows with the corpus.
        return sent.repartitionById(buckets, F.col("bucket")).groupBy("bucket")

    words = settle(by_bucket(column.mapInArrow(_send_words(buckets), _SENT)).applyInArrow(_merge_words, _WORDS), "words")
    parts = words.select("tokens", "words", "top", "top_count").collect()
    n = sum(r.tokens for r in parts)
    heavy = [t for r in parts for t, c in zip(r.top, r.top_count, strict=True) if c > n / buckets]
    routes = Routes(buckets, np.array([*heavy, int(BEGIN)], dtype=np.int64).view(np.uint64))
    sent = by_bucket(column.mapInArrow(_send_bigrams(routes), _SENT))
    bigrams = settle(sent.applyInArrow(_merge_bigrams(folder, buckets), _FILES), "bigrams")
    own = words.select(F.lit(_WORD).alias("kind"), "bucket", "blob")
    met = own.unionByName(bigrams.where("blob is not null").select("kind", "bucket", "blob"))
    vocabulary = settle(by_bucket(met).applyInArrow(_merge_vocabulary(folder), _FILES), "vocabulary")
    listed = {}
    for name, rows in (("bigrams", bigrams), ("words", vocabulary)):
        listed[name] = rows.where("path is not null").select("bucket", "path", "sums").collect()
    sums = {k: [sum(c) for c in zip(*(r.sums for r in v), strict=True)] for k, v in listed.items()}
    return Model(
        buckets, routes.heavy, n, sum(r.words for r in parts), size[0],
        {k: {r.bucket: r.path for r in v} for k, v in listed.items()},
        sums["bigrams"] or [0] * 4, sums["words"] or [0] * 6,
    )


def score(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n_tokens, n_known, base_score, score) for every row; scores are log10.

    ``score`` is the model's log10 probability of the text with its end, ``base_score`` that of
    add-one smoothed single words; perplexity is 10 ** (-score / n_tokens). A null or empty text
    is just an end. Without training texts every token has probability 1 / (V + 1) = 1. Keys named like
    a result are left out.
    """
    added = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}
    keys = [k for k in keys if k not in added]
    inner = [f"key_{i}" for i in range(len(keys))]
    rows = docs.select(*[F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)], F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)
    schema = ", ".join([*([kinds] if kinds else []), *(f"{name} {kind}" for name, kind in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(restore(Model, shared.value))
        for batch in batches:
            # As many texts at once as hold about SCORED_TOKENS tokens.
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(sizes, done + 6 * SCORED_TOKENS)))
                part = batch.slice(at, stop - at)
                found = scorer.score(*tokens(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in inner), *(pa.array(c) for c in found)], names=[*keys, *added]
                )
                at = stop

    return rows.mapInArrow(run, schema)
