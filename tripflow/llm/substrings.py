"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

A word is a 64-bit number made from its bytes; a window's hash is the polynomial of its words'
numbers modulo 2^64, built for all windows of many texts at once by joining shorter windows (1, 2,
4, ... words). Equal windows meet by hash, and every window whose words also start earlier (smaller
key, or same key and earlier start) is marked. Marks are dealt anew by slices of documents, where those
of a document merge into maximal runs of words.

Windows travel in pages, which are ranges of the hash, about ``PAGE_WINDOWS`` windows each, so the
number of pages follows the text and no page grows. A task holds ``HELD_WINDOWS`` windows, sorts
them and sends for each page a blob with its hashes in order, as differences, and where each window
starts: about 13 bytes a window, where a row of four columns would take 40. Of windows that are
equal within what a task holds only the earliest is sent; the others are known to be repeats and are
marked at once. So a passage that a third of all documents share reaches its pages once for every
``HELD_WINDOWS`` windows of the corpus, not once a document.

At very large sizes a blob holds few windows (with P pages, ``HELD_WINDOWS`` / P) and the cost a
window grows towards that of a row of its own, about 60 bytes; results and memory stay the same.

Equal hashes are checked by 24 bits of a second polynomial that travels with each window. So two
different windows are taken for equal only if 88 bits agree: for N windows about N^2 / 2^89 pairs, less
than one for the 2 * 10^13 windows of 100 TB of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import others
from tripflow.llm.kneser_ney import _pack, _unpack
from tripflow.sources.staging import settle

#: Words of a window.
WIDTH = 20
#: Windows of a page on average, and windows that a task sorts at once.
PAGE_WINDOWS = 2 << 20
HELD_WINDOWS = 2 << 20
#: Bytes of text whose windows are made at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 21
#: Bytes of text that hold a word, at least, for the number of pages.
WORD_BYTES = 6
#: Marks of one blob that a task sends on to a page for the way.
SENT_MARKS = 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE, _CHECK_BASE = 0xD1342543DE82EF95, 0xA0761D6478BD642F
_SIGN = np.uint64(1 << 63)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NO_KEY = (1 << 63) - 1


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_numbers(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for every word in the bytes ``data``, and its first byte; words end at ``edges`` too.

    The bytes of a word are summed with a random factor for each place, so that no pattern of bytes
    cancels out, and the sum is scrambled together with the length.
    """
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    numbers = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + PIECE_BYTES)))
        a, b = int(starts[at]), int(stops[end - 1])
        place = np.arange(a, b) - np.repeat(starts[at:end], np.diff(np.append(starts[at:end], b)))
        factor = _scramble(place.astype(np.uint64) + np.uint64(1))
        value = (data[a:b].astype(np.uint64) + np.uint64(1)) * factor * word[a:b]
        numbers[at:end] = np.add.reduceat(value, starts[at:end] - a)
        at = end
    return _scramble(numbers + (stops - starts).astype(np.uint64) * _ODD), starts


def window_hashes(numbers: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """The hash of the ``width`` numbers from every place on, as far as there are so many."""

    def power(n: int) -> np.uint64:
        return np.uint64(pow(base, n, 1 << 64))

    whole, size = None, 0
    part, n = numbers, 1
    while True:
        if width & n:
            if whole is None:
                whole = part
            else:
                whole = whole[: max(0, len(whole) - n)] * power(n)
                whole = whole + part[size : size + len(whole)]
            size += n
        if size == width:
            return _scramble(whole)
        part = part[: max(0, len(part) - n)] * power(n) + part[n:]
        n *= 2


def windows(texts: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """(hash, check, text, start) of every window of every text; start counts words from 0."""
    column = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, buffer = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffer or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    numbers, places = word_numbers(data, offsets - offsets[0])
    before = np.searchsorted(places, offsets - offsets[0])
    text = np.repeat(np.arange(len(column)), np.diff(before))
    hashes = window_hashes(numbers, width)
    inside = np.flatnonzero(np.arange(len(hashes)) + width <= before[1:][text[: len(hashes)]])
    checks = window_hashes(numbers, width, _CHECK_BASE)[inside] >> np.uint64(40)
    return hashes[inside], checks.astype(np.uint32), text[inside], inside - before[text[inside]]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``PIECE_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    at, total = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


_SENT = "page int, docs binary, entries binary, known boolean"


def _blob(page: int, docs: tuple, windows: tuple, rows: np.ndarray, starts: np.ndarray) -> tuple:
    """One row to send: the documents in ``rows``, and (hash, check, document, start) of each entry;
    entries without hash and check are marks."""
    used, place = np.unique(rows, return_inverse=True)
    entries = _pack(*windows, place.astype(np.uint64), starts.astype(np.uint64))
    return page, _pack(docs[0][used].view(np.uint64) ^ _SIGN, docs[1][used].view(np.uint64)), entries, not windows


def _send(pages: int, width: int):
    """Blobs of the earliest of equal windows by page, and of the marks of the others."""

    def flush(docs: list, found: list, turn: int) -> Iterator[tuple]:
        keys, texts = (np.concatenate(c) for c in zip(*docs, strict=True))
        hashes, checks, rows, starts = (np.concatenate(c) for c in zip(*found, strict=True))
        # Documents in order of key and text; rows that are alike in both are one.
        order = np.lexsort((texts, keys))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (np.diff(keys[order]) != 0) | (np.diff(texts[order]) != 0)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(fresh) - 1
        single = np.zeros(len(order), dtype=bool)
        single[order[fresh]] = True
        keys, texts = keys[order[fresh]], texts[order[fresh]]
        keep = single[rows]
        hashes, checks, rows, starts = hashes[keep], checks[keep], rank[rows[keep]], starts[keep]
        by = np.lexsort((starts, rows, checks, hashes))
        hashes, checks, rows, starts = hashes[by], checks[by], rows[by], starts[by]
        mark = repeats((hashes, checks), keys[rows], starts)
        known = np.flatnonzero(mark)
        known = known[np.argsort(rows[known], kind="stable")]
        for at in range(0, len(known), SENT_MARKS):
            some = known[at : at + SENT_MARKS]
            yield _blob((turn + at // SENT_MARKS) % pages, (keys, texts), (), rows[some], starts[some])
        hashes, checks, rows, starts = hashes[~mark], checks[~mark], rows[~mark], starts[~mark]
        page = page_of(hashes, pages)
        edges = np.append(np.flatnonzero(np.diff(page, prepend=-1)), len(page))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield _blob(int(page[a]), (keys, texts), (hashes[a:b], checks[a:b]), rows[a:b], starts[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, found, held, at, turn = [], [], 0, 0, None
        for batch in batches:
            for piece in _pieces(batch):
                keys = piece.column("key").to_numpy(zero_copy_only=False)
                texts = piece.column("text_key").to_numpy(zero_copy_only=False)
                hashes, checks, rows, starts = windows(piece.column("text"), width)
                if turn is None and len(texts):
                    turn = int(texts[0]) % pages  # marks of different tasks begin at different pages
                docs.append((keys, texts))
                found.append((hashes, checks, rows + at, starts))
                held, at = held + len(hashes), at + len(keys)
                if held >= HELD_WINDOWS:
                    yield _sent([*flush(docs, found, turn)])
                    docs, found, held, at = [], [], 0, 0
        if held:
            yield _sent([*flush(docs, found, turn)])

    return run


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page", "docs", "entries", "known"]
    )


def page_of(hashes: np.ndarray, pages: int) -> np.ndarray:
    """Ranges of the hash in ascending order, by its upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(pages) >> np.uint64(32)).astype(np.int64)


def repeats(windows: tuple[np.ndarray, ...], keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which entries, in order of (hash, check, key, start), have an earlier one of equal hash and check.

    Entries that share key and start with the earliest one (of rows with one key) have none.
    """
    first = _changes(*windows)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, np.int64)
    return (keys != keys[lead]) | (starts != starts[lead])


_MARKS = "slice int, docs binary, entries binary"


def _entries(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, check, key, text key, start) of the entries of each blob, without hash and check for marks."""
    names = table.column_names
    known = table.column("known").to_pylist() if "known" in names else [True] * table.num_rows
    for docs, entries, mark in zip(table.column("docs").to_pylist(), table.column("entries").to_pylist(), known, strict=True):
        keys, texts = _unpack(docs, 2)
        keys, texts = (keys ^ _SIGN).view(np.int64), texts.view(np.int64)
        *windows, rows, starts = _unpack(entries, 2 if mark else 4)
        rows = rows.astype(np.int64)
        yield *windows, keys[rows], texts[rows], starts.astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any column; the first does."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    fresh[1:] = False
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


def _meet(slices: int):
    """The marks of a page, windows with an earlier equal one, in one blob for each slice of documents."""

    def run(table: pa.Table) -> pa.Table:
        parts, marks = [], []
        for columns in _entries(table):
            (parts if len(columns) == 5 else marks).append(columns)
        if parts:
            hashes, checks, keys, texts, starts = (np.concatenate(c) for c in zip(*parts, strict=True))
            del parts
            by = np.argsort(hashes, kind="stable")
            again = np.zeros(len(by), dtype=bool)
            again[1:] = hashes[by[1:]] == hashes[by[:-1]]
            again[:-1] |= again[1:]
            by = by[again]  # most windows are alone
            by = by[np.lexsort((starts[by], keys[by], checks[by], hashes[by]))]
            keys, texts, starts = keys[by], texts[by], starts[by]
            mark = repeats((hashes[by], checks[by]), keys, starts)
            marks.append((keys[mark], texts[mark], starts[mark]))
        keys, texts, starts = (np.concatenate(c) for c in zip(*marks, strict=True))
        part = page_of(_scramble(keys.view(np.uint64) ^ _scramble(texts.view(np.uint64))), slices)
        by = np.lexsort((starts, texts, keys, part))
        keys, texts, starts, part = keys[by], texts[by], starts[by], part[by]
        rank = np.cumsum(_changes(keys, texts, part)) - 1
        at = np.flatnonzero(_changes(keys, texts, part))
        docs = keys[at], texts[at]
        edges = np.append(np.flatnonzero(_changes(part)), len(part))
        rows = [_blob(int(part[a]), docs, (), rank[a:b], starts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({
            "slice": pa.array([r[0] for r in rows], pa.int32()), "docs": pa.array([r[1] for r in rows], pa.binary()),
            "entries": pa.array([r[2] for r in rows], pa.binary()),
        })

    return run


_SPANS = "key long, text_key long, starts array<int>, stops array<int>"


def _merge(width: int):
    """The maximal runs of marked words of every document of a slice, one row a document."""

    def run(table: pa.Table) -> pa.Table:
        keys, texts, starts = (np.concatenate(c) for c in zip(*_entries(table), strict=True))
        by = np.lexsort((starts, texts, keys))
        keys, texts, starts = keys[by], texts[by], starts[by]
        doc = _changes(keys, texts)
        new = doc.copy()
        new[1:] |= np.diff(starts) > width  # windows that touch are one run
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        at = np.flatnonzero(doc)
        ends = np.append(np.searchsorted(first, at), len(first)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (starts[first], starts[last] + width)]
        return pa.table({"key": keys[at], "text_key": texts[at], "starts": lists[0], "stops": lists[1]})

    return run


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, text_key, starts, stops): the runs of words to remove of every document that has any."""
    rows = docs.select(_key(key), _text_key(text), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    pages = max(1, round(size / WORD_BYTES / PAGE_WINDOWS))
    sent = rows.where(F.col("text").isNotNull()).mapInArrow(_send(pages, width), _SENT)
    # A task a page, so that none grows with the text. Written, so that the shuffled windows are gone
    # before texts are joined.
    paged = sent.repartitionById(pages, F.col("page")).groupBy("page")
    marks = settle(paged.applyInArrow(_meet(pages), _MARKS), "marks")
    return marks.repartitionById(pages, F.col("slice")).groupBy("slice").applyInArrow(_merge(width), _SPANS)


def _key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("key")


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")


_CUT = "n_words long, n_removed long, spans array<struct<start:int,stop:int>>, kept string"


def _cut(spans: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, starts, stops in spans:
        rows = []
        for text, begin, end in zip(texts, starts, stops, strict=True):
            words = text.encode().split() if text else []
            runs = [] if begin is None else [*zip(begin.tolist(), end.tolist(), strict=True)]
            kept, at = [], 0
            for a, b in runs:
                kept += words[at:a]
                at = b
            kept += words[at:]
            rows.append((len(words), len(words) - len(kept), [{"start": a, "stop": b} for a, b in runs], b" ".join(kept).decode()))
        yield pd.DataFrame(rows, columns=["n_words", "n_removed", "spans", "kept"], index=texts.index)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with (n_words, n_removed, spans, kept): every word that a repeated window covers goes.

    Words are runs between ASCII white space, compared byte by byte. A window is ``width`` words of one
    text; it is repeated if its words also start earlier, in a document of a smaller key or earlier in
    its own. Windows are judged on the input, not on what other removals leave. ``spans`` are the
    maximal runs of removed words, numbered from 0; ``kept`` are the other words joined by a blank.

    A null text has no words; a text of fewer than ``width`` words loses none. Rows without a key come
    after all others, and are ordered among themselves by start only. Rows that share a key are one
    document as far as order goes: windows at the same place of two of them don't remove each other.
    Repeated rows get equal results. Columns of ``docs`` named like a result are replaced.
    """
    spans = repeated_spans(docs, key, text, width)
    whole = docs.select(F.struct("*").alias("doc"), _key(key), _text_key(text))
    joined = whole.join(spans, ["key", "text_key"], "left")
    cut = F.pandas_udf(_cut, _CUT)(F.col("doc").getField(text), F.col("starts"), F.col("stops"))
    cut = joined.select("doc", cut.alias("cut"))
    names = ("n_words", "n_removed", "spans", "kept")
    kept = docs.select([c for c in docs.columns if c not in names])
    return cut.select(*others(kept, ()), *[F.col("cut").getField(c).alias(c) for c in names])
