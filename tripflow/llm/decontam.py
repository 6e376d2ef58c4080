"""Benchmark decontamination: find benchmark word windows inside training documents.

A window is ``width`` consecutive words of an item; a shorter item is one window. Windows are kept
as a sorted set of 64-bit hashes, broadcast to the workers when the benchmark is small enough
(``MAX_BROADCAST_BYTES`` of text, measured first). Each document's words become numbers of the
benchmark's vocabulary, rolling hashes of all its windows are looked up at once, and every hit is
verified word by word.

A larger benchmark takes ``scan_by_join``. A filter of ``FILTER_BITS`` bits is made of its windows' hashes,
block by block in Spark, and broadcast; its size doesn't depend on the benchmark. Of a document's windows
only those that pass it leave the task, and these are joined with the benchmark's by hash and compared
word by word. A benchmark of so many windows that most bits are set lets more windows pass, no others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tripflow.llm.common import others, restore
from tripflow.llm.substrings import window_hashes, word_numbers
from tripflow.sources.staging import settle

WIDTH = 10
#: Bits of the filter of a large benchmark, a power of two, and those that a task puts together.
FILTER_BITS, _BLOCK_BITS = 1 << 27, 1 << 13
#: Benchmark text up to which its windows are broadcast: about 20 bytes a window and 150 a word.
MAX_BROADCAST_BYTES = 32 << 20
_WORD_ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NORMAL = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256)
)
_SPAN = StructType([StructField("start", LongType()), StructField("stop", LongType())])
SCAN = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())),
        StructField("spans", ArrayType(_SPAN)),
    ]
)

#: Columns that a scan adds; they replace columns of the same name.
ADDED = ("n_words", "n_hit", "items")


def words_of(text: str) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_NORMAL).split()


class Windows:
    """The windows of a benchmark as arrays; small to send and shared by all documents."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        names: dict[str, int] = {}
        flat, starts, lengths, owners = [], [], [], []
        for item_id, text in items:
            ids = [number(w, len(self.vocabulary) + 1) for w in words_of(text or "")]
            if not ids:
                continue
            size = min(width, len(ids))
            owner = -1 if item_id is None else names.setdefault(str(item_id), len(names))
            for i in range(len(ids) - size + 1):
                starts.append(len(flat) + i)
                lengths.append(size)
                owners.append(owner)
            flat.extend(ids)
        self.names = list(names)
        self.flat = np.array(flat, dtype=np.int32)
        self._index(np.array(starts, np.int64), np.array(lengths, np.int64), np.array(owners, np.int64))

    def _index(self, starts, lengths, owners) -> None:
        for seed in range(100):
            rng = np.random.default_rng(seed)
            self.values = rng.integers(1, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64)
            self.factor = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
            self.tables, clash = {}, False
            for size in sorted(set(lengths.tolist())):
                at = np.flatnonzero(lengths == size)
                grid = self.flat[starts[at][:, None] + np.arange(size)]
                hashes = self.rolling(grid.T, size)
                order = np.argsort(hashes, kind="stable")
                keys, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
                rows = grid[order]
                clash |= bool((rows != np.repeat(rows[first], count, axis=0)).any())
                ends = np.append(first, len(order))
                self.tables[size] = (keys, starts[at][order][first], ends, owners[at][order])
            if not clash:
                return
        raise RuntimeError("no hash without collisions was found")

    def rolling(self, columns, size: int):
        """Hash of ``size`` ids; columns[j] holds the ids at offset j of each window."""
        total = np.zeros(len(columns[0]), dtype=np.uint64)
        for j in range(size):
            total = total * self.factor + self.values[columns[j]]
        return total

    def scan(self, text: str | None) -> tuple[int, np.ndarray, list[str]]:
        """Number of words, which of them are hit, and the items with a window here, sorted."""
        words = words_of(text) if text else []
        n, get = len(words), self.vocabulary.get
        hit = np.zeros(n, dtype=bool)
        if not n or not self.tables:
            return n, hit, []
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=n)
        unknown = np.append(np.flatnonzero(ids == 0), n)
        found: set[int] = set()
        edges = np.zeros(n + 1, dtype=np.int64)
        for size, (keys, rows, ends, owners) in self.tables.items():
            if size > n:
                continue
            at = np.arange(n - size + 1)
            at = at[unknown[np.searchsorted(unknown, at)] - at >= size]
            if not len(at):
                continue
            hashes = self.rolling([ids[at + j] for j in range(size)], size)
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            match = np.flatnonzero(keys[place] == hashes)
            for i, k in zip(at[match].tolist(), place[match].tolist(), strict=True):
                if (self.flat[rows[k] : rows[k] + size] == ids[i : i + size]).all():
                    edges[i] += 1
                    edges[i + size] -= 1
                    found.update(owners[ends[k] : ends[k + 1]].tolist())
        found.discard(-1)
        return n, np.cumsum(edges[:n]) > 0, sorted(self.names[k] for k in found)


def hit_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point ranges of the runs of hit words, from the first word's start to the last's end."""
    spans: list[list[int]] = []
    before = False
    for m, now in zip(_WORD_ANY_CASE.finditer(text), hit.tolist(), strict=True):
        if now and before:
            spans[-1][1] = m.end()
        elif now:
            spans.append([m.start(), m.end()])
        before = now
    return [tuple(s) for s in spans]


def _scan_udf(shared):
    @F.pandas_udf(SCAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = restore(Windows, shared.value)
        for batch in batches:
            rows = []
            for text in batch:
                n, hit, items = windows.scan(text)
                spans = hit_spans(text, hit) if hit.any() else []
                rows.append((n, int(hit.sum()), items, [{"start": a, "stop": b} for a, b in spans]))
            yield pd.DataFrame(rows, columns=SCAN.names)

    return scan


def _fits(benchmark: DataFrame, text: str) -> bool:
    size = benchmark.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    return size <= MAX_BROADCAST_BYTES


def scan_by_broadcast(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text"):
    """The scan result (n_words, n_hit, items, spans) as a column over ``docs``' text."""
    items = [(r[0], r[1]) for r in benchmark.select("item_id", "text").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(vars(Windows(items, width)))
    return _scan_udf(shared)(F.col(text))


def _hashes(words: list[bytes], sizes: list[int]) -> dict[int, np.ndarray]:
    """The hashes of all windows of each size, by place."""
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    numbers, _ = word_numbers(data, np.array([0, len(data)])) if words else (np.zeros(0, np.uint64), None)
    return {size: window_hashes(numbers, size) for size in sizes if size <= len(words)}


_WINDOWS = ArrayType(
    StructType()
    .add("size", IntegerType()).add("at", IntegerType()).add("hash", LongType()).add("window", StringType())
)


@F.pandas_udf(_WINDOWS)
def _item_windows(texts: pd.Series, widths: pd.Series) -> pd.Series:
    """All windows of benchmark items, a shorter item being one."""
    found = []
    for text, width in zip(texts, widths, strict=True):
        words = words_of(text) if text else []
        size = min(len(words), int(width))
        hashes = _hashes(words, [size]).get(size, ()) if size else ()
        found.append([_window(words, size, at, h) for at, h in enumerate(hashes)])
    return pd.Series(found, index=texts.index, dtype=object)


def _window(words: list[bytes], size: int, at: int, value: np.uint64) -> dict:
    text = b" ".join(words[at : at + size]).decode()
    return {"size": size, "at": at, "hash": int(value.astype(np.int64)), "window": text}


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in the filter."""
    bits = np.uint64(FILTER_BITS - 1)
    return hashes & bits, (hashes >> np.uint64(32)) & bits


def window_filter(item_windows: DataFrame) -> np.ndarray:
    """The filter's bytes: blocks of bits are put together in tasks, and only blocks reach the driver."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(_BLOCK_BITS, dtype=np.uint8)
        bits[rows["slot"].to_numpy() % _BLOCK_BITS] = 1
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    low, high = F.lit(FILTER_BITS - 1).cast("long"), F.shiftrightunsigned("hash", 32)
    slots = F.explode(F.array(F.col("hash").bitwiseAND(low), high.bitwiseAND(low))).alias("slot")
    placed = item_windows.select(slots).distinct().withColumn("block", F.floor(F.col("slot") / _BLOCK_BITS).cast("int"))
    whole = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in placed.groupBy("block").applyInPandas(block, "block int, bits binary").toLocalIterator():
        at = r.block * _BLOCK_BITS // 8
        whole[at : at + _BLOCK_BITS // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    return whole


def _passing(shared, sizes: list[int]):
    """(n_words, windows): the windows of a document that pass the filter."""

    @F.pandas_udf(StructType().add("n_words", LongType()).add("windows", _WINDOWS))
    def passing(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        whole = shared.value
        for batch in batches:
            rows = []
            for text in batch:
                words, found = words_of(text) if text else [], []
                for size, hashes in _hashes(words, sizes).items():
                    both = [whole[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 for slot in _slots(hashes)]
                    found += [_window(words, size, at, hashes[at]) for at in np.flatnonzero(both[0] & both[1]).tolist()]
                rows.append((len(words), found))
            yield pd.DataFrame(rows, columns=["n_words", "windows"], index=batch.index)

    return passing


def _join_windows(docs: DataFrame, benchmark: DataFrame, width: int, text: str) -> tuple[DataFrame, ...]:
    """(row, doc), (row, n_words), (item_id, size, window) and the occurrences (row, size, at, window)."""
    # Written with its row number, which a second run of the expression could give anew.
    rows = settle(
        docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows"
    )
    windows = benchmark.select("item_id", F.explode(_item_windows(F.col("text"), F.lit(width))).alias("w"))
    item_windows = settle(windows.select("item_id", "w.size", "w.hash", "w.window").distinct(), "item_windows")
    sizes = [r[0] for r in item_windows.select("size").distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast(window_filter(item_windows))
    passing = _passing(shared, sizes)(F.col("doc").getField(text)).alias("p")
    scanned = settle(rows.select("row", passing).select("row", "p.*"), "passing")
    named = item_windows.select("size", "hash", "window").distinct()
    seen = scanned.select("row", F.explode("windows").alias("w")).select("row", "w.*")
    met = settle(seen.join(named, ["size", "hash", "window"]).select("row", "size", "at", "window"), "met")
    return rows, scanned.select("row", "n_words"), item_windows.drop("hash"), met


def _hit_words(met: DataFrame) -> DataFrame:
    """(row, at) of every word inside an occurrence, once."""
    place = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1))
    return met.select("row", place.alias("at")).distinct()


def scan_by_join(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit and items, for a benchmark of any size: windows are joined."""
    rows, words, item_windows, met = _join_windows(docs, benchmark, width, text)
    n_hit = _hit_words(met).groupBy("row").agg(F.count("*").alias("n_hit"))
    items = (
        met.select("row", "size", "window").distinct().join(item_windows, ["size", "window"])
        .select("row", F.col("item_id").cast("string").alias("item"))
        .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        rows.join(words, "row")
        .join(n_hit, "row", "left").join(items, "row", "left")
        .select(*others(docs, ADDED), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


@F.pandas_udf(ArrayType(_SPAN))
def _spans_of(texts: pd.Series, places: pd.Series) -> pd.Series:
    """Spans of the hit words whose numbers are in ``places``."""
    found = []
    for text, at in zip(texts, places, strict=True):
        hit = np.zeros(len(words_of(text)), dtype=bool)
        hit[at] = True
        found.append([{"start": a, "stop": b} for a, b in hit_spans(text, hit)])
    return pd.Series(found, dtype=object)


def _with_spans(docs: DataFrame, benchmark: DataFrame, width: int, text: str) -> DataFrame:
    """(doc, spans): the rows of ``docs`` and the ranges to cut, none if nothing is hit."""
    if _fits(benchmark, "text"):
        spans = scan_by_broadcast(docs, benchmark, width, text).getField("spans")
        return docs.select(F.struct("*").alias("doc"), spans.alias("spans"))
    rows, _, _, met = _join_windows(docs, benchmark, width, text)
    # A document has no more hit words than words: one row holds their numbers.
    places = _hit_words(met).groupBy("row").agg(F.collect_list("at").alias("places"))
    value = F.col("doc").getField(text)
    hit = rows.join(places, "row").select("doc", _spans_of(value, F.col("places")).alias("spans"))
    none = F.array().cast(ArrayType(_SPAN)).alias("spans")
    return hit.unionByName(rows.join(places, "row", "left_anti").select("doc", none))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """(docs' columns, n_words, n_hit, items) for every row.

    ``items`` are the ids (as text, sorted) of the items with a window in the document. Null and
    empty texts have no words. An item without words has no window; one without an id still
    marks words as hit but is not listed. Repeated rows and items change nothing for others.
    """
    if not _fits(benchmark, "text"):
        return scan_by_join(docs, benchmark, width, text)
    result = scan_by_broadcast(docs, benchmark, width, text)
    scanned = docs.select(F.struct("*").alias("doc"), result.alias("scan"))
    return scanned.select(*others(docs, ADDED), "scan.n_words", "scan.n_hit", "scan.items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit."""
    if not _fits(benchmark, "text"):
        return scan_by_join(docs, benchmark, width, text).where("n_hit = 0").select(*docs.columns)
    return docs.where(scan_by_broadcast(docs, benchmark, width, text).getField("n_hit") == 0)


def cut_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """``docs`` with the runs of hit words cut out of the text; the rest of it stays as it is."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans").getField("stop"))
    stops = F.concat(
        F.col("spans").getField("start"), F.array(F.length(F.col("doc").getField(text)).cast("long"))
    )
    pieces = F.zip_with(
        starts, stops,
        lambda a, b: F.substring(F.col("doc").getField(text), (a + 1).cast("int"), (b - a).cast("int")),
    )
    scanned = _with_spans(docs, benchmark, width, text)
    kept = F.when(F.col("doc").getField(text).isNotNull(), F.array_join(pieces, ""))
    return scanned.select(
        *[kept.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns]
    )
