"""Benchmark decontamination: Wu-Manber search for all windows of all test items at once.

The alphabet are words.  Patterns of equal length form one search; a block is the last two words
under the search head.  ``shift`` says how far the head may move when it sees a block: the least
distance of that block to a pattern's end, or the whole pattern if no pattern holds it.  Where it
is zero, the bucket of the suffix's hash, narrowed by the first word's hash, gives the patterns to
compare, and the bytes themselves are compared.  Many heads move through a text at once (numpy), each
over its own stretch of end positions.

Patterns are fixed by the benchmark, not by the documents.  Their size is measured first; they go
to the tasks in blocks of at most ``BLOCK_BYTES``, one pass over the documents per block, so a
benchmark of any size needs bounded memory and nothing is left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivcheck.llm.common import binary_text
from equivcheck.session import written

WINDOW = 10
BLOCK_BYTES = 8_000_000  # of benchmark texts whose patterns a task holds at a time
PIECE = 1 << 20  # bytes of text worked on together
STRETCH = 64  # end positions per search head
_BITS = 20  # of the index into the shift table
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_MARK = b"\x00"  # a word that no text holds: it parts documents

# Bytes outside the word class become spaces; A-Z become lower case.
_CLASS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
    for b in range(256)
)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_CLASS).split()


class _Powers:
    """Powers of the base and of its inverse, modulo 2 to the 64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            raise_by, lower_by = (np.uint64(pow(b, k, 1 << 64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
            self.up = np.concatenate([self.up, self.up * raise_by])
            self.down = np.concatenate([self.down, self.down * lower_by])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _hash_part(part: bytes, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(part, np.uint8)
    edge = np.diff((data != 32).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers.upto(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    stops = np.minimum(ends, starts + first) if first else ends
    hashes = (total[stops] - total[starts]) * down[starts]
    # Spread the bits: the index of a table is taken from the high ones.
    hashes = (hashes ^ (hashes >> np.uint64(29))) * _FACTOR
    return hashes ^ (hashes >> np.uint64(32)), starts, ends


def hash_words(text: bytes, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word between spaces; long texts go part by part.

    With ``first``, the hash is that of a word's first bytes.
    """
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            cut = text.rfind(b" ", at, at + PIECE)
            cut = cut if cut > at else text.find(b" ", at + PIECE)
            end = cut if cut > at else end
        hashes, starts, ends = _hash_part(text[at:end], first)
        out.append((hashes, starts + at, ends + at))
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


class Search:
    """Tables for all patterns of one length, in words."""

    def __init__(self, patterns: dict[bytes, list[str]], length: int):
        self.length = length
        self.block = min(2, length)
        self.most = length - self.block + 1
        self.patterns = patterns
        texts = list(patterns)
        hashes = hash_words(b" ".join(texts))[0].reshape(len(texts), length)
        self.shift = np.full(1 << _BITS, self.most, np.uint8)
        for end in range(self.block - 1, length):
            index = self._index(self._blocks(hashes, end))
            np.minimum.at(self.shift, index, np.uint8(length - 1 - end))
        keys = self._keys(self._blocks(hashes, length - 1), hashes[:, 0])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.buckets: dict[int, set[bytes]] = defaultdict(set)
        for key, i in zip(keys.tolist(), range(len(texts)), strict=True):
            self.buckets[key].add(texts[i])

    def _blocks(self, hashes: np.ndarray, end: int) -> np.ndarray:
        last = hashes[:, end]
        return last if self.block == 1 else hashes[:, end - 1] * _FACTOR + last

    @staticmethod
    def _index(blocks: np.ndarray) -> np.ndarray:
        mixed = (blocks ^ (blocks >> np.uint64(31))) * _FACTOR
        return (mixed >> np.uint64(64 - _BITS)).astype(np.int64)

    @staticmethod
    def _keys(suffix: np.ndarray, first: np.ndarray) -> np.ndarray:
        return suffix * _FACTOR ^ first

    def find(self, text: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """``(first word, last word, pattern)`` of every occurrence."""
        n = len(hashes)
        if n < self.length:
            return
        blocks = hashes.copy()
        if self.block == 2:
            blocks[1:] += hashes[:-1] * _FACTOR
        index = self._index(blocks)
        head = np.arange(self.length - 1, n, STRETCH)
        stop = np.minimum(head + STRETCH, n)
        hits = []
        while len(head):
            shift = self.shift[index[head]]
            hits.append(head[shift == 0])
            head = head + np.maximum(shift, 1)
            on = head < stop
            head, stop = head[on], stop[on]
        at = np.concatenate(hits)
        keys = self._keys(blocks[at], hashes[at - self.length + 1])
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[place] == keys
        for key, last in zip(keys[known].tolist(), at[known].tolist(), strict=True):
            first = last - self.length + 1
            words = b" ".join(text[starts[first] : ends[last]].split())
            if words in self.buckets[key]:
                yield first, last, words


def windows(text: bytes | None, size: int = WINDOW) -> list[bytes]:
    """The patterns of one item: ``size`` words in a row, or all of a shorter item."""
    parts = normal_words(text or b"")
    n = len(parts) - size + 1
    if not parts:
        return []
    return [b" ".join(parts[i : i + size]) for i in range(max(1, n))]


def _searches(items: list[tuple[str, bytes]], size: int) -> list[Search]:
    by_length: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        for pattern in set(windows(text, size)):
            by_length[pattern.count(b" ") + 1][pattern].append(item)
    return [Search(dict(p), length) for length, p in sorted(by_length.items())]


def _search_texts(searches: list[Search], texts: list[bytes]):
    """For each text its number of words, merged hit spans and items."""
    joined = b" ".join(_MARK + b" " + t.translate(_CLASS) for t in texts)
    hashes, starts, ends = hash_words(joined)
    data = np.frombuffer(joined, np.uint8)
    marks = np.flatnonzero(data[starts] == 0) if len(starts) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(marks, len(hashes))) - 1
    hit = np.zeros(len(hashes) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for search in searches:
        for first, last, pattern in search.find(joined, hashes, starts, ends):
            hit[first] += 1
            hit[last + 1] -= 1
            items[int(np.searchsorted(marks, first, side="right")) - 1].update(search.patterns[pattern])
    covered = (np.cumsum(hit[:-1]) > 0).astype(np.int8)
    out = []
    for i, (mark, size) in enumerate(zip(marks.tolist(), sizes.tolist(), strict=True)):
        spans: list[tuple[int, int]] = []
        if i in items:
            edge = np.diff(covered[mark + 1 : mark + 1 + size], prepend=0, append=0)
            spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((size, spans, sorted(items.get(i, ()))))
    return out


def _pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    piece: list[bytes] = []
    size = 0
    for text in texts:
        if piece and size + len(text) > PIECE:
            yield piece
            piece, size = [], 0
        piece.append(text)
        size += len(text)
    if piece:
        yield piece


_FOUND = "n_words long, spans array<struct<first:long,stop:long>>, items array<string>"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


def _pass(rows: DataFrame, keys: list[str], items: list[tuple[str, bytes]], size: int) -> DataFrame:
    """One pass over ``keys`` and ``__text`` with the patterns of ``items``."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = None
        for batch in batches:
            searches = _searches(shared.value, size) if searches is None else searches
            texts = batch.column(len(keys)).to_pylist()
            found = [r for piece in _pieces(texts) for r in _search_texts(searches, piece)]
            columns = [batch.column(i) for i in range(len(keys))]
            spans = [[{"first": a, "stop": b} for a, b in r[1]] for r in found]
            columns += [
                pa.array([r[0] for r in found], pa.int64()),
                pa.array(spans, _SPAN),
                pa.array([r[2] for r in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "n_words", "spans", "items"])

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "__text").mapInArrow(scan, f"{fields}, {_FOUND}")


def _merge(spans):
    """Spans without overlap, from any spans."""
    first = F.struct(F.lit(-1).cast("long").alias("stop"), F.lit(0).cast("long").alias("total"))

    def step(a, s):
        fresh = F.greatest(F.lit(0), s["stop"] - F.greatest(s["first"], a["stop"]))
        return F.struct(F.greatest(a["stop"], s["stop"]).alias("stop"), (a["total"] + fresh).alias("total"))

    return F.aggregate(F.sort_array(spans), first, step, lambda a: a["total"])


def _blocks_of(
    benchmark: DataFrame, item: str, item_text: str, block_bytes: int
) -> list[Callable[[], list[tuple[str, bytes]]]]:
    """Readers of the benchmark's items, each of about ``block_bytes`` at most."""
    tests = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
        binary_text(F.col(item_text)).alias("text"),
    )
    total = tests.agg(F.sum(F.length("text") + F.length("item"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))

    def reader(b: int) -> Callable[[], list[tuple[str, bytes]]]:
        mine = tests if n == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        return lambda: [(r["item"], bytes(r["text"])) for r in mine.collect()]

    return [reader(b) for b in range(n)]


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text holds no window of any item.

    Columns may have any names.
    """
    blocks = _blocks_of(benchmark, item, item_text, block_bytes)
    names = docs.columns
    at = names.index(text)
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # Arrow functions find columns by plain names
    for items in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(items())

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searches = None
            for batch in batches:
                searches = _searches(shared.value, size) if searches is None else searches
                texts = batch.column(batch.num_columns - 1).to_pylist()
                spans = [r[1] for piece in _pieces(texts) for r in _search_texts(searches, piece)]
                rows = batch.select(range(batch.num_columns - 1))
                yield rows.filter(pa.array([not s for s in spans], pa.bool_()))

        whole = docs.select("*", binary_text(F.col(f"c{at}")).alias("text"))
        docs = whole.mapInArrow(scan, docs.schema)
        if len(blocks) > 1:
            docs = written(docs, "clean")
    return docs.toDF(*names)


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id, n_words, n_hit, items)`` for every row of ``docs``.

    ``items`` are the ids, as sorted text, of the benchmark items with an occurring window; a null
    item id counts as the empty text; items of one id count once.  Null and empty texts have no
    words and no windows.  Without benchmark rows nothing is hit.
    """
    blocks = _blocks_of(benchmark, item, item_text, block_bytes)
    rows = docs.select(F.col(id_column).alias("id"), binary_text(F.col(text)).alias("__text"))
    if len(blocks) == 1:
        found = _pass(rows, ["id"], blocks[0](), size)
        return found.select("id", "n_words", _merge(F.col("spans")).alias("n_hit"), "items")

    # Equal rows have equal results: results are kept by id and content and joined to all rows.
    rows = rows.withColumn("__key", F.sha2("__text", 256))
    found = None
    for items in blocks:
        one = written(_pass(rows, ["id", "__key"], items(), size), "hits")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("id", "__key").agg(
        F.max("n_words").alias("n_words"),
        _merge(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    same = [rows["id"].eqNullSafe(merged["id"]), rows["__key"] == merged["__key"]]
    return rows.drop("__text").join(merged, same).select(
        rows["id"], "n_words", "n_hit", "items"
    )
