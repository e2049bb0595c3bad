"""Byte-level BPE by replaying the merges over all words of a slice of the corpus at once.

A text is cut into words by a pattern; a word's tokens depend on the word alone.  Each task takes its
texts in slices of ``SLICE`` words, gathers the distinct words that it has not met yet, lays their bytes into one chain and keeps an inverted
index: for each merge, the places of the chain where its pair stands.  Merges are taken by rank; at
each place only the two neighbours are touched, which puts their new pairs into the index.  So a
merge costs as much as it has places, not a pass over the corpus, and a word is worked out once, not
once per occurrence.

Words with their ids are remembered up to ``MEMORY`` bytes a task, so memory is bounded for any text;
no row is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivcheck.llm.common import binary_text

MEMORY = 96 * 1024 * 1024  # of remembered words, by a rough count
SLICE = 1 << 17  # words that are held at a time
_OVERHEAD = 200  # bytes that a remembered word takes besides its letters and ids


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a token in base 64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Merges:
    """A vocabulary: tokens by rank, and the merge of two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._base = max(ranks.values()) + 1
        self._single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        both = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self._bytes = np.array(both, np.int64)
        # Ranks of the pairs met so far, by a * base + b; those that are no token have -1.
        one = self._single.tolist()
        self._pairs = {one[k >> 8] * self._base + one[k & 255]: rank for k, rank in enumerate(both)}

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed.  A word that is a token is that token, however its merges go."""
        out = [b""] * len(words)
        longer = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is None:
                longer.append(i)
            else:
                out[i] = whole.to_bytes(4, "little")
        chain, ends = self._replayed([words[i] for i in longer])
        standing = chain >= 0
        packed = chain[standing].astype("<u4").tobytes()
        upto = (4 * np.concatenate([[0], np.cumsum(standing)])[ends]).tolist()
        start = 0
        for i, end in zip(longer, upto, strict=True):
            out[i] = packed[start:end]
            start = end
        return out

    def _places(self, raw: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """The inverted index of the bytes: by rank, the rising places where such a pair stands."""
        ranks = self._bytes[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        ranks[ends[:-1] - 1] = -1
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        found, first = np.unique(ranks[order], return_index=True)
        lists = np.split(order, first[1:])
        return {rank: places.tolist() for rank, places in zip(found.tolist(), lists, strict=False)}

    def _replayed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The chain of all words after all merges, and where words end; swallowed places hold -1."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        raw = np.frombuffer(b"".join(words), np.uint8)
        if len(raw) < 2:
            return self._single[raw], ends
        index = self._places(raw, ends)
        ids = self._single[raw].tolist()
        size, base, tokens, pairs, ranks = len(ids), self._base, self.tokens, self._pairs, self.ranks
        # Neighbours of a place; -1 at the ends of words.
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        after, before = after.tolist(), before.tolist()
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank)
            places.sort()
            for done, at in enumerate(places, 1):
                right, left = after[at], ids[at]
                # Places whose pair is gone by now stay in the index; they are passed over.
                if left < 0 or right < 0 or pairs.get(left * base + ids[right]) != rank:
                    continue
                ids[at], ids[right] = rank, -1
                far, near = after[right], before[at]
                after[at] = far
                least = base
                if far >= 0:
                    before[far] = at
                    key = rank * base + ids[far]
                    new = pairs.get(key)
                    if new is None:
                        new = pairs[key] = ranks.get(tokens[rank] + tokens[ids[far]], -1)
                    if new >= 0:
                        least = new
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(queue, new)
                if near >= 0:
                    key = ids[near] * base + rank
                    new = pairs.get(key)
                    if new is None:
                        new = pairs[key] = ranks.get(tokens[ids[near]] + tokens[rank], -1)
                    if new >= 0:
                        if new < least:
                            least = new
                        if new in index:
                            index[new].append(near)
                        else:
                            index[new] = [near]
                            heapq.heappush(queue, new)
                if least <= rank and done < len(places):
                    # A merge that goes before the next place of this one has become possible.
                    if rank in index:
                        index[rank].extend(places[done:])
                    else:
                        index[rank] = places[done:]
                        heapq.heappush(queue, rank)
                    break
        return np.array(ids, np.int64), ends


class Encoder:
    """Encodes texts with the words it remembers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY):
        self.merges = Merges(ranks)
        self.pattern = regex.compile(pattern)
        self.memory = memory
        self._known: dict[str, bytes] = {}
        self._held = 0

    def _learn(self, slices: list[list[str]]) -> None:
        """Replays the merges over the words of these slices that are not known yet."""
        if self._held > self.memory:
            self._known, self._held = {}, 0
        known = self._known
        new = list({w for words in slices for w in words if w not in known})
        ids = self.merges.encode([w.encode() for w in new])
        known.update(zip(new, ids, strict=True))
        self._held += sum(map(len, new)) + sum(map(len, ids)) + _OVERHEAD * len(new)

    def _slices(self, texts: Iterable[str]) -> Iterator[tuple[list[str], bool]]:
        """The words of texts in slices, and whether a slice ends its text."""
        for text in texts:
            found = map(methodcaller("group"), self.pattern.finditer(text))
            words = list(islice(found, SLICE))
            while len(words) == SLICE:
                yield words, False
                words = list(islice(found, SLICE))
            yield words, True

    def packed(self, texts: Iterable[str]) -> Iterator[tuple[bytes, bool]]:
        """Ids of texts as little-endian 32-bit numbers, in parts; the flag marks a text's last part."""
        held, n = [], 0
        for words, last in self._slices(texts):
            held.append((words, last))
            n += len(words)
            if n >= SLICE:
                yield from self._flushed(held)
                held, n = [], 0
        yield from self._flushed(held)

    def _flushed(self, held: list[tuple[list[str], bool]]) -> Iterator[tuple[bytes, bool]]:
        self._learn([words for words, _ in held])
        for words, last in held:
            yield b"".join(map(self._known.__getitem__, words)), last

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(part for part, _ in self.packed([text])), "<u4").tolist()

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        return b"".join(map(self.merges.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _columns(encoder: Encoder, texts: Iterable[bytes], ids: bool) -> dict[str, pa.Array]:
    n_tokens, lists, id_digests, text_digests = [], [], [], []
    n, held, of_ids, of_text = 0, [], hashlib.sha256(), hashlib.sha256()
    for packed, last in encoder.packed(raw.decode("utf-8", "replace") for raw in texts):
        n += len(packed) // 4
        if ids:
            held.append(packed)
        else:
            of_ids.update(packed)
            of_text.update(encoder.decode(packed))
        if not last:
            continue
        n_tokens.append(n)
        if ids:
            lists.append(np.frombuffer(b"".join(held), "<u4").astype(np.int64))
        else:
            id_digests.append(of_ids.hexdigest())
            text_digests.append(of_text.hexdigest())
        n, held, of_ids, of_text = 0, [], hashlib.sha256(), hashlib.sha256()
    made = {"n_tokens": pa.array(n_tokens, pa.int64())}
    if ids:
        return made | {"ids": pa.array(lists, pa.list_(pa.int64()))}
    more = {"ids_sha256": id_digests, "decoded_sha256": text_digests}
    return made | {k: pa.array(v, pa.string()) for k, v in more.items()}


def _mapped(docs: DataFrame, path: str, pattern: str, id_column: str, text: str, ids: bool, memory: int) -> DataFrame:
    # The vocabulary is a file of fixed size; its tokens travel with the function.
    ranks = read_ranks(path)
    name = docs.schema[id_column].dataType.simpleString()
    shape = "ids array<long>" if ids else "ids_sha256 string, decoded_sha256 string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern, memory)
        for batch in batches:
            made = _columns(encoder, (x.as_py() for x in batch.column(1)), ids)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), **made})

    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), binary_text(F.col(f"`{text}`")).alias("text"))
    return narrow.mapInArrow(scan, f"id {name}, n_tokens long, {shape}")


def encode(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text", memory: int = MEMORY
) -> DataFrame:
    """``(id, n_tokens, ids)`` of every row: the tokens of its whole text, without special tokens.

    ``path`` is a rank file that holds all 256 bytes, ``pattern`` cuts texts into words.  Null and
    empty texts have no tokens.  Repeated rows come out as often as they come in, an empty table gives
    no rows, other columns have no influence.  A text of any length is read in pieces.
    """
    return _mapped(docs, path, pattern, id_column, text, True, memory)


def digests(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text", memory: int = MEMORY
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: as ``encode``, with digests in place of ids.

    Ids are hashed as little-endian 32-bit numbers, and the bytes that they decode to.
    """
    return _mapped(docs, path, pattern, id_column, text, False, memory)


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text of the tokens in ``ids``; null ids give null.

    An id that the vocabulary lacks fails the query; bytes that are no UTF-8 become U+FFFD.
    """
    tokens = {rank: token for token, rank in read_ranks(path).items()}
    kept = [c for c in rows.columns if c != to]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            made = [None if x is None else b"".join(map(tokens.__getitem__, x)).decode("utf-8", "replace") for x in lists]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.string())], [*kept, to])

    whole = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").cast("array<long>").alias(to))
    schema = rows.select(*[F.col(f"`{c}`") for c in kept]).schema.add(to, "string")
    return whole.mapInArrow(scan, schema)
