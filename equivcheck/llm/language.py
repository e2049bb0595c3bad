"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is the product of its letters' vectors,
shifted by their place (binding); a document is the sum of its trigrams (bundling); a language is
the sum of its documents' unit vectors.  A document gets the language with the greatest cosine.

Letters are lower-cased; all else is a space, so trigrams also see where words begin and end.  The
prototypes are sums over all labelled rows; they are whole numbers and do not depend on order.  Only
the prototypes (languages x ``DIMENSION`` numbers) pass through the driver.  Scoring is row by row, and
memory is bounded by the texts and trigrams that are worked on together, in any script.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck.llm.common import binary_text

DIMENSION = 1024
LETTERS = 128  # slots; a-z have their own, other letters share the rest by their code
SEED = 20
PIECE, TEXTS = 500_000, 256  # bytes and texts worked on together
GRAMS = 4_096  # trigrams bundled at a time
_UNIT = 1 << 20  # scale of unit vectors when they are summed as whole numbers


def _letter_slots() -> np.ndarray:
    """Slot of each code point of the basic plane: 0 for what is no letter."""
    slots = np.zeros(1 << 16, np.int64)
    for code in range(1 << 16):
        if chr(code).isalpha():
            slots[code] = _slot(code)
    return slots


def _slot(code: int) -> int:
    return code - 96 if 97 <= code <= 122 else 27 + code * 40503 % (LETTERS - 27)


class Space:
    """Letter vectors and the trigram counts of texts."""

    def __init__(self, dimension: int = DIMENSION, seed: int = SEED):
        draw = np.random.default_rng(seed)
        letters = draw.integers(0, 2, (LETTERS, dimension), dtype=np.int8) * 2 - 1
        self.places = [np.roll(letters, shift, axis=1) for shift in (2, 1, 0)]
        self.slots = _letter_slots()

    def _codes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        far = codes >= (1 << 16)
        slots = self.slots[np.where(far, 0, codes)]
        for at in np.flatnonzero(far).tolist():
            slots[at] = _slot(int(codes[at])) if chr(codes[at]).isalpha() else 0
        return slots

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One row per text: the bundle of its trigrams (zeros without letters)."""
        parts = [np.concatenate([[0], self._codes(t), [0, 0]]) for t in texts]
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        slots = np.concatenate(parts)
        a, b, c = slots[:-2], slots[1:-1], slots[2:]
        # A trigram has its middle in a word; the last two places of a text are spaces.
        good = b > 0
        gram = ((a * LETTERS + b) * LETTERS + c)[good]
        pairs, times = np.unique(row[1:-1][good] * LETTERS**3 + gram, return_counts=True)
        grams, place = np.unique(pairs % LETTERS**3, return_inverse=True)
        first, second, third = self.places
        out = np.zeros((len(texts), first.shape[1]), np.float32)
        order = np.argsort(place, kind="stable")
        row_of, times, place = (pairs // LETTERS**3)[order], times[order], place[order]
        # So many trigrams at a time: neither their vectors nor their counts grow with the script.
        for low in range(0, len(grams), GRAMS):
            some = grams[low : low + GRAMS]
            a, b = np.searchsorted(place, (low, low + GRAMS))
            counts = np.zeros((len(texts), len(some)), np.float32)
            counts[row_of[a:b], place[a:b] - low] = times[a:b]
            bound = first[some // LETTERS**2] * second[some // LETTERS % LETTERS] * third[some % LETTERS]
            out += counts @ bound.astype(np.float32)
        return out


def _pieces(texts: list[bytes]) -> Iterator[list[str]]:
    piece: list[str] = []
    size = 0
    for text in texts:
        if piece and (size + len(text) > PIECE or len(piece) == TEXTS):
            yield piece
            piece, size = [], 0
        piece.append(text.decode("utf-8", "replace"))
        size += len(text)
    if piece:
        yield piece


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return vectors / np.where(length > 0, length, 1)


def fit(rows: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes: the sums over all rows with a language."""
    known = rows.where(F.col(f"`{lang}`").isNotNull())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(), {}
        for batch in batches:
            langs, at = batch.column(1).to_pylist(), 0
            for piece in _pieces(batch.column(0).to_pylist()):
                units = np.rint(_unit(space.vectors(piece)) * _UNIT).astype(np.int64)
                for name, vector in zip(langs[at : at + len(piece)], units, strict=True):
                    sums[name] = sums.get(name, 0) + vector
                at += len(piece)
        for name, vector in sums.items():
            columns = [pa.array([name] * len(vector)), pa.array(range(len(vector)), pa.int32()), pa.array(vector)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "value"])

    narrow = known.select(binary_text(F.col(f"`{text}`")).alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    sums = narrow.mapInArrow(scan, "lang string, place int, value long")
    found = sums.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    frame = found.toArrow().to_pandas()
    names = sorted(frame["lang"].unique())
    prototypes = np.zeros((len(names), DIMENSION))
    where = {name: i for i, name in enumerate(names)}
    prototypes[frame["lang"].map(where).to_numpy(int), frame["place"].to_numpy(int)] = frame["value"]
    return names, _unit(prototypes)


def predict(
    docs: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, *keep, lang_pred, score)`` of every row, learnt from the rows where ``learn`` holds.

    The score is the cosine, 0 where it is negative.  Equal cosines go to the first language by
    name.  Null texts, texts without letters and all texts when nothing could be learnt are ``und``
    with score 0.  Repeated rows come out as often as they come in, an empty table gives no rows, and
    columns that are not named have no influence.
    """
    names, prototypes = fit(docs.where(learn), text, lang)
    held = prototypes.astype(np.float32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        for batch in batches:
            out, scores = [], []
            for piece in _pieces(batch.column(batch.num_columns - 1).to_pylist()):
                vectors = space.vectors(piece)
                blank = ~vectors.any(axis=1)
                if not names:
                    out += ["und"] * len(piece)
                    scores += [0.0] * len(piece)
                    continue
                cosine = (_unit(vectors) @ held.T).astype(np.float64)
                best = cosine.argmax(axis=1)
                top = np.clip(cosine[np.arange(len(piece)), best], 0, 1)
                out += ["und" if b else names[i] for b, i in zip(blank, best, strict=True)]
                scores += np.where(blank, 0.0, top).tolist()
            columns = [*batch.columns[:-1], pa.array(out, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), *keep, binary_text(F.col(f"`{text}`")).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = T.StructType(
        [*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return rows.mapInArrow(scan, schema)
