"""Toxicity: a convolutional text classifier over hashed word embeddings, written in numpy.

A word (letters, digits and all beyond ASCII, A-Z lower-cased) has the sum of the hashed vectors of
its whole, its first six and its first three bytes, as far as the sample knows them: a tag per hash
row tells words apart that share a row, so unknown words have no vector.
Filters of several widths slide over the whole text, each keeps its greatest value, and a logistic
layer weighs them.  Trained by AdaGrad on a bounded sample of labelled rows: at most ``MAX_TOXIC``
toxic and ``MAX_CLEAN`` other rows and about ``MAX_BYTES`` of text, drawn by the hash of their id from
all that may be learnt from, of texts of at most ``MAX_CHARS`` characters.

Every row is scored once, whole texts of any length, and what the model said of it (language, score bin,
logit) is kept in the shared folder.  Thresholds are calibrated by language on all rows that may be learnt
from: those of the sample by models that were trained without them (``FOLDS`` parts), the others by the
kept rows, joined with their labels; what is collected are counts by language, score bin and label.  A language
gets the cut with the fewest errors among its own rows and those of all languages, the latter scaled to
``PRIOR`` toxic rows: few rows stay near the common cut, many decide for themselves.  Scores are
shifted so that 0.5 is that cut.  The language is worked out from the words of the text alone (naive
Bayes over the same hashes); the ``LANGUAGES`` most frequent of the sample are told apart, texts in
others are calibrated with the language they look most like.

Texts are never shuffled: joins see ids, sizes and what the model said.  The model (some 50 MB at most)
and the ids of the sample are broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck.llm.common import binary_text
from equivcheck.llm.decontaminate import _CLASS, hash_words
from equivcheck.session import written

MAX_TOXIC, MAX_CLEAN, MAX_CHARS, MAX_BYTES = 2_000, 4_000, 20_000, 24_000_000
FOLDS, PRIOR, LANGUAGES = 3, 20, 64
STEPS, LIMIT = 16, 30  # score bins per unit of the logit, and where it is cut off
BITS, SIZE = 18, 8  # hashed rows of each table, numbers per vector
PARTS = (0, 6, 3)  # bytes of a word that a table looks at; 0: all
WIDTHS, FILTERS = (1, 2, 3), 8
SUPPORT = 3  # texts of the sample that must hold a word, or it has no vector
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.1, 9
LANGUAGE_BITS = 16
PIECE = 1 << 20
PAD = max(WIDTHS) - 1


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per table and word, words of all texts in a row with gaps of ``PAD``; first places.

    Gaps have hash 0.  A text without words is one gap more.
    """
    gap = b" \x00" * PAD + b" "
    parts = [(t.translate(_CLASS).strip() or b"\x00") + gap for t in texts]
    joined = b"".join(parts)
    found = [hash_words(joined, first) for first in PARTS]
    starts = found[0][1]
    void = np.frombuffer(joined, np.uint8)[starts] == 0
    hashes = np.where(void, np.uint64(0), np.stack([f[0] for f in found]))
    edges = np.cumsum([0] + [len(p) for p in parts])
    return hashes, np.searchsorted(starts, edges)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _tag(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


@dataclass
class Model:
    tables: np.ndarray  # (tables, 2^BITS, SIZE); row 0 is zero
    filters: list[np.ndarray]  # per width (width, SIZE, FILTERS)
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    tags: np.ndarray  # (tables, 2^BITS), of the words that the sample holds often enough
    languages: np.ndarray | None = None  # (2^LANGUAGE_BITS, languages), log shares

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Row in each table; row 0 for gaps and for what the sample does not know."""
        rows = _bucket(hashes)
        own = np.stack([tags[row] for tags, row in zip(self.tags, rows, strict=True)])
        return np.where((own == _tag(hashes)) & (hashes != 0), rows, 0)

    def forward(self, ids: np.ndarray, first: np.ndarray):
        vectors = sum(table[row] for table, row in zip(self.tables, ids, strict=True))
        rows = [np.arange(a, b - PAD) for a, b in zip(first[:-1], first[1:], strict=True)]
        places = np.concatenate(rows)
        begin = np.cumsum([0] + [len(r) for r in rows[:-1]])
        tops, values = [], []
        for w, bank, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            out = vectors @ bank[0]
            for k in range(1, w):
                out[:-k] += vectors[k:] @ bank[k]
            out = out[places] + bias
            values.append(out)
            tops.append(np.maximum.reduceat(out, begin, axis=0))
        features = np.maximum(np.concatenate(tops, axis=1), 0)
        return vectors, places, begin, values, tops, features

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(ids, first)[-1] @ self.weight + self.offset

    def groups(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The language each text looks most like."""
        shares = self.languages[ids[0] & ((1 << LANGUAGE_BITS) - 1)]
        shares[ids[0] == 0] = 0
        return np.add.reduceat(shares, first[:-1], axis=0).argmax(axis=1)

    def judged(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and logit of each text."""
        ids = self.known(hashes)
        return self.groups(ids, first), self.logits(ids, first)


def _begin(hashes: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Model:
    """Small random vectors for words of the sample; the first number says how toxic a word looks."""
    draw = np.random.default_rng(SEED)
    tables = np.zeros((len(PARTS), 1 << BITS, SIZE), np.float32)
    tags = np.zeros((len(PARTS), 1 << BITS), np.uint32)
    text = np.repeat(np.arange(len(labels)), np.diff(first))
    positives = max(1, labels.sum())
    for t in range(len(PARTS)):
        known, number = np.unique(hashes[t], return_inverse=True)
        pairs = np.unique(text * len(known) + number)
        word, toxic = pairs % len(known), labels[pairs // len(known)] > 0
        with_toxic = np.bincount(word[toxic], minlength=len(known))
        total = np.bincount(word, minlength=len(known))
        often = np.flatnonzero((total >= SUPPORT) & (known != 0))
        # Of words that share a row the most frequent one has it.
        often = often[np.argsort(total[often], kind="stable")]
        rows = _bucket(known[often])
        odds = np.log((with_toxic[often] + 1) / (positives + 2)) - np.log(
            (total[often] - with_toxic[often] + 1) / (max(1, len(labels) - positives) + 2)
        )
        odds *= np.minimum(1, total[often] / 10)  # words seen a few times say little
        tags[t][rows] = _tag(known[often])
        tables[t][rows] = draw.normal(0, 0.05, (len(rows), SIZE))
        tables[t][rows, 0] = odds / 2
        tables[t][0], tags[t][0] = 0, 0
    filters = [draw.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for bank in filters:
        bank[:, 0, : FILTERS // 2] = np.abs(bank[:, 0, : FILTERS // 2]) + 0.3
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weight = draw.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    return Model(tables, filters, bias, weight, 0.0, tags)


def _batch(ids: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = [np.arange(first[i], first[i + 1]) for i in which]
    return ids[:, np.concatenate(rows)], np.cumsum([0] + [len(r) for r in rows])


def train(hashes: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Model:
    """Gradients reach the words through the places where a filter was greatest."""
    model = _begin(hashes, first, labels)
    ids = model.known(hashes)
    draw = np.random.default_rng(SEED)
    seen = {}

    def step(name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        past = seen.setdefault(name, np.full(value.shape, 1e-4, np.float32))
        past += gradient**2
        value -= RATE * gradient / np.sqrt(past)

    squares = np.full((len(PARTS), 1 << BITS), 1e-2, np.float32)
    for _ in range(EPOCHS):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            which = order[at : at + BATCH]
            own, begin_at = _batch(ids, first, which)
            vectors, places, begin, values, tops, features = model.forward(own, begin_at)
            chance = 1 / (1 + np.exp(-np.clip(features @ model.weight + model.offset, -30, 30)))
            error = ((chance - labels[which]) * weights[which]).astype(np.float32)
            error /= max(1e-6, weights[which].sum())
            back = np.outer(error, model.weight) * (features > 0)
            step("weight", model.weight, features.T @ error)
            model.offset -= RATE * float(error.sum())
            spread = np.zeros_like(vectors)
            sizes = np.diff(np.append(begin, len(places)))
            for i, w in enumerate(WIDTHS):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                best = np.empty((len(which), FILTERS), np.int64)
                top = np.repeat(tops[i], sizes, axis=0)
                for f in range(FILTERS):
                    same = np.flatnonzero(values[i][:, f] >= top[:, f])
                    best[:, f] = same[np.searchsorted(same, begin)]
                spots = places[best]
                bank = model.filters[i]
                grown = np.zeros_like(bank)
                for k in range(w):
                    grown[k] = np.einsum("dfe,df->ef", vectors[spots + k], part)
                    np.add.at(spread, spots + k, part[:, :, None] * bank[k].T[None])
                step(f"filter{i}", bank, grown)
                step(f"bias{i}", model.bias[i], part.sum(axis=0))
            moved = np.flatnonzero(np.abs(spread).sum(axis=1) > 0)
            for t in range(len(PARTS)):
                rows, where = np.unique(own[t][moved], return_inverse=True)
                total = np.zeros((len(rows), SIZE), np.float32)
                np.add.at(total, where, spread[moved])
                total[rows == 0] = 0
                squares[t][rows] += (total**2).sum(axis=1)
                model.tables[t][rows] -= RATE / 2 * total / np.sqrt(squares[t][rows])[:, None]
    return model


def learn_languages(model: Model, hashes: np.ndarray, first: np.ndarray, langs: list) -> None:
    """Log shares of the hashed words of each language."""
    seen = Counter(x for x in langs if x is not None)
    names = sorted(sorted(seen, key=lambda x: (-seen[x], x))[:LANGUAGES]) or [""]
    place = {x: i for i, x in enumerate(names)}
    number = np.array([place.get(x, -1) for x in langs])
    ids = model.known(hashes)[0]
    text = np.repeat(np.arange(len(langs)), np.diff(first))
    shares = np.full((1 << LANGUAGE_BITS, len(names)), 0.1)
    good = (ids > 0) & (number[text] >= 0)
    np.add.at(shares, (ids[good] & ((1 << LANGUAGE_BITS) - 1), number[text][good]), 1)
    model.languages = np.log(shares / shares.sum(axis=0)).astype(np.float32)


def score_bin(logits: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(logits, -LIMIT, LIMIT) + LIMIT) * STEPS).astype(np.int64)


def cuts_of(counts: np.ndarray) -> list[float]:
    """A cut per language from ``counts`` by language, score bin and label."""
    common = counts.sum(axis=0)
    counts = counts + common * (PRIOR / max(1, common[:, 1].sum()))
    none = np.zeros((len(counts), 1))
    # Cutting in front of a bin: toxic rows below it are missed, others from it on are false alarms.
    missed = np.concatenate([none, counts[:, :, 1].cumsum(axis=1)], axis=1)
    alarms = np.concatenate([none, counts[:, :, 0].cumsum(axis=1)], axis=1)
    errors = missed + alarms[:, -1:] - alarms
    cuts = []
    for row in errors:
        least = np.flatnonzero(row <= row.min() + 1e-9)
        cuts.append(float(least[len(least) // 2] / STEPS - LIMIT))
    return cuts


def _apart(hashes: np.ndarray, first: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logits of the sample's rows, each by a model that was trained without it.

    Each kind must have a row for every part.
    """
    fold = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % FOLDS
    out = np.empty(len(y))
    for f in range(FOLDS):
        rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        trained = train(*_batch(hashes, first, rest), y[rest], weights[rest])
        for a in range(0, len(own), 256):
            part, begin = _batch(hashes, first, own[a : a + 256])
            out[own[a : a + 256]] = trained.logits(trained.known(part), begin)
    return out


def _named(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def _short(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) <= MAX_CHARS


def _marks(labels: DataFrame, learn: Column, id_column: str) -> DataFrame:
    """``(id, y)`` of the labels that may be used.  An id with labels of both kinds says nothing."""
    marks = labels.where(learn & F.col("toxic").isin(0, 1)).select(_named(labels, id_column).alias("id"), F.col("toxic").cast("int").alias("y"))
    return marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")


def fit(
    docs: DataFrame,
    marks: DataFrame,
    id_column: str = "doc_id",
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
    text: str = "text",
    lang: str = "lang",
) -> tuple[Model, Column, np.ndarray] | None:
    """The model, which labelled rows ``(id, y, short)`` are its sample, and the sample's counts by
    language, score bin and label; or nothing if the labels do not hold both kinds.

    ``docs`` may lack the column ``lang``: all texts are one language then.
    """
    whole = _named(docs, text)
    own = _named(docs, id_column).alias("id")
    size = F.octet_length(F.coalesce(whole, F.lit("")))
    labelled = written(docs.select(own, size.alias("size"), _short(whole).alias("short")).join(marks, "id"), "labelled")
    sizes = labelled.where("short").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    totals = {r["y"]: (r["n"], r["size"]) for r in sizes.collect()}
    if len(totals) < 2:
        return None
    drawn = F.lit(False)
    for y, most in ((1, max_toxic), (0, max_clean)):
        n, size = totals[y]
        room = MAX_BYTES * most / (max_toxic + max_clean)
        share = 1_000_000 if n <= most and size <= room else int(min(most / n, room / size, 1) * 900_000) + 1
        drawn = drawn | ((F.col("y") == y) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share))
    drawn = drawn & F.col("short")
    sample = labelled.where(drawn).select("id", "y").distinct()  # about max_toxic + max_clean at most
    known = _named(docs, lang) if lang in docs.columns else F.lit(None)
    texts = docs.where(_short(whole)).select(own, known.cast("string").alias("lang"), binary_text(whole).alias("whole"))
    got = texts.join(F.broadcast(sample), "id").select("id", "y", "lang", "whole")
    table = got.toArrow().sort_by([("id", "ascending"), ("whole", "ascending")]).to_pydict()
    y = np.array(table["y"], np.int64)
    kinds = {k: int((y == k).sum()) for k in (0, 1)}
    if not kinds[0] or not kinds[1]:
        return None
    hashes, first = word_hashes(table["whole"])
    # Training sees both kinds alike; calibration sees them as often as they come.
    alike = np.where(y == 1, len(y) / kinds[1], len(y) / kinds[0]).astype(np.float32)
    apart = _apart(hashes, first, y, alike) if min(kinds.values()) >= FOLDS else None
    model = train(hashes, first, y, alike)
    learn_languages(model, hashes, first, table["lang"])
    pieces = [_batch(hashes, first, np.arange(a, min(a + 256, len(y)))) for a in range(0, len(y), 256)]
    judged = [model.judged(*piece) for piece in pieces]
    groups = np.concatenate([g for g, _ in judged])
    logits = np.concatenate([x for _, x in judged]) if apart is None else apart
    counts = np.zeros((model.languages.shape[1], 2 * LIMIT * STEPS + 1, 2))
    np.add.at(counts, (groups, score_bin(logits), y), 1)
    return model, drawn, counts


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


def _said(rows: DataFrame, shared) -> DataFrame:
    """All columns of ``rows`` but the last, the text, and its language, score bin and logit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.judged(*word_hashes(piece)) for piece in _pieces(batch.columns[-1].to_pylist())]
            if not found:
                continue
            groups, logits = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = [pa.array(groups, pa.int32()), pa.array(score_bin(logits), pa.int32()), pa.array(logits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "g", "b", "logit"])

    said = T.StructType.fromDDL("g int, b int, logit double")
    return rows.mapInArrow(scan, T.StructType([*rows.schema.fields[:-1], *said.fields]))


def score(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
    lang: str = "lang",
) -> DataFrame:
    """``(id, *keep, score, predicted)`` of every row; ``learn`` says which labels may be used.

    ``docs`` may have further columns of any name, and none ``lang``.

    Null and empty texts get the score of a text without words.  Rows repeat as they come in.
    Without labels of both kinds every score is 0.
    """
    marks = _marks(labels, learn, id_column)
    fitted = fit(docs, marks, id_column, max_toxic, max_clean, text, lang)
    kept = [_named(docs, name).alias(f"keep{i}") for i, name in enumerate(keep)]
    names = ["id", *keep, "score", "predicted"]
    rows = docs.select(_named(docs, id_column).alias("id"), *kept, _short(_named(docs, text)).alias("short"), binary_text(_named(docs, text)))
    own = ["id", *[f"keep{i}" for i in range(len(keep))]]
    if fitted is None:
        return rows.select(*own, F.lit(0.0), F.lit(0)).toDF(*names)
    model, drawn, counts = fitted
    said = written(_said(rows, docs.sparkSession.sparkContext.broadcast(model)), "said")
    rest = said.select("id", "short", "g", "b").join(marks, "id").where(~drawn)
    for r in rest.groupBy("g", "b", "y").agg(F.count(F.lit(1)).alias("n")).collect():  # at most languages x bins x 2
        counts[r.g, r.b, r.y] += r.n
    cut = F.element_at(F.array(*[F.lit(x) for x in cuts_of(counts)]), F.col("g") + 1)
    logit = F.greatest(F.least(F.col("logit") - cut, F.lit(30.0)), F.lit(-30.0))
    found = said.select(*own, (1 / (1 + F.exp(-logit))).alias("score"))
    return found.select(*own, "score", (F.col("score") >= 0.5).cast("int")).toDF(*names)
