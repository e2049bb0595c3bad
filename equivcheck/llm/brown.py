"""Language model with Brown classes: class bigrams and word emissions.

1. Words of the training texts are counted (partial counts per task, one shuffle); the table of
   counts grows with the corpus and stays in the shared folder.
2. Training texts are read once more and kept as lists of *items* in the shared folder: the place of a
   word found ``ENOUGH`` times or more, or the pool of a rarer one, by the hash of its last three bytes, so
   that every word, also an unseen one, has a class.
3. Exchange clustering first settles a seed: the most frequent words and all other words by their pools,
   a matrix of fixed size, are moved one by one until nothing moves.  Then sweeps run over all items on
   the cluster: each is counted with the classes to its left and right, the counts are shuffled to their
   item, a row per item and task, and every item goes to the class where these neighbours make the class bigrams likeliest.  All
   move at once, so a sweep counts only if the likelihood has risen; sweeps go on until one raises it by
   less than ``RISE`` a token.
4. log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class), over all words and
   the end.  Emissions are (c + 0.5) / (N_class + 0.5 (V_class + 1)); transitions are drawn
   towards the classes' shares.

Scores need the count of every word.  Words above a count threshold go to the tasks (their number
is bounded by ``FREQUENT``, their length by ``LONGEST``); this also takes all hot words out of the
join.  The occurrences of the others are pooled per document, joined with the counts and summed.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equivcheck.llm.common import binary_text
from equivcheck.session import new_dir, remove, shuffle_partitions, written

CLASSES = 64
OWN = 512  # words that are units of their own in the seed
POOLS = 511  # items of rare and unseen words, by ending
ENOUGH = 8  # occurrences of a word that is an item of its own
RISE = 1e-3  # nats a token by which a sweep has to raise the likelihood
DENSE = 4096  # most frequent items that a task counts in an array
WAITING = 1_000_000  # counts that a task gathers before it sums them up
FREQUENT = 200_000  # words whose counts are sent to the tasks
LONGEST = 64  # bytes of a word that may be sent
HELD = 200_000  # different words a task holds before it passes their counts on
PULL = 10.0  # weight of the classes' shares in a transition
END = OWN + POOLS
SIDES = 2 * (CLASSES + 1)  # classes to the left, then classes to the right


def pool(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % POOLS


def _counts(texts: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(text.lower().split())
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    partial = texts.mapInArrow(scan, "word binary, c long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Frequent words with their place, item and count, in order of falling count.

    Items are the first ``own`` words, then the pools, then the end.
    """

    def __init__(self, words: list[bytes], counts: list[int]):
        self.place = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, np.int64)
        self.own = max(int((self.counts >= ENOUGH).sum()), min(OWN, len(words)))
        self.end = self.own + POOLS
        self.items = np.array([i if i < self.own else self.own + pool(w) for i, w in enumerate(words)], np.int32)

    def read(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places of the words (-1 if not frequent), items of the words, and the infrequent ones."""
        parts = text.lower().split()
        get = self.place.get
        at = np.fromiter(map(get, parts, itertools.repeat(-1)), np.int64, len(parts))
        items = self.items[at] if len(self.items) else np.zeros(len(at), np.int32)
        missing = np.flatnonzero(at < 0).tolist()
        others = [parts[i] for i in missing]
        if others:
            items[missing] = [self.own + pool(w) for w in others]
        return at, items, others

    def units(self) -> np.ndarray:
        """Unit of each item in the seed."""
        few = min(self.own, OWN)
        words = [i if i < few else OWN + pool(w) for w, i in self.place.items() if i < self.own]
        return np.array([*words, *range(OWN, END + 1)], np.int64)


def _frequent(counts: DataFrame, most: int) -> tuple[int, Vocabulary]:
    """The least count of a frequent word, and those words (in order of count, then bytes)."""
    usable = counts.where((F.length("word") <= LONGEST) & (F.col("c") > 1))
    band = F.floor(F.log2("c") * 16)
    bands = usable.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"))
    least, total = None, 0
    for row in sorted(bands.collect(), key=lambda r: -r["band"]):
        total += row["n"]
        if total > most:
            break
        least = row["least"]
    if least is None:
        return 1 << 62, Vocabulary([], [])
    rows = usable.where(F.col("c") >= least).toArrow().to_pandas()
    rows["word"] = rows["word"].map(bytes)
    rows = rows.sort_values(["c", "word"], ascending=[False, True])
    return least, Vocabulary(rows["word"].tolist(), rows["c"].tolist())


def _items(texts: DataFrame, shared) -> DataFrame:
    """The items of each text, in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            lists = [vocabulary.read(text)[1] for text in batch.column(0).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)])
            values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([column], ["items"])

    return texts.mapInArrow(scan, "items array<int>")


def _line(batch: pa.RecordBatch, end: int) -> np.ndarray:
    """All texts of a batch in one line, with the end before, between and behind them."""
    column = batch.column(0)
    ends = column.offsets.to_numpy()
    values = column.flatten().to_numpy()
    return np.append(np.insert(values.astype(np.int64), ends[:-1] - ends[0], end), end)


def _bigrams(items: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each unit follows each other one, over all texts."""
    size, end = END + 1, vocabulary.end
    shared = items.sparkSession.sparkContext.broadcast(vocabulary.units())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            units = shared.value[_line(batch, end)]
            table += np.bincount(units[:-1] * size + units[1:], minlength=size * size)
        found = np.flatnonzero(table)
        columns = [pa.array(found), pa.array(table[found])]
        yield pa.RecordBatch.from_arrays(columns, ["pair", "n"])

    rows = items.mapInArrow(scan, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    frame = rows.toArrow().to_pandas()
    table = np.zeros(size * size)
    table[frame["pair"].to_numpy(np.int64)] = frame["n"].to_numpy(float)
    return table.reshape(size, size)


def _lists(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts of codes in rising order as ``(item, side, n)``, a row per item."""
    items = codes // SIDES
    first = np.flatnonzero(np.diff(items, prepend=-1))
    ends = pa.array(np.append(first, len(codes)), pa.int32())
    sides, counts = pa.array(codes % SIDES, pa.int16()), pa.array(n, pa.int64())
    columns = [pa.array(items[first], pa.int32()), *(pa.ListArray.from_arrays(ends, x) for x in (sides, counts))]
    return pa.RecordBatch.from_arrays(columns, ["item", "side", "n"])


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of ``_lists``."""
    items, sides, n = batch.columns
    first = np.repeat(items.to_numpy().astype(np.int64) * SIDES, np.diff(sides.offsets.to_numpy()))
    return first + sides.flatten().to_numpy(), n.flatten().to_numpy()


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in rising order, with the sum of its counts."""
    codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(n[order], first) if len(first) else n


_BESIDE = "item int, side array<short>, n array<long>"


def _beside(items: DataFrame, end: int, group: np.ndarray) -> DataFrame:
    """``(item, side, n)``: how often an item has each class beside it; every item is one row.

    Sides are classes to the left, and ``CLASSES + 1`` more to the right.  The code of a count is
    ``item * SIDES + side``; from ``(end + 1) * SIDES`` on codes say how often a class follows another one.

    A task sends a row per item, not one per count, and the counts of an item meet in one task.
    """
    size = CLASSES + 1
    dense = min(DENSE, end + 1)
    kind = np.int32 if (end + 1 + size) * SIDES < 1 << 31 else np.int64
    shared = items.sparkSession.sparkContext.broadcast(group.astype(kind))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, between = np.zeros(dense * SIDES, np.int64), np.zeros(size * size, np.int64)
        for batch in batches:
            line = _line(batch, end).astype(kind)
            classes = shared.value[line]
            codes = np.concatenate([line[1:] * SIDES + classes[:-1], line[:-1] * SIDES + size + classes[1:]])
            low = codes < dense * SIDES
            often += np.bincount(codes[low], minlength=len(often))
            between += np.bincount(classes[:-1] * size + classes[1:], minlength=len(between))
            yield _lists(*np.unique(codes[~low], return_counts=True))
        for table, first in ((often, 0), (between, (end + 1) * SIDES)):
            found = np.flatnonzero(table)
            yield _lists(found + first, table[found])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
        for batch in batches:
            waiting.append(_codes(batch))
            if sum(len(n) for _, n in waiting) > max(WAITING, len(held[0])):
                held, waiting = _summed([held, *waiting]), []
        yield _lists(*_summed([held, *waiting]))

    spread = items.mapInArrow(scan, _BESIDE).repartition(shuffle_partitions(items.sparkSession), "item")
    return spread.mapInArrow(merge, _BESIDE)


def _moves(beside: DataFrame, end: int, table: np.ndarray) -> DataFrame:
    """``(item, class)``: the class where an item's neighbours make the class bigrams likeliest."""
    logs = np.log(table + 0.5)
    before = logs - np.log(table.sum(axis=0) + 0.5)  # by class to the left
    after = logs.T - np.log(table.sum(axis=1) + 0.5)  # by class to the right
    weights = np.concatenate([before, after])[:, :CLASSES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sides, n = batch.columns
            counts = np.zeros((len(items), SIDES))
            rows = np.repeat(np.arange(len(items)), np.diff(sides.offsets.to_numpy()))
            counts[rows, sides.flatten().to_numpy()] = n.flatten().to_numpy()
            best = np.argmax(counts @ weights, axis=1)
            yield pa.RecordBatch.from_arrays([items.cast(pa.int64()), pa.array(best, pa.int64())], ["item", "class"])

    return beside.where(F.col("item") < end).select("item", "side", "n").mapInArrow(scan, "item long, class long")


def _neighbours(items: DataFrame, end: int, group: np.ndarray) -> DataFrame:
    """What ``_beside`` counts as ``(code, n)``, a row per count."""
    counts = _beside(items, end, group).select("item", F.explode(F.arrays_zip("side", "n")).alias("x"))
    return counts.select((F.col("item").cast("long") * SIDES + F.col("x.side")).alias("code"), "x.n")


def _better(counts: DataFrame, end: int, table: np.ndarray) -> DataFrame:
    """``_moves`` of what ``_neighbours`` gives."""
    item = F.floor(F.col("code") / F.lit(SIDES)).cast("int")
    lists = counts.groupBy(item.alias("item")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("code") % SIDES).cast("short").alias("side"), "n"))).alias("x")
    )
    return _moves(lists.select("item", "x.side", "x.n"), end, table)


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of class bigrams per token, but for a constant of the words."""
    value = _xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum()
    return float(value / max(table.sum(), 1))


def sweep(items: DataFrame, end: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all items after the last sweep that raised the likelihood, and their bigrams."""
    spark = items.sparkSession
    kept: tuple[np.ndarray, np.ndarray] | None = None
    while True:
        path = new_dir(spark, "neighbours")
        _beside(items, end, group).write.parquet(path)
        counts = spark.read.schema(_BESIDE).parquet(path)
        table = np.zeros((CLASSES + 1) ** 2)
        for row in counts.where(F.col("item") > end).collect():  # the class bigrams
            table[(row["item"] - end - 1) * SIDES + np.array(row["side"])] = row["n"]
        table = table.reshape(CLASSES + 1, CLASSES + 1)
        rise = likelihood(table) - likelihood(kept[1]) if kept else np.inf
        if rise > 0:
            kept = group, table
        moved = kept[0].copy()
        if rise >= RISE:
            # as many rows as items, which FREQUENT bounds
            best = _moves(counts, end, table).toArrow().to_pandas()
            moved[best["item"].to_numpy(np.int64)] = best["class"].to_numpy(np.int64)
        remove(spark, path)
        if np.array_equal(moved, kept[0]):
            return kept
        group = moved


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int | None = None) -> np.ndarray:
    """Class of each unit.  The last unit, the end, has a class of its own that nothing joins.

    Units are visited by falling frequency; each goes to the class where the likelihood of the
    class bigrams is greatest, staying put on ties, until a round moves nothing (or after ``rounds``).
    """
    n = len(bigrams)
    order = np.argsort(-bigrams.sum(axis=1)[: n - 1], kind="stable")
    group = np.empty(n, np.int64)
    group[order] = np.arange(n - 1) % classes
    group[n - 1] = classes
    member = np.zeros((n, classes + 1))
    member[np.arange(n), group] = 1
    right, left = bigrams @ member, bigrams.T @ member  # counts of unit against class
    table = member.T @ right
    for _ in itertools.count() if rounds is None else range(rounds):
        moved = 0
        for u in order.tolist():
            own, twice = group[u], bigrams[u, u]
            r, l = right[u].copy(), left[u].copy()  # noqa: E741
            if not r.any() and not l.any():
                continue
            r[own] -= twice
            l[own] -= twice
            table[own] -= r
            table[:, own] -= l
            table[own, own] -= twice
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            gain = (_xlogx(table + r) - _xlogx(table)).sum(axis=1)
            gain += (_xlogx(table + l[:, None]) - _xlogx(table)).sum(axis=0)
            d = np.diag(table)
            rd, ld = r, l
            gain += _xlogx(d + rd + ld + twice) - _xlogx(d + rd) - _xlogx(d + ld) + _xlogx(d)
            gain -= _xlogx(rows + r.sum() + twice) - _xlogx(rows)
            gain -= _xlogx(cols + l.sum() + twice) - _xlogx(cols)
            best = int(np.argmax(gain[:classes]))
            best = best if gain[best] > gain[own] + 1e-9 else own
            table[best] += r
            table[:, best] += l
            table[best, best] += twice
            if best != own:
                moved += 1
                group[u] = best
                right[:, own] -= bigrams[:, u]
                right[:, best] += bigrams[:, u]
                left[:, own] -= bigrams[u]
                left[:, best] += bigrams[u]
        if not moved:
            break
    return group


def _item_sums(counts: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and different words of each item but the end."""
    own = vocabulary.own
    tokens, kinds = np.zeros(vocabulary.end + 1), np.zeros(vocabulary.end + 1)
    tokens[:own] = vocabulary.counts[:own]
    kinds[:own] = 1
    tail = F.when(F.length("word") > 3, F.expr("substring(word, length(word) - 2, 3)")).otherwise(F.col("word"))
    sums = counts.groupBy((F.crc32(tail) % POOLS).alias("pool")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")
    )
    for row in sums.collect():
        tokens[own + row["pool"]], kinds[own + row["pool"]] = row["c"], row["n"]
    for word, i in vocabulary.place.items():
        if i < own:
            tokens[own + pool(word)] -= vocabulary.counts[i]
            kinds[own + pool(word)] -= 1
    return tokens, kinds


def learn_classes(
    texts: DataFrame, counts: DataFrame, vocabulary: Vocabulary, shared
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each item, log10 of the transitions, log10 of the emissions' denominators by class."""
    items = written(_items(texts, shared), "items")
    seed = exchange(_bigrams(items, vocabulary))
    group, between = sweep(items, vocabulary.end, seed[vocabulary.units()])
    tokens, kinds = _item_sums(counts, vocabulary)
    share = (between.sum(axis=0) + 1) / (between.sum() + CLASSES + 1)
    moves = np.log10((between + PULL * share) / (between.sum(axis=1, keepdims=True) + PULL))

    def by_class(values: np.ndarray) -> np.ndarray:
        return np.bincount(group, weights=values, minlength=CLASSES + 1)

    return group, moves, np.log10(by_class(tokens) + 0.5 * (by_class(kinds) + 1))


def score(
    docs: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    frequent: int = FREQUENT,
) -> DataFrame:
    """``(id, *keep, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs``.

    Learns from the rows where ``learn`` holds.  Null and empty texts are one token, the end.
    ``base_score`` is the unigram score; with nothing learnt all counts are zero.
    """
    texts = docs.where(learn).select(binary_text(F.col(text)).alias("text"))
    counts = written(_counts(texts), "counts")
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    ends = texts.agg(F.count(F.lit(1))).first()[0]
    n, v = (total[0] or 0) + ends, total[1] + (ends > 0)
    least, vocabulary = _frequent(counts, frequent)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(vocabulary)
    model = context.broadcast(learn_classes(texts, counts, vocabulary, shared))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (groups, step, norm) = shared.value, model.value
        logs = np.log10(known.counts + 0.5) if len(known.counts) else np.zeros(1)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(batch.num_columns - 1).to_pylist():
                at, items, others = known.read(text)
                line = np.concatenate([[CLASSES], groups[items], [CLASSES]])
                there = at[at >= 0]
                row = (
                    len(at) + 1,
                    len(there),
                    float(logs[there].sum()),
                    float(step[line[:-1], line[1:]].sum() - norm[line[1:-1]].sum()),
                    [{"word": w, "n": k} for w, k in Counter(others).items()],
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds_of = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), _OTHERS]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True)]
            names = [*batch.schema.names[:-1], "n_tokens", "in_memory", "logs", "classes", "others"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names)

    rows = docs.select(F.col(id_column).alias("id"), *keep, binary_text(F.col(text)).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = T.StructType([*fields, *T.StructType.fromDDL(_PARTS).fields])
    parts = rows.mapInArrow(scan, schema).withColumn("__row", F.monotonically_increasing_id())
    parts = written(parts, "parts")

    # Only counts below the threshold can be needed here, or words too long to be sent.
    rest = counts.where((F.col("c") < least) | (F.length("word") > LONGEST))
    used = parts.select("__row", F.explode("others").alias("o")).select("__row", "o.word", "o.n")
    c = F.coalesce("c", F.lit(0))
    sums = (
        used.join(rest, "word", "left")
        .groupBy("__row")
        .agg(
            F.sum(F.col("n") * F.log10(c + 0.5)).alias("more_logs"),
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        )
    )
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = logs + float(np.log10(ends + 0.5)) - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    found = F.col("in_memory") + F.coalesce("more_known", F.lit(0)) + F.lit(int(ends > 0))
    return parts.drop("others").join(sums, "__row", "left").select(
        "id",
        *keep,
        "n_tokens",
        found.cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (logs + F.col("classes")).alias("score"),
    )


_OTHERS = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
_PARTS = (
    "n_tokens long, in_memory long, logs double, classes double, "
    "others array<struct<word:binary,n:long>>"
)
