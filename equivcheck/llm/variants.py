"""Spelling variants: words one edit apart, found with an index of grams of variable length.

*Dictionary.*  Words stand between two marks.  All pairs of characters are grams; a longer gram is
one if it occurs at least ``threshold`` times in the list of words.  Frequent short grams are thereby
covered by longer ones, and rare long ones do not swell the dictionary: at most ``1 / threshold`` of all
places can hold a gram of a given length that is kept, which bounds its size.

*Decomposition.*  At each place of a word the longest gram of the dictionary is taken, unless an
earlier one reaches as far.

*Affected grams.*  An edit changes the grams that it touches.  A gram before it can only change
if characters up to the edit begin a longer gram; one behind it only if characters from the edit on
end a longer gram that covers it.  The most that any edit of a word can change is its bound; near
words share all grams but that many.  Words that may lose every gram are decomposed again with
shorter grams; with pairs alone an edit changes two or three of at least seven.

*Merging lists.*  Near words share a gram among the rarest of either, one more than its bound: only
these lists are merged.  One edit lies wholly behind or before a shared gram, so lists are kept by
all the characters up to the gram's end, or from its start.  Lists beyond ``LIST`` words are split by the
words with one character left out, which near words share as well; such a part holds no more words
than the alphabet and the word's length allow.  Every pair that meets in a list is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equivcheck.llm.common import binary_text
from equivcheck.session import written

# The runs of letters, and every how manyth run loses a character.
RUN = r"[A-Za-zÀ-ÿ]+"
EVERY = 199

SHORT, LONG = 2, 5  # lengths of grams
GRAMS = 40_000  # kept grams of one length, at most
LEAST = 20  # occurrences of a kept gram, at least
LIST = 200  # words of a list that are compared with each other
HELD = 200_000  # runs counted in a task before they are handed on
START, END = "\x02", "\x03"

Spans = list[tuple[int, int]]


def runs(doc_id: str, text: str, pattern: re.Pattern, every: int) -> Iterator[tuple[str, int]]:
    """The lower-cased runs of a text with their counts, some of them short of a character."""
    low = text.encode("utf-8", "replace").lower().decode()  # bytes: A-Z only
    for run, n in Counter(pattern.findall(low)).items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if every and h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def counted(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    pattern: str = RUN,
    every: int = EVERY,
    shortest: int = 6,
    least: int = 5,
) -> DataFrame:
    """``(word, n)`` of the words of at least ``shortest`` characters and ``least`` occurrences.

    Null and empty texts have no words; a null id counts as the empty text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = re.compile(pattern), Counter()

        def made() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for doc_id, raw in zip(*batch.columns, strict=True):
                for run, n in runs(doc_id.as_py(), raw.as_py().decode("utf-8", "replace"), found, every):
                    if len(run) >= shortest:
                        counts[run] += n
                if len(counts) > HELD:
                    yield made()
                    counts.clear()
        yield made()

    name = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))
    narrow = docs.select(name.alias("id"), binary_text(F.col(f"`{text}`")).alias("text"))
    parts = narrow.mapInArrow(scan, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Dictionary:
    """Kept grams beyond pairs, and what they begin and end with."""

    def __init__(self, grams: list[str], longest: int = LONG):
        self.grams = frozenset(g for g in grams if SHORT < len(g) <= longest)
        self.longest = max(map(len, self.grams), default=SHORT)
        # Pairs are grams by rule, so single characters begin and end one.
        self.begins = frozenset(g[:k] for g in self.grams for k in range(2, len(g)))
        self.ends = frozenset(g[-k:] for g in self.grams for k in range(2, len(g)))

    def spans(self, s: str) -> Spans:
        """The grams of a word between its marks, as (start, end)."""
        out, reached = [], 0
        for p in range(len(s) - SHORT + 1):
            end = p + SHORT
            for e in range(min(len(s), p + self.longest), p + SHORT, -1):
                if s[p:e] in self.grams:
                    end = e
                    break
            if end > reached:
                out.append((p, end))
                reached = end
        return out

    def bound(self, s: str, spans: Spans) -> int:
        """The most grams that one edit between the marks can change."""
        worst = 0
        for i in range(1, len(s)):
            # Grams before place i change from the first place on that may begin a longer one.
            first = i
            for p in range(max(0, i - self.longest + 1), i):
                if i - p == 1 or s[p:i] in self.begins:
                    first = p
                    break
            # An edit of the character at i leaves what begins behind it; an insertion what begins at i.
            for after in (i + 1, i):
                if after > i and i == len(s) - 1:
                    continue  # the closing mark stays
                last = after
                for e in range(min(len(s), after + self.longest - 1), after, -1):
                    if e - after == 1 or s[after:e] in self.ends:
                        last = e
                        break
                changed = 0
                for p, e in spans:
                    if e <= i:
                        changed += p >= first
                    elif p >= after:
                        changed += e <= last
                    else:
                        changed += 1
                worst = max(worst, changed)
        return worst


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k, n = 0, len(a)
    while k < n and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def keys(s: str, spans: Spans, bound: int, counts: dict[str, int]) -> set[str]:
    """Names of the lists of a word: all up to a gram's end, or all from its start.

    The ``bound + 1`` rarest grams, with all places of the last one.
    """
    grams = sorted((counts.get(s[p:e], 0), s[p:e], p, e) for p, e in spans)
    last = grams[min(bound, len(grams) - 1)][1]
    out = set()
    for k, (_, gram, p, e) in enumerate(grams):
        if k > bound and gram != last:
            break
        out |= {"<" + s[:e], ">" + s[p:]}
    return out


def _grams(words: DataFrame, shortest: int, longest: int) -> DataFrame:
    """``(gram, n)`` of all grams of words between their marks."""
    marked = words.select(F.concat(F.lit(START), "word", F.lit(END)).alias("s"))
    size = F.explode(F.sequence(F.lit(shortest), F.lit(longest))).alias("k")
    sized = marked.select("s", size).where(F.length("s") >= F.col("k"))
    place = F.explode(F.sequence(F.lit(1), F.length("s") - F.col("k") + 1)).alias("p")
    return sized.select("s", "k", place).groupBy(F.expr("substring(s, p, k)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def dictionary(words: DataFrame, longest: int = LONG, grams: int = GRAMS, least: int = LEAST) -> dict[str, int]:
    """Kept grams with their counts.

    A word has fewer places than characters: a gram that is kept holds one in ``grams`` of all, so there
    are at most ``grams`` of each length.  Pairs have counts only where they reach the threshold too:
    the others are rare in any case.
    """
    places = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    threshold = max(least, -(-places // grams))
    kept = _grams(words, SHORT, longest).where(F.col("n") >= threshold)
    return {r["gram"]: r["n"] for r in kept.toLocalIterator()}


def _listed(words: DataFrame, counts: dict[str, int], longest: int) -> DataFrame:
    """``(word, n, key)`` of each word's lists; key is null for a word that may lose all its grams."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(list(counts), longest)
        for batch in batches:
            rows = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = START + word + END
                spans = known.spans(s)
                bound = known.bound(s, spans)
                if bound < len(spans):
                    rows += [(word, n, key) for key in keys(s, spans, bound, counts)]
                else:
                    rows.append((word, n, None))
                    # Words with a bound below their grams may still meet this one.
                    rows += [(word, n, key) for key in keys(s, spans, len(spans), counts)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            types = [pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "n", "key"])

    return words.mapInArrow(scan, "word string, n long, key string")


def _verified(lists: DataFrame) -> DataFrame:
    """Near pairs ``(a, an, b, bn)`` within lists ``held`` of (word, n)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for held in batch.column(0).to_pylist():
                by_length = defaultdict(list)
                for one in held:
                    by_length[len(one["word"])].append((one["word"], one["n"]))
                for size, words in by_length.items():
                    others = by_length.get(size + 1, [])
                    for i, (a, an) in enumerate(words):
                        for b, bn in words[i + 1 :] + others:
                            if near(a, b):
                                for column, value in zip(out, (a, an, b, bn), strict=True):
                                    column.append(value)
            types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["a", "an", "b", "bn"])

    return lists.select("held").mapInArrow(scan, "a string, an long, b string, bn long")


def _pairs(listed: DataFrame, limit: int) -> DataFrame:
    """Near pairs that meet in a list, each once or more."""
    sizes = written(listed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lists")
    held = F.collect_list(F.struct("word", "n")).alias("held")
    small = listed.join(sizes.where(F.col("size") <= limit), "key").groupBy("key").agg(held)
    large = listed.join(sizes.where(F.col("size") > limit), "key")
    # Near words share the shorter one, or what is left of both without the replaced character.
    gap = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("gap")
    left = F.expr("concat(substring(word, 1, gap - 1), substring(word, gap + 1))")
    without = large.select("word", "n", gap).select("word", "n", left.alias("part"))
    parts = without.unionByName(large.select("word", "n", F.col("word").alias("part")))
    parts = parts.distinct().groupBy("part").agg(held).where(F.size("held") > 1)
    return _verified(small.select("held").unionByName(parts.select("held")))


def links(words: DataFrame, longest: int = LONG, limit: int = LIST) -> DataFrame:
    """``(a, an, b, bn)``: all pairs of near words of ``(word, n)``, each once, ``a`` before ``b`` or not."""
    counts = dictionary(words, longest)
    found, now = [], words
    for size in range(longest, SHORT - 1, -1):
        listed = written(_listed(now, counts, size), "listed")
        found.append(_pairs(listed.where("key is not null"), limit))
        # Two words that may both lose all their grams need shorter ones.
        now = listed.where("key is null").select("word", "n")
        if size == SHORT or not now.take(1):
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    swapped = F.col("a") > F.col("b")
    low = [F.when(swapped, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("an", "bn"))]
    high = [F.when(swapped, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("b", "a"), ("bn", "an"))]
    return out.select(*low, *high).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every word with a form: pointers that double until none moves.

    A form is more frequent than its word by a fixed factor, so chains are short and end.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next")
        moved = written(moved, "roots")
        if not moved.where("next is not null").take(1):
            return moved.select("word", "root")
        now = moved.select("word", "root")


def group(words: DataFrame, factor: int = 5, longest: int = LONG, limit: int = LIST) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every row of ``words``, a table ``(word, n)``.

    Words are distinct.  A word's form is its near word of largest n, of equals the first in code-point
    order, if it is at least ``factor`` (2 or more) times as frequent; the root is where forms lead.
    Words of any length are taken; an empty table gives no rows.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = written(links(words, longest, limit), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    best = F.min(F.struct((-F.col("bn")).alias("rank"), F.col("b").alias("word")))
    around = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = words.join(around, "word", "left")
    enough = -F.col("best.rank") >= F.col("n") * factor
    judged = judged.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"),
        F.when(enough, -F.col("best.rank")).alias("form_n"),
    )
    judged = written(judged, "judged")
    found = judged.join(_roots(judged.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spellings(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``group`` over the words of all texts of ``docs``.

    Null and empty texts have no words, repeated rows count as often as they come, other columns have
    no influence.
    """
    return group(counted(docs, id_column, text))
