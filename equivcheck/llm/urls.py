"""Bit-parallel wildcard automaton: all glob rules at once over each canonical URL.

A rule is a glob for the host and a glob for the path.  ``*`` stands for any run of characters
inside its own part.  The states of all rules are packed into machine words (Shift-And): bit ``j``
of a rule is set when its first ``j + 1`` symbols fit the text read so far; ``*`` keeps its bit
while characters of its part arrive.  One pass over the characters moves all states of all rules
and all URLs of a batch.  Rules are given and few (they are closure parameters of the task, a few
hundred bytes each); rows are independent and nothing is shuffled.

Canonical URL: the host with A-Z lower-cased, a mark, the path.  Null or a URL without ``://`` has
an empty host and path, and no rule fits it unless it fits the empty host.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BETWEEN = 1  # the byte between host and path; bytes of that value in a URL are set to 2
END = 0  # after the path
CHUNK = 4096


@dataclass(frozen=True)
class Rule:
    """``name`` and ``verdict`` come out; ``host`` and ``path`` are globs; the longest fit wins."""

    name: str
    verdict: str
    host: str
    path: str
    rank: int


def site_rules(name: str, verdict: str) -> list[Rule]:
    """Globs of a rule ``host/path``: the host and its subdomains, paths that start with the path."""
    host, slash, path = name.partition("/")
    start = f"{slash}{path}*"
    return [Rule(name, verdict, h, start, len(name)) for h in (host, f"*.{host}")]


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL as columns."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(after, r"(?s)^([^?#]*)", 1)


class Automaton:
    """Masks of all rules.  A symbol is a byte with or without a star in front of it."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        symbols: list[tuple[int, bool, bool]] = []  # byte, star before it, star in the path
        starts, finals = [], []
        for rule in self.rules:
            starts.append(len(symbols))
            for text, closing, in_path in ((rule.host, BETWEEN, False), (rule.path, END, True)):
                star = False
                for byte in text.encode():
                    if byte == ord("*"):
                        star = True
                    else:
                        symbols.append((byte, star, in_path))
                        star = False
                symbols.append((closing, star, in_path))
            finals.append(len(symbols) - 1)
        # Bit j + 1 of the packed row is "symbols up to j fit"; bit of a rule's start is always set
        # before the first character only, so every rule gets one bit more than it has symbols.
        self.n_bits = len(symbols) + len(starts)
        self.n_words = max(1, -(-self.n_bits // 64))
        self.fits = np.zeros((256, self.n_words), np.uint64)
        self.stays = np.zeros((256, self.n_words), np.uint64)
        self.start = np.zeros(self.n_words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        bit = 0
        for first, last in zip(starts, finals, strict=True):
            self.start[bit // 64] |= np.uint64(1 << (bit % 64))
            for byte, star, in_path in symbols[first : last + 1]:
                if star:  # the state before the symbol stays while its own part goes on
                    keep = [b for b in range(256) if b != END and (in_path or b != BETWEEN)]
                    self.stays[keep, bit // 64] |= np.uint64(1 << (bit % 64))
                bit += 1
                self.fits[byte, bit // 64] |= np.uint64(1 << (bit % 64))
            self.final.append((bit // 64, np.uint64(1 << (bit % 64))))
            bit += 1

    def run(self, texts: list[bytes]) -> np.ndarray:
        """For each text (host, mark, path, end) and rule: whether it fits."""
        out = np.zeros((len(texts), len(self.rules)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order])
        joined = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        at = np.cumsum(lengths) - lengths
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        active = len(texts)
        step = 0
        while active:
            chars = joined[at[:active] + step]
            now = state[:active]
            moved = now << np.uint64(1)
            if self.n_words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.fits[chars]
            moved |= now & self.stays[chars]
            state[:active] = moved
            step += 1
            # Texts are sorted by length: those that have ended are at the back.
            active = int(np.searchsorted(-lengths, -step, side="left"))
        for r, (word, mask) in enumerate(self.final):
            out[order, r] = (state[:, word] & mask) != 0
        return out


def _canonical_bytes(host: str, path: str) -> bytes:
    clean = bytes.maketrans(bytes([END, BETWEEN]), bytes([2, 2]))
    return b"".join(
        [host.encode().translate(clean), bytes([BETWEEN]), path.encode().translate(clean), bytes([END])]
    )


def judge(
    pages: DataFrame, rules: Sequence[Rule], fallback: Sequence[Rule] = (), default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` to pages with a ``url``.

    ``rules`` decide by the longest name (first of equals) and are named in ``rule``; where none
    fits, the longest of the ``fallback`` globs decides, else ``default``; ``rule`` is then null.
    """
    given = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = canonical(F.col("url"))
    first, second = list(rules), list(fallback)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([*first, *second])
        ranks = np.array([r.rank for r in automaton.rules] or [0])
        verdicts = [r.verdict for r in automaton.rules]
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                hosts = batch.column("host").to_pylist()
                paths = batch.column("path").to_pylist()
                fits = automaton.run([_canonical_bytes(h, p) for h, p in zip(hosts, paths, strict=True)])
                names, said = [], []
                for row in fits:
                    mine = np.flatnonzero(row[: len(first)])
                    if len(mine):
                        best = mine[np.argmax(ranks[mine])]
                        names.append(first[best].name)
                        said.append(verdicts[best])
                        continue
                    names.append(None)
                    other = np.flatnonzero(row[len(first) :]) + len(first)
                    said.append(verdicts[other[np.argmax(ranks[other])]] if len(other) else default)
                columns = [*batch.columns, pa.array(names, pa.string()), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "rule", "verdict"])

    parted = pages.select(*given, host.alias("host"), path.alias("path"))
    more = [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
    schema = T.StructType([*parted.schema.fields, *more])
    return parted.mapInArrow(scan, schema)
