"""Manifest, byte pairs and spelling variants against plain Python, with the edge cases of tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from equivcheck.llm import bpe, merkle, queries, variants

public_tokenizers = pytest.importorskip("public_tokenizers")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["grp", "id", "node", "claimed", "item", "pos", "n", "blk", "upper", "word", "form", "key", "a.b", "__id", "any", "part"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes):
    """Root, and per node its siblings as (left, right) from below."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, spot in enumerate(spots):
            run = spot // 16 * 16
            paths[k].append(("".join(nodes[run:spot]), "".join(nodes[spot + 1 : run + 16])))
            spots[k] = spot // 16
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def low(text):
    return text and re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, below = [], []
    for name in names:
        order = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf((r[0], r[3], r[2], r[4], r[1]))))
        leaves = [brute_leaf((r[0], r[3], r[2], r[4], r[1])) for r in order]
        root, paths = brute_tree(leaves)
        subroots.append(root)
        below.append((order, leaves, paths))
    root, above = brute_tree(subroots)
    out = []
    for subroot, upper, (order, leaves, paths) in zip(subroots, above, below, strict=True):
        for r, leaf, path in zip(order, leaves, paths, strict=True):
            path = path + upper
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = brute_leaf((r[0], r[3], r[2], r[4], low(r[1]) if hit else r[1]))
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in path))
            out.append((r[0], leaf, subroot, root, proof, node, node == root))
    return Counter(out)


def made_manifest(df):
    found = merkle.manifest(df, tampered=merkle.tampered_text())
    names = ("id", "leaf", "subroot", "root", "proof", "folded_root", "verified")
    return Counter(tuple(r[n] for n in names) for r in found.collect())


def manifest_rows():
    draw = random.Random(2)
    sizes = {"hot": 4_500, "b": 256, "c": 257, "d": 17, "e": 16, "f": 1, None: 3, "": 2, "Z": 1, "é": 33}
    sizes |= {f"s{i}": 1 for i in range(20)}
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = draw.choice([None, "", "Small", "all low", "ÄÖ Mixed É", "X" * 5000])
            rows.append((at, text, draw.choice([None, "en"]), source, draw.choice([None, at])))
            at += draw.randint(1, 3)
    # Repeated rows, rows of one id with different texts, missing ids.
    rows += [rows[0], rows[0], rows[-1], (rows[5][0], "Other", None, "hot", 1), (None, "A", None, "d", 1), (None, "A", None, "d", 1)]
    draw.shuffle(rows)
    return rows


def test_manifest(spark):
    rows = manifest_rows()
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    want = brute_manifest(rows)
    assert made_manifest(df) == want
    for name in NAMES:
        df = df.withColumn(name, F.lit(-1))
    assert made_manifest(df) == want
    assert {v for *_, v in want} == {True, False}
    assert made_manifest(df.where("false")) == Counter()
    one = [rows[0]]
    assert made_manifest(spark.createDataFrame(one, COLUMNS)) == brute_manifest(one)


def test_manifest_of_rows_of_one_key(spark):
    rows = [(1, "T", None, "s", 1)] * 700 + [(2, "U", None, "s", 1)]
    assert made_manifest(spark.createDataFrame(rows, COLUMNS).repartition(4)) == brute_manifest(rows)


def test_manifest_finds_a_changed_field(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(40)]
    df = spark.createDataFrame(rows, COLUMNS)
    found = merkle.manifest(df, tampered={"lang": F.when(F.col("doc_id") == 7, "de").otherwise(F.col("lang"))})
    assert [r["id"] for r in found.where("not verified").collect()] == [7]
    assert merkle.manifest(df).where("not verified").count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    return path, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_texts():
    draw = random.Random(4)
    letters = "aabcdefghijklmnopqrstuvwxyzéüßñ  \n\t.,!?'0123456789ABC日本語🙂 <|endoftext|>"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 150))) for _ in range(300)]
    texts += ["".join(draw.choice("abe tion ") for _ in range(300)) for _ in range(60)]
    texts += [c * n for c in ("a", "ab", "-", "é", " ", "\n") for n in (1, 2, 3, 7, 500)]
    texts += ["x" + "aeiou" * 20_000, "word " * 60_000, None, "", "<|endoftext|>", "it's we'll"]
    return texts


def test_tokens(spark, vocabulary):
    path, _, reference = vocabulary
    texts = token_texts()
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for name in ("id", "n_tokens", "ids"):
        df = df.withColumn(name, F.lit("x"))
    want = {i: reference.encode_ordinary(t or "") for i, t in rows}
    got = bpe.encode(df, path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    assert all(r["ids"] == want[r["id"]] and r["n_tokens"] == len(r["ids"]) for r in got)
    for r in bpe.digests(df, path, public_tokenizers.PATTERN).collect():
        assert r["n_tokens"] == len(want[r["id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.array(want[r["id"]], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha(dict(rows)[r["id"]] or "")
    back = bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path)
    assert {r["id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in rows}
    assert bpe.encode(df.where("false"), path, public_tokenizers.PATTERN).count() == 0


def test_tokens_with_little_memory(vocabulary):
    _, ranks, reference = vocabulary
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, memory=10_000)
    for text in token_texts()[:200]:
        assert encoder.encode(text or "") == reference.encode_ordinary(text or "")


def test_merges_in_a_vocabulary_of_any_order():
    # Ranks drawn at random: a merge may make one of lower rank possible, and tokens overlap themselves.
    draw = random.Random(9)
    for _ in range(40):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 330:
            a, b = draw.choices([t for t in tokens if set(t) <= set(b"abc")], k=2)
            if len(a + b) <= 6:
                tokens.add(a + b)
        order = sorted(tokens, key=lambda t: (len(t) > 1, draw.random()))
        ranks = {t: i for i, t in enumerate(order)}
        reference = tiktoken.Encoding("t", pat_str=r"\S+|\s", mergeable_ranks=ranks, special_tokens={})
        text = " ".join("".join(draw.choice("abc") for _ in range(draw.randint(1, 30))) for _ in range(60))
        assert bpe.Encoder(ranks, r"\S+|\s").encode(text) == reference.encode_ordinary(text)


def brute_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_group(counts):
    around = {w: [] for w in counts}
    listed = sorted(counts)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                around[a].append(b)
                around[b].append(a)
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(around[w]), counts.get(form[w])))
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def edited(draw, word, letters):
    at, how = draw.randrange(len(word)), draw.randrange(3)
    return word[:at] + ("" if how == 0 else draw.choice(letters)) + word[at + (how != 2) :]


def as_rows(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize(("letters", "longest", "limit"), [("ab", 5, 200), ("abcdé", 5, 3), ("abcdefghij", 3, 200), ("abc", 2, 5)])
def test_variants(spark, letters, longest, limit):
    draw = random.Random(letters)
    parts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 3))) for _ in range(8)]
    words = {"".join(draw.choice(parts) for _ in range(draw.randint(3, 7))) for _ in range(150)}
    words |= {edited(draw, w, letters) for w in sorted(words) for _ in range(3)}
    words |= {"abcabc" + c for c in "abcdefghijklmnopqrstuvwxyz"} | {letters[0] * n for n in range(6, 12)}
    counts = {w: draw.choice([5, 5, 6, 25, 30, 130, 700]) for w in words if len(w) >= 6}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = variants.group(df, longest=longest, limit=limit)
    assert got.count() == len(counts)
    assert as_rows(got) == brute_group(counts)


def test_spellings_of_texts(spark):
    draw = random.Random(6)
    parts = ["".join(draw.choice("abcdeñéÿ") for _ in range(draw.randint(2, 4))) for _ in range(30)]
    vocabulary = ["".join(draw.choice(parts) for _ in range(3)) for _ in range(40)]
    rows = [(i, " ".join(draw.choice(vocabulary) for _ in range(300))) for i in range(150)]
    rows += [(7, "ÀÉ" * 3 + " Upper×case÷run, x" * 6 + " digits1inside2words"), (8, None), (9, ""), (None, "nobody " * 6), rows[0]]
    rows += [(10, "long" * 5_000)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("word", F.lit("x")).repartition(3)
    want = brute_group(brute_counts(rows))
    assert any(f for _, f, *_ in want)
    assert as_rows(variants.spellings(df)) == want
    assert variants.spellings(df.where("false")).count() == 0


def test_bound_holds_for_near_words():
    draw = random.Random(5)
    for trial in range(60):
        letters = ["ab", "abcd", "abcdefghijé"][trial % 3]
        parts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 3))) for _ in range(6)]
        words = {"".join(draw.choice(parts) for _ in range(draw.randint(2, 6))) for _ in range(60)}
        words |= {edited(draw, w, letters) for w in sorted(words) for _ in range(2)}
        words = [w for w in words if len(w) >= 6]
        marked = {w: variants.START + w + variants.END for w in words}
        every = Counter(s[p : p + k] for s in marked.values() for k in range(2, 6) for p in range(len(s) - k + 1))
        known = variants.Dictionary([g for g, n in every.items() if n >= draw.choice([2, 3, 5])], draw.choice([2, 3, 4, 5]))
        grams = {w: [s[p:e] for p, e in known.spans(s)] for w, s in marked.items()}
        bounds = {w: known.bound(s, known.spans(s)) for w, s in marked.items()}
        for i, a in enumerate(words):
            for b in words[:i]:
                assert variants.near(a, b) == one_edit(a, b)
                if one_edit(a, b):
                    shared = sum((Counter(grams[a]) & Counter(grams[b])).values())
                    assert shared >= max(len(grams[a]) - bounds[a], len(grams[b]) - bounds[b])


def test_queries_of_the_given_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = queries.dataset_manifest(spark, sf)
    assert Counter(map(tuple, found.collect())) == brute_manifest(rows)
    assert as_rows(queries.spelling_variants(spark, sf)) == brute_group(brute_counts([r[:2] for r in rows]))
