"""The pipeline against plain Python, stage by stage, on a small folder of tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from equivcheck.llm import mixing, pseudonyms, quality
from equivcheck.llm.queries import WEIGHTS
from test_brute_force import brute_fingerprint, brute_hits, luhn, repeated_words, roots, words

KEY = "pseudonyms"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_quality(text):
    """The cleaned text, or nothing for a rejected document."""
    text = text or ""
    parts = words(text)
    lost, kept = 0, []
    for line in text.split("\n"):
        own = words(line)
        symbols = sum(line.count(c) for c in quality.SYMBOLS)
        separators = sum(w in quality.SEPARATORS for w in own)
        fails = bool(own) and (
            not any(c.isalnum() for c in line)
            or symbols * 100 > sum(map(len, own)) * 15
            or (separators >= 3 and separators * 5 >= len(own))
            or any(p in line.lower() for p in quality.BOILERPLATE)
        )
        lost += sum(map(len, own)) if fails else 0
        kept += [] if fails else [line]
    bad = len(parts) < 20 or 100 * repeated_words(parts) > 30 * len(parts)
    return None if bad or lost * 100 > sum(map(len, parts)) * 50 else "\n".join(kept)


def brute_permuted(text, kind):
    n = len(text)
    a, b = text[: n // 2], text[n // 2 :]
    for r in range(10):
        d = hashlib.sha256(f"{KEY}|{kind}|{n}|{r}|{b}".encode()).hexdigest()
        a, b = b, "".join(str((int(c) + int(d[2 * i : 2 * i + 2], 16)) % 10) for i, c in enumerate(a))
    return a + b


def brute_pseudonym(value):
    """Cards and phone numbers, as the texts below hold them."""
    if value.startswith("+1 "):
        made = iter(brute_permuted("".join(c for c in value[2:] if c.isdigit()), "phone"))
        return "+1" + "".join(next(made) if c.isdigit() else c for c in value[2:])
    body = brute_permuted(value[:-1], "card")
    return next(body + c for c in "0123456789" if luhn(body + c))


def brute_mix(spark, rows):
    """Copies of each document by epoch."""

    def leaf(r):
        n = len(r[1] or "")
        return ("short" if n < 500 else "middle" if n < 5000 else "long", r[2] or "", r[3] or "")

    supply = Counter()
    for r in rows:
        supply[leaf(r)] += len(words(r[1]))
    leaves = [(*k, v * 4) for k, v in supply.items()]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, supply long")
    shares = mixing.budgets(df, ["domain", "lang", "source"], sum(supply.values()) // 2, WEIGHTS).collect()
    out = Counter()
    for b in shares:
        mine = [r for r in rows if leaf(r) == tuple(b)[:3]]
        held = supply[tuple(b)[:3]]
        whole, left = divmod(b["budget"], held)
        for r in mine:
            out.update((r[0], r[1], e) for e in range(whole))
        total = 0
        for r in sorted(mine, key=lambda r: (hashlib.md5(f"7:{whole}:{r[0]}".encode()).hexdigest(), r[0])):
            total += len(words(r[1]))
            if total > left:
                break
            out[(r[0], r[1], whole)] += 1
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(12)
    vocabulary = ["".join(draw.choice("abcdefghijklmno") for _ in range(draw.randint(2, 7))) for _ in range(900)]

    def prose(n):
        return " ".join(draw.choice(vocabulary) for _ in range(n)) + "."

    base = [prose(draw.randint(30, 200)) for _ in range(60)]
    tests = [prose(25) for _ in range(3)]
    texts = [*base, *base[:5], base[6] + " more", base[7].replace(" ", "\n", 2), None, "", "short", "a " * 50]
    texts += [base[8] + " " + tests[0], base[9][:40] + " " + tests[1][:110] + " " + prose(30), prose(40) + "\n" + "a | b | c | d | e"]
    texts += [f"{prose(40)} 4111111111111111 and +1 (017) 555-7713 or 4111111111111112 {prose(5)}" for _ in range(4)]
    texts += [" | ".join(prose(60).split()), prose(1500)]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([*rows, rows[3]], COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = spark.createDataFrame(list(enumerate(tests)), "item_id long, text string")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path, [*rows, rows[3]], list(enumerate(tests))


def test_pipeline_against_brute_force(spark, folder):
    path, rows, items = folder
    now = [(r[0], brute_quality(r[1]), *r[2:4]) for r in rows]
    now = [r for r in now if r[1] is not None]
    assert len(now) < len(rows)
    fps = {r[0]: brute_fingerprint(r[1]) for r in now}
    root = roots(fps.values(), 4)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    kept = sorted({r for r in now if least[root[fps[r[0]]]] == r[0]}, key=lambda r: r[0])
    assert len(kept) < len(now)
    clean = [r for r in kept if not brute_hits(r[1], items)[1]]
    assert len(clean) <= len(kept) - 2
    values = ("4111111111111111", "+1 (017) 555-7713")
    hidden = [(r[0], r[1], *r[2:]) for r in clean]
    for v in values:
        hidden = [(r[0], r[1].replace(v, brute_pseudonym(v)), *r[2:]) for r in hidden]
    assert hidden != clean
    spark.conf.set(pseudonyms.SETTING, KEY)
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r["doc_id"], r["text"], r["epoch"]) for r in got) == brute_mix(spark, hidden)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_stages_return_the_columns_of_documents(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    # Names that operators use themselves are ordinary columns of the input.
    more = docs.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(-1)).withColumn("fp", F.lit("y"))
    more = more.withColumn("items", F.lit(0)).withColumn("__n", F.lit(1)).withColumn("n_pii", F.lit("z"))
    now = more
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        wanted = [*more.columns, "epoch"] if stage is corpus_pipeline.STAGES[-1][1] else more.columns
        assert out.columns == wanted, name
        first = out.first()
        assert (first["kept"], first["n_words"], first["fp"], first["items"], first["n_pii"]) == ("x", -1, "y", 0, "z")
        assert stage(spark, now.where("false"), path).count() == 0
        now = out


def test_stages_take_missing_ids_and_texts(spark, folder):
    path = folder[0]
    rows = [(None, "t " * 3, None, None, None), (1, None, None, None, None), (1, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, path).count() > 0, name
    # Half of three tokens holds no document of three.
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert all(r["doc_id"] == 1 and r["epoch"] == 0 for r in mixed)
    assert corpus_pipeline.STAGES[0][1](spark, docs, path).count() == 0
