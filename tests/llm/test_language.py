"""Language profiles against loops over letters, and their memory."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from equivcheck.llm import language


def brute_vector(space, text):
    """The bundle of a text's trigrams, one after the other."""
    slots = [0]
    for c in text.lower():
        slots.append(language._slot(ord(c)) if c.isalpha() else 0)
    slots += [0, 0]
    out = np.zeros(language.DIMENSION)
    for a, b, c in zip(slots, slots[1:], slots[2:]):
        if b:
            # A letter's vector moves with its place in the trigram.
            out += space.places[0][a].astype(int) * space.places[1][b] * space.places[2][c]
    return out


def texts():
    draw = random.Random(7)
    letters = {"aa": "abcdeé", "bb": "fghijö", "cc": "日本語中文字", "dd": "абвгд"}
    out = []
    for lang, own in letters.items():
        for _ in range(12):
            words = ["".join(draw.choice(own) for _ in range(draw.randint(1, 7))) for _ in range(draw.randint(1, 30))]
            out.append((" ".join(words) + draw.choice(["", ".", " 12"]), lang))
    return [*out, (None, "aa"), ("", "bb"), ("12 !", None), ("abc 日本", None), ("x" * 30_000, "aa"), ("𝒜𝒷 𝓍", None)]


def test_vectors(monkeypatch):
    space = language.Space()
    rows = [t or "" for t, _ in texts()]
    want = np.array([brute_vector(space, t) for t in rows])
    assert np.array_equal(space.vectors(rows), want)
    monkeypatch.setattr(language, "GRAMS", 7)
    assert np.array_equal(space.vectors(rows), want)


def test_predictions(spark):
    space = language.Space()
    rows = [(i, t, lang if i % 3 else None) for i, (t, lang) in enumerate(texts())]
    rows += [rows[1], (None, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for name in ("id", "score", "__text", "place", "value"):
        docs = docs.withColumn(name, F.lit("x"))
    sums = {}
    for _, text, lang in rows:
        if lang is not None:
            vector = brute_vector(space, text or "")
            unit = vector / (np.sqrt((vector**2).sum()) or 1)
            sums[lang] = sums.get(lang, 0) + unit
    names = sorted(sums)
    got = language.predict(docs, F.lit(True)).collect()
    assert len(got) == len(rows)
    by_id = {r["id"]: r for r in got}
    for i, text, _ in rows:
        vector = brute_vector(space, text or "")
        if not vector.any():
            assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
            continue
        cosines = [vector @ sums[n] / np.linalg.norm(vector) / np.linalg.norm(sums[n]) for n in names]
        assert abs(by_id[i]["score"] - min(1, max(0, max(cosines)))) < 1e-4
        assert max(cosines) - cosines[names.index(by_id[i]["lang_pred"])] < 1e-4
    assert language.predict(docs.where("false"), F.lit(True)).count() == 0


def test_equal_cosines_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a"), (3, "same text", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.predict(docs, F.lit(True)).collect()} == {"a"}


def test_a_rare_language_is_learnt(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("abc cab").alias("text"), F.lit("aa").alias("lang"))
    rare = spark.createDataFrame([(-1, "xyz zyx", "rare"), (-2, "xyz zyx", None)], "doc_id long, text string, lang string")
    found = language.predict(rows.unionByName(rare), F.lit(True)).where("id = -2").first()
    assert found["lang_pred"] == "rare"


def test_memory_does_not_grow_with_the_script():
    draw = random.Random(3)
    batches = [
        ["".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(10)).encode() for _ in range(10_000)],
        ["".join(chr(draw.randrange(0xC0, 0x17F)) for _ in range(24)).encode() for _ in range(10_000)],
    ]
    space = language.Space()
    for batch in batches:
        tracemalloc.start()
        n = sum(len(space.vectors(piece)) for piece in language._pieces(batch))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 10_000 and peak < 200_000_000
