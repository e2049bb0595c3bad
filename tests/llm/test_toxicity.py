"""Toxicity: cuts by language, names of columns, scores without the row's own label."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equivcheck.llm import toxicity
from equivcheck.llm.toxicity import LIMIT, PRIOR, STEPS, cuts_of, score_bin

BINS = 2 * LIMIT * STEPS + 1


def _brute(pairs, common):
    """The cut with the fewest errors, among all edges of bins, counted row by row."""
    scale = PRIOR / max(1, sum(y for _, y in common))
    best = []
    for edge in range(BINS + 1):
        wrong = lambda rows: sum((b >= edge) != bool(y) for b, y in rows)
        best.append(wrong(pairs) + scale * wrong(common))
    least = [i for i, v in enumerate(best) if v <= min(best) + 1e-9]
    return least[len(least) // 2] / STEPS - LIMIT


@pytest.mark.parametrize("seed", range(3))
def test_cuts_have_the_fewest_errors(seed):
    draw = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate((60, 12, 3, 0)):
        y = (draw.random(n) < 0.3).astype(int)
        logits = draw.normal(0, 2, n) + 3 * y + g
        rows.append(list(zip(score_bin(logits).tolist(), y.tolist())))
    counts = np.zeros((len(rows), BINS, 2))
    for g, pairs in enumerate(rows):
        for b, y in pairs:
            counts[g, b, y] += 1
    common = [r for pairs in rows for r in pairs]
    assert cuts_of(counts) == [_brute(pairs, common) for pairs in rows]


def test_a_language_moves_away_from_the_common_cut_with_its_rows():
    counts = np.zeros((2, BINS, 2))
    low, high = score_bin(np.array([-2.0, 2.0]))
    counts[0, low, 0], counts[0, high, 1] = 5000, 500  # cut anywhere between
    for n in (1, 5, 2000):
        counts[1] = 0
        counts[1, low - 32, 0], counts[1, low, 1] = 10 * n, n  # toxic ones as low as clean ones elsewhere
        cut = cuts_of(counts)[1]
        assert (cut <= low / STEPS - LIMIT) == (n == 2000)


def _texts(spark, n=300):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    rows = []
    for i in range(n):
        body = [draw.choice(vocabulary) for _ in range(30)]
        if i % 3 == 0:
            body[7] = "scum"
        rows.append((i, " ".join(body), int(i % 3 == 0)))
    return rows


def test_names_of_columns_are_the_callers(spark):
    rows = _texts(spark)
    names = ["n.o", "body", "y", "z", "id", "whole", "short", "lang", "score"]
    df = spark.createDataFrame([(i, t, 1, 2, "a", "b", True, "en", 0.5) for i, t, _ in rows], names)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "`n.o` long, toxic int")
    plain = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    learn = F.lit(True)
    want = {r["id"]: r["score"] for r in toxicity.score(plain, labels.toDF("doc_id", "toxic"), learn).collect()}
    got = toxicity.score(df, labels, learn, id_column="n.o", text="body", keep=("y", "whole"))
    assert got.columns == ["id", "y", "whole", "score", "predicted"]
    assert {r[0]: r["score"] for r in got.collect()} == want
    without = toxicity.score(df.drop("lang"), labels, learn, id_column="n.o", text="body").collect()
    assert np.mean([(r["predicted"] == 1) == (r["id"] % 3 == 0) for r in without]) > 0.97


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(df, labels, F.lit(True)).collect() == []
    some = spark.createDataFrame([(1, "a", "en")], df.schema)
    assert [r["score"] for r in toxicity.score(some, labels, F.lit(True)).collect()] == [0.0]


def test_long_texts_and_the_rest_of_the_rows_count_for_the_cut(spark, monkeypatch):
    """Only the sample is short: rows outside it are scored in Spark and counted."""
    rows = [(i, t + " word" * (5000 if i % 2 else 0), y) for i, t, y in _texts(spark)]
    df = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "cuts_of", lambda counts: seen.append(counts.sum(axis=(0, 1)).tolist()) or cuts_of(counts))
    got = toxicity.score(df, labels, F.lit(True)).collect()
    assert seen == [[200, 100]]
    assert np.mean([(r["predicted"] == 1) == (r["id"] % 3 == 0) for r in got]) > 0.95


def _shuffled(spark):
    """Bytes of the shuffle files of this session that are there."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    paths = [files.apply(i) for i in range(files.size())]
    return {p.getName(): p.length() for p in paths if p.getName().startswith("shuffle_")}


def test_texts_are_not_shuffled(spark):
    """Joins take ids and sizes, also where no side is small enough to be broadcast."""
    draw = random.Random(5)
    rows = [(i, t + " " + draw.randbytes(4000).hex(), y) for i, t, y in _texts(spark, 600)]
    df = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        got = toxicity.score(df, labels, F.lit(True), max_toxic=50, max_clean=100).collect()
        after = _shuffled(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    written = sum(n for name, n in after.items() if name not in before)
    assert 0 < written < 500_000 < sum(len(t) for _, t, _ in rows)
    assert len(got) == 600 and np.mean([(r["predicted"] == 1) == (r["id"] % 3 == 0) for r in got]) > 0.95
