"""Sweeps of the word classes: counts travel as a row per item and task, not as one per count."""

import random
from collections import Counter

import numpy as np
import pytest

from equivcheck.llm import brown


@pytest.mark.parametrize(("waiting", "dense"), [(brown.WAITING, brown.DENSE), (5, 4)])
def test_an_item_is_one_row_with_the_sums_of_all_tasks(spark, monkeypatch, waiting, dense):
    monkeypatch.setattr(brown, "WAITING", waiting)
    monkeypatch.setattr(brown, "DENSE", dense)
    draw = random.Random(2)
    end = 90
    lists = [[draw.randrange(80) for _ in range(draw.randint(0, 60))] for _ in range(70)] + [[]]  # ten items never come
    items = spark.createDataFrame([(x,) for x in lists], "items array<int>").repartition(6)
    group = np.array([draw.randrange(brown.CLASSES) for _ in range(end)] + [brown.CLASSES])
    size, want = brown.CLASSES + 1, Counter()
    for x in lists:
        line = [end, *x, end]
        for a, b in zip(line[:-1], line[1:], strict=True):
            want[b, group[a]] += 1
            want[a, size + group[b]] += 1
    rows = brown._beside(items, end, group).collect()
    own = [r for r in rows if r["item"] < end]
    assert sorted(r["item"] for r in own) == list(range(80))
    assert len({r["item"] for r in rows}) == len(rows)
    assert all(r["side"] == sorted(set(r["side"])) for r in rows)
    got = {(r["item"], k): n for r in own for k, n in zip(r["side"], r["n"], strict=True)}
    assert got == {k: n for k, n in want.items() if k[0] < end}
    between = sum(n for r in rows if r["item"] > end for n in r["n"])
    assert between == sum(len(x) + 1 for x in lists)


def test_a_sweep_over_texts_without_words(spark):
    items = spark.createDataFrame([([],), ([],)], "items array<int>").repartition(2)
    group, between = brown.sweep(items, 3, np.array([0, 1, 2, brown.CLASSES]))
    assert group.tolist() == [0, 1, 2, brown.CLASSES]
    assert between.sum() == 2 and between[-1, -1] == 2
