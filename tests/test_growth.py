"""Steps whose cost must not outgrow their input: each test fails on the form that came before."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import metrics as Q
from loomframe.sources import prep as D


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_groups_of_one_size_are_drawn_together(spark):
    rows = [(g, i, float(i * 7 % 11), None if i % 5 == 4 else "abc"[(i * i + g) % 3]) for g, n in enumerate((1, 2, 5, 5, 700)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, pos long, x double, vote string")
    got = Q.majority_of_k(df, ["g"], "vote", "x", "pos", rounds=20)
    assert "FlatMapGroupsInPandas" not in plan(got)
    want = {}
    for g in range(5):
        mine = [r for r in rows if r[0] == g]
        for k in [k for k in (2, 4, 8, 16, 32, 64, 128, 256, 512) if k < len(mine)] + [len(mine)] if len(mine) > 1 else []:
            rng, values = np.random.RandomState(42), []
            for _ in range(20):
                draw = [mine[i] for i in rng.choice(len(mine), size=k, replace=True)]
                votes = Counter(r[3] for r in draw)
                winner = max(votes, key=votes.get)
                values.append(next(r[2] for r in draw if r[3] == winner))
            want[g, k] = (np.mean(values), np.std(values))
    assert {(r["g"], r["k"]): (r["maj_mean"], r["maj_std"]) for r in got.collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_drawn_groups_in_steps_are_the_same(spark, monkeypatch):
    df = spark.range(40).select((F.col("id") % 3).alias("g"), F.col("id").alias("pos"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 4).alias("vote"))
    whole = Q.majority_of_k(df, ["g"], "vote", "x", "pos", rounds=30).orderBy("g", "k").collect()
    monkeypatch.setattr(Q, "DRAWN", 64)
    assert Q.majority_of_k(df, ["g"], "vote", "x", "pos", rounds=30).orderBy("g", "k").collect() == whole


def test_long_responses_keep_the_width_of_a_row(spark):
    df = spark.createDataFrame([(0, [5], [1, 1, 1, 0, 1]), (1, [5, 6, 7], [1] * 5), (2, [5], [1, 0])], "i long, p array<int>, m array<int>")
    got = df.select("i", *D.rollout_row("p", F.transform("m", lambda _, i: i + 1), 3, 4, response_mask="m")).orderBy("i").collect()
    assert [r["input_ids"] for r in got] == [[0, 5, 1, 2, 3, 4, 5], [5, 6, 7, 1, 2, 3, 4, 5], [0, 0, 5, 1, 2, 0, 0]]
    assert [r["attention_mask"] for r in got] == [[0, 1, 1, 1, 1, 1, 1], [1] * 8, [0, 0, 1, 1, 1, 0, 0]]
    assert [r["response_mask"] for r in got] == [[1, 1, 1, 0, 1], [1] * 5, [1, 0, 0, 0]]
    assert [max(r["position_ids"]) for r in got] == [5, 7, 2]
