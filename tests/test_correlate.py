"""Pearson / Spearman: golden values of the published pair comparison."""

import math

import numpy as np
import pandas as pd
import pytest

from tessera.operators import correlate as X

HUMAN = [0.9, 0.85, 0.3, 0.8, 0.1]
# published similarities (5 pairs) and Pearson per model
GOLDEN = {
    "bge-small-en-v1.5": ([0.9457922577857971, 0.7672313451766968, 0.6567733287811279, 0.761039137840271,
                           0.4228198528289795], 0.9119900041217643),
    "bge-base-en-v1.5": ([0.8977451324462891, 0.7688999772071838, 0.6537215113639832, 0.7334803938865662,
                          0.48271745443344116], 0.921509565896743),
    "all-MiniLM-L6-v2": ([0.8301746249198914, 0.6159815192222595, 0.3943960666656494, 0.472845196723938,
                          0.21095198392868042], 0.8786072030227866),
    "multilingual-e5-large": ([0.9312525987625122, 0.9174501895904541, 0.8692672252655029, 0.894102156162262,
                               0.7676271796226501], 0.9153273060318389),
    "multilingual-MiniLM-L12-v2": ([0.8726427555084229, 0.6694336533546448, 0.48754918575286865,
                                    0.529693067073822, -0.19874346256256104], 0.8683660089152048),
    "gte-large": ([0.9530268907546997, 0.91476970911026, 0.809863805770874, 0.9137836694717407,
                   0.7574140429496765], 0.992452098069639),
    "nomic-embed-text-v1.5": ([0.8865452408790588, 0.7742523550987244, 0.5978057384490967, 0.7666978240013123,
                               0.44570422172546387], 0.9723780339295751),
}


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(m, i, HUMAN[i], s) for m, (sims, _) in GOLDEN.items() for i, s in enumerate(sims)]
    return spark.createDataFrame(rows, "model_name string, pair_id int, human_score double, similarity double")


def test_pearson_golden(scores):
    got = {r.model_name: r.pearson_correlation
           for r in X.pearson(scores, ["model_name"], "human_score", "similarity").collect()}
    for m, (_, p) in GOLDEN.items():
        assert abs(got[m] - p) < 1e-12, m


def test_spearman_golden(scores):
    got = {r.model_name: r.spearman_correlation
           for r in X.spearman(scores, ["model_name"], "human_score", "similarity", buckets=2).collect()}
    for m in GOLDEN:
        assert abs(got[m] - 1.0) < 1e-12, m


def test_constant_column_is_null(spark):
    df = spark.createDataFrame([("m", 0.5, float(i)) for i in range(4)], "model_name string, h double, s double")
    assert X.pearson(df, ["model_name"], "h", "s").collect()[0].pearson_correlation is None


def test_average_ranks_match_pandas(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 40, size=500).astype(float)  # many ties
    df = spark.createDataFrame([("a", float(v)) for v in vals] + [("b", float(v) * 2) for v in vals[:77]],
                               "g string, v double")
    for buckets in (1, 3, 16):
        got = {(r.g, r.v): r.rank for r in X.average_ranks(df, ["g"], "v", buckets=buckets).collect()}
        pdf = pd.DataFrame({"g": ["a"] * 500 + ["b"] * 77, "v": list(vals) + list(vals[:77] * 2)})
        pdf["r"] = pdf.groupby("g")["v"].rank(method="average")
        for g, v, r in pdf.drop_duplicates(["g", "v"]).itertuples(index=False):
            assert math.isclose(got[(g, v)], r), (g, v, buckets)


def test_spearman_vs_pandas(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 10, 300).astype(float)
    y = x + rng.normal(0, 3, 300).round(0)
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(x, y)], "model_name string, x double, y double")
    got = X.spearman(df, ["model_name"], "x", "y", buckets=4).collect()[0].spearman_correlation
    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert abs(got - want) < 1e-12
