"""How the indices of the nearest-neighbour search are chosen, and what that costs on larger tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiatscan.llm import ann


def directions(n, dims=64, seed=3):
    """Unit vectors without any order, the hardest case for an index."""
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_made(coder, total):
    return total * coder.substrings + total // ann.EVERY * coder.substrings * coder.probes


def test_rows_made_for_five_times_the_vectors():
    """Indices and probes take less than 50 rows a vector, and for five times the vectors less than twelve times the rows; nine of ten neighbours are found."""
    x = directions(51_282)
    made = {}
    for total in (10_256, 51_282):
        sample = x[:4096]
        coder = ann.learn(sample, 1.0, total)
        made[total] = rows_made(coder, total)
        asked, held = ann.projected_queries(x[:total:200], coder), ann.projected(x[:total], coder)
        looked, own = ann.probe_values(asked, coder), ann.values(held, coder)
        scores = x[:total:200] @ x[:total].T
        scores[np.arange(len(asked)), np.arange(len(asked)) * 200] = -np.inf
        best = np.argpartition(-scores, 19, axis=1)[:, :20]
        found = [[any(own[c, k] in looked[q, k] for k in range(coder.substrings)) for c in row] for q, row in enumerate(best)]
        assert np.mean(found) > 0.9
    assert made[51_282] < min(12 * made[10_256], 50 * 51_282)


def test_wide_codes_keep_their_coverage():
    """Where a table asks for substrings so wide that not all their values can be probed, narrower ones find the share of neighbours."""
    x = directions(4096)
    coder = ann.learn(x, 1.0, 1 << 26)
    asked, held = ann.projected_queries(x[:400], coder), ann.projected(x, coder)
    looked, own = ann.probe_values(asked, coder), ann.values(held, coder)
    scores = x[:400] @ x.T
    scores[np.arange(400), np.arange(400)] = -np.inf
    best = scores.argmax(1)
    assert np.mean([(own[c] == looked[q].T).any() for q, c in enumerate(best)]) > 0.95


@pytest.mark.parametrize("n", [3, 900])
def test_nearest_of_all(spark, n):
    x = directions(n, 8)
    classes = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "c long, embedding array<double>").repartition(5)
    own = np.arange(min(n, 30))
    got = ann.nearest_of_all(classes.withColumn("more", F.lit(1)), 7 * own, x[own], 20)
    scores = x[own] @ x.T
    scores[own, own] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(20, n - 1)]
    assert np.allclose(got, x[best])
