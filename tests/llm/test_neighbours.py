"""Recall against brute force, with and without a vector of very large norm."""

import numpy as np
import pytest

from cueweave.llm import neighbours


@pytest.mark.parametrize("outlier", [1.0, 1e4, 1e8])
def test_recall_holds_beside_a_very_long_vector(spark, outlier):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[-1] *= outlier
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    rows = neighbours.search(frame.where("vec_id % 20 = 0"), neighbours.index(frame, 10), 10).collect()
    scores = v @ v.T
    np.fill_diagonal(scores, -np.inf)
    true = np.argsort(-scores, 1)[:, :10]
    assert len(rows) == 750
    assert sum(r["vec_id"] in true[r["query_id"]] for r in rows) / len(rows) > 0.95
