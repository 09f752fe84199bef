import numpy as np
import pytest

from vecframe.operators.nearest import nearest_join, nearest_of_few
from vecframe.schema import Metric


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("find", ["join", "few"])
def test_batch_nearest(spark, metric, find):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(9, 4)).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32)
    b[10:14] = b[3]
    qs = spark.createDataFrame([*[(i, x.tolist()) for i, x in enumerate(a)], (90, None), (91, [1.0])], "q int, v array<float>")
    ds = spark.createDataFrame([*[(f"k{i:02d}", x.tolist()) for i, x in enumerate(b)], ("z", None), ("y", [0.0] * 3)], "k string, w array<float>").repartition(4)
    x, y = a.astype(float), b.astype(float)
    dist = {Metric.IP: lambda: 1 - x @ y.T, Metric.L2: lambda: ((x[:, None] - y[None]) ** 2).sum(-1), Metric.COSINE: lambda: 1 - x @ y.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))}[metric]()
    truth = {(i, f"k{j:02d}") for i in range(9) for j in sorted(range(50), key=lambda j: (round(dist[i, j], 12), j))[:3] if dist[i, j] <= 0.9}
    run = nearest_join if find == "join" else nearest_of_few
    got = {(r["q"], r["k"]) for r in run(qs, "q", "v", ds, "k", "w", metric, 4, 3, 0.9).collect()}
    assert got == truth
    assert run(qs, "q", "v", ds.limit(0), "k", "w", metric, 4).count() == 0 and run(qs.limit(0), "q", "v", ds, "k", "w", metric, 4).count() == 0
