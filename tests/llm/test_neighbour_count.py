"""Every query gets k neighbours while the table has them."""

import numpy as np

from cuewright.llm import neighbours as N


def test_lists_of_few_vectors_are_widened(spark):
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(100, 16)), 4, axis=0) + 1e-4 * r.normal(size=(400, 16))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(400)], "vec_id long, embedding array<double>")
    lists, _ = N.build(df, sample=100_000)
    assert min(n for n in lists.sizes if n) < 300
    few = np.full(len(lists.sizes), 3)
    lists.sizes = few
    assert [len(p) for p in lists.probed(lists.rotate(x[:2]), 1, np.array([6, 7]))] == [2, 3]
    got = {}
    for row in N.search(df, df.filter("vec_id < 40"), k=150, probes=1).collect():
        got.setdefault(row.query_id, []).append(row["rank"])
    assert {q: sorted(v) for q, v in got.items()} == {q: list(range(1, 151)) for q in range(40)}
