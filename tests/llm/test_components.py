import random

import numpy as np

from folio.llm.components import components, stars


def test_size_estimates_do_not_multiply(spark):
    """A long path takes many rounds; the plan's estimate stays that of a small table."""
    n = 3000
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long").repartition(3)
    found = components(links)
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 12
    assert {r.root for r in found.collect()} == {0} and found.count() == n


def test_tasks_contract_their_edges():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 400):
        a, b = rng.integers(0, 300, (2, n)) * 7 - 900
        hi, lo = stars(a, b)
        label = {int(x): int(x) for x in np.concatenate([a, b])}
        for _ in label:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                label[x] = label[y] = min(label[x], label[y])
        assert dict(zip(hi.tolist(), lo.tolist(), strict=True)) == {x: y for x, y in label.items() if x != y} and len(hi) == len(set(hi.tolist()))


def test_a_long_path_takes_few_rounds(spark):
    links = spark.range(0, 3000, 1, 6).selectExpr("(id * 7919) % 3001 a", "((id + 1) * 7919) % 3001 b").repartition(6)
    found = components(links, rounds=6).collect()
    assert len(found) == 3001 and {r.root for r in found} == {0}
