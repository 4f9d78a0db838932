import numpy as np

from ledgerloom.llm import quality
from ledgerloom.llm.queries import QUERIES
from tests.llm.samples import awkward, empty


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op2_quality"](spark, folder).collect()
    held = [r for r in rows if r.held_out and label.get(r.doc_id) is not None]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    machine = quality.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 3)))
    index, value = np.array([2, 5, 11, 19]), np.array([0.5, 1.0, -0.3, 2.0])
    pairs = sum(machine.v[index[i]] @ machine.v[index[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    logit = 0.3 + machine.w[index] @ value + pairs
    assert abs(machine.score(index, value) - 1 / (1 + np.exp(-logit))) < 1e-12


def test_pairs_are_learnt():
    """Labels that only the pair of two features tells."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([a, 2 + b]), np.ones(2)))
        labels.append(float(a == b))
    machine = quality.fit(rows, np.array(labels), size=4, factors=4, epochs=60)
    assert np.mean([(machine.score(*r) > 0.5) == y for r, y in zip(rows, labels)]) > 0.98


def test_awkward(spark):
    frame, rows = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4, 12)] + [(None, 1), (1, None), (4, 0)], "doc_id long, quality int")
    got = quality.score_quality(frame, quality.train(frame, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = quality.train(frame, labels.limit(0))
    assert {r.score for r in quality.score_quality(frame, none).collect()} == {0.5}
    assert quality.score_quality(empty(spark), none).collect() == []
