import numpy as np
import pytest

from evalweave.operators import intervals

CLASSES = ["x", "y", "z"]
SCHEMA = "c long, truth string, pred_a string, pred_b string"


def score(truth, pred):
    f1 = []
    for k in sorted(set(truth)):
        hits, both = sum(t == p == k for t, p in zip(truth, pred)), sum(t == k for t in truth) + sum(p == k for p in pred)
        f1.append(round(2 * hits / both, 4))
    return np.array([np.mean([t == p for t, p in zip(truth, pred)]), np.mean(f1)])


def brute(rows, replicates):
    """Estimates and intervals by drawing whole clusters of rows, one replicate after the other."""
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(r)
    groups, rng = list(by.values()), np.random.default_rng(1)

    def both(x):
        truth, a, b = zip(*x)
        a, b = score(truth, a), score(truth, b)
        return np.array([a, b, a - b])

    drawn = np.array([both([r for g in rng.integers(0, len(groups), len(groups)) for r in groups[g]]) for _ in range(replicates)])
    return both([r[1:] for r in rows]), np.percentile(drawn, 2.5, axis=0), np.percentile(drawn, 97.5, axis=0)


def unbalanced():
    rng, rows = np.random.default_rng(3), []
    for c in range(60):
        hard = rng.random() < 0.5
        for _ in range(int(rng.integers(1, 9))):
            t = str(rng.choice(CLASSES, p=[0.85, 0.1, 0.05]))
            rows.append((c, t, t if t == "x" or rng.random() < 0.3 else "x", None if hard else str(rng.choice([t, "unknown"], p=[0.8, 0.2]))))
    return rows


@pytest.mark.parametrize("times, shard_kinds", [(1, 4096), (1, 8), (40, 4096)])
def test_cluster_bootstrap_of_accuracy_and_macro_f1(spark, times, shard_kinds):
    # 40 copies of few clusters: kinds are drawn by a multinomial; 8 kinds a shard: several shards
    rows = unbalanced() if times == 1 else [(c + 1000 * k, *r) for k in range(times) for c, *r in unbalanced() if c < 6]
    got = {(r["measure"], r["run"]): r for r in intervals.cluster_bootstrap(spark.createDataFrame(rows, SCHEMA), "c", CLASSES, 3000, shard_kinds=shard_kinds).collect()}
    estimate, low, high = brute(rows, 600)
    assert len(got) == 6
    for i, run in enumerate("a b delta".split()):
        for j, measure in enumerate(["accuracy", "macro_f1"]):
            g, near = got[measure, run], 0.15 * (high[i, j] - low[i, j])
            assert g["estimate"] == pytest.approx(estimate[i, j], abs=1e-12)
            assert abs(g["low"] - low[i, j]) < near and abs(g["high"] - high[i, j]) < near
    assert got["accuracy", "a"]["estimate"] - got["macro_f1", "a"]["estimate"] > 0.1


def test_cluster_bootstrap_of_odd_input(spark):
    assert intervals.cluster_bootstrap(spark.createDataFrame([], SCHEMA), "c", CLASSES).count() == 0
    for truth in ("w", None):
        with pytest.raises(ValueError, match="not a class"):
            intervals.cluster_bootstrap(spark.createDataFrame([(1, "x", "x", "x"), (1, truth, "x", "x")], SCHEMA), "c", CLASSES)
