"""Pruned similarity search against comparing all pairs."""

import numpy as np
import pytest

from stratocloud.operators import features


def _rows(spark, n=600):
    rng = np.random.default_rng(51)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * 0.15
    x[7] = x[3]  # a tie
    x[11] = -x[3] * 2
    rows = [(k, v.astype("f4").tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3), x.astype("f4").astype(float)


@pytest.mark.parametrize("itself", [True, False])
@pytest.mark.parametrize("pivots, block", [(1, 50), (20, 25), (256, 5000)])
def test_pruned_match(spark, itself, pivots, block):
    df, x = _rows(spark)
    asked = df.filter("vec_id % 3 = 0")
    found = {r["query"]: (r["other"], r["similarity"]) for r in features.pruned_match(df, asked, pivots=pivots, block_rows=block, itself=itself).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = u @ u.T
    if not itself:
        np.fill_diagonal(cosine, -np.inf)
    assert len(found) == 200
    for k, (other, similarity) in found.items():
        assert similarity == pytest.approx(cosine[k].max(), abs=1e-12)
        assert other == np.flatnonzero(cosine[k] >= cosine[k].max() - 1e-12)[0]


def test_vectors_without_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = {r["query"]: r["other"] for r in features.pruned_match(df, df.filter("vec_id IN (1, 4)"), itself=False).collect()}
    assert found == {1: 4, 4: 1}
    assert features.pruned_match(df.filter("1 = 0"), df).count() == 0


def test_blocks_of_both_sides_are_bounded(spark, monkeypatch, tmp_path):
    df, x = _rows(spark)
    wanted = {r["query"]: r["other"] for r in features.best_match(df, df, itself=False).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = u @ u.T
    np.fill_diagonal(cosine, -np.inf)
    assert len(wanted) == 600 and all(other == np.flatnonzero(cosine[k] >= cosine[k].max() - 1e-12)[0] for k, other in wanted.items())
    whole, log = features._comparison, str(tmp_path / "sizes")

    def watched(itself):
        def run(left, right):
            with open(log, "a") as f:
                f.write(f"{len(left)} {len(right)}\n")
            return whole(itself)(left, right)

        return run

    monkeypatch.setattr(features, "_comparison", watched)
    for found in (features.best_match(df, df, block_rows=60, itself=False), features.pruned_match(df, df, pivots=4, block_rows=60, itself=False)):
        assert {r["query"]: r["other"] for r in found.collect()} == wanted
    sizes = np.loadtxt(log, int)
    assert sizes.max() < 110  # about 60 of each side, of 600


def test_best_match_of_vectors_without_direction(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    found = {r["query"]: (r["other"], r["similarity"]) for r in features.best_match(df, df, itself=False).collect()}
    assert found[1][0] == 4 and found[4][0] == 1 and found[2] == (1, None) and found[3] == (1, None)


def test_spread_vectors_and_copies_are_not_multiplied(spark, monkeypatch, tmp_path):
    x = np.random.default_rng(52).normal(size=(400, 24)).astype("f4")  # no group can be left out
    x[100:160] = x[100]
    x[160:170] = x[100] * 3  # alike, but not equal
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(400, [float("nan")] * 24)], "vec_id bigint, embedding array<float>").repartition(3)
    whole, log = features._comparison, str(tmp_path / "sizes")

    def watched(itself):
        def run(left, right):
            found = whole(itself)(left, right)
            with open(log, "a") as f:
                f.write(f"{len(left)} {len(found)}\n")
            return found

        return run

    monkeypatch.setattr(features, "_comparison", watched)
    found = {r["query"]: r["other"] for r in features.pruned_match(df, df.filter("vec_id < 400"), pivots=40, block_rows=100, itself=False).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cosine = u @ u.T
    np.fill_diagonal(cosine, -np.inf)
    for k in [*range(100), *range(170, 400)]:
        assert found[k] == np.flatnonzero(cosine[k] >= cosine[k].max() - 1e-12)[0]
    assert len(found) == 400 and all(100 <= found[k] < 170 and found[k] != k for k in range(100, 170))
    sizes = np.loadtxt(log, int)
    assert sizes[:, 0].sum() <= 400 * (1 + 8)  # a query goes once to each of at most 8 blocks, not to each of 40 groups
    assert (sizes[:, 1] <= sizes[:, 0]).all()  # one row a query, not one for each copy
    few = {r["query"]: r["other"] for r in features.best_match(df, df.filter("vec_id < 400"), block_rows=100, itself=False).collect()}
    assert few == found
