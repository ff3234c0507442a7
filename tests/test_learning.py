import pytest

from rallygrid import ml
from rallygrid.plans import learning

SF = "/root/testdata/sf0.001"


@pytest.fixture
def built(monkeypatch):
    """(trees, features) of each boosted model that a query sets up; two trees are fitted."""
    seen, real = [], ml.boosted_trees

    def small(features, **kw):
        pipeline = real(features, **kw)
        trees = pipeline.getStages()[-1]
        seen.append((trees.getMaxIter(), trees.getStepSize(), trees.getMaxDepth(), tuple(features)))
        trees.setMaxIter(2)
        return pipeline

    monkeypatch.setattr(learning, "boosted_trees", small)
    return seen


def test_gbt_scores_trains_all_trees(spark, built):
    scored = learning.gbt_scores(spark, SF)
    assert scored.filter("p between 0 and 1").count() == scored.count() > 0
    assert built == [(300, 0.05, 4, learning.FEATURES)]


@pytest.mark.parametrize(
    "name, models", [("calibrated_scores", 1), ("walk_forward_metrics", 5), ("feature_importance", 1)]
)
def test_evaluations_are_of_boosted_trees(spark, built, name, models):
    assert getattr(learning, name)(spark, SF).count() > 0
    assert built == [(300, 0.05, 4, learning.FEATURES)] * models


def test_ablation_has_all_sets(spark, built):
    got = {r.feature_set for r in learning.ablation_metrics(spark, SF).collect()}
    assert got == set(learning.SETS) and len(got) == 9
    assert [b[0] for b in built] == [300] * 9 and dict(zip(learning.SETS, [b[3] for b in built])) == learning.SETS


def test_wide_rows_know_only_the_past(spark):
    rows = learning._wide_rows(spark, "/root/testdata/sf0.001")
    assert rows.count() == learning._rows(spark, SF).count()
    a, b = rows.filter("target = 1"), rows.filter("target = 0")
    mirrored = a.alias("a").join(b.alias("b"), "history_id").filter("not (a.delta_win_pct_5 <=> -b.delta_win_pct_5)")
    assert mirrored.count() == 0
    assert rows.filter("delta_win_pct_5 is not null and delta_rank is not null").count() > 0
    # Knowing the result of the match itself would tell it.
    assert rows.selectExpr("corr(delta_win_pct_5, target)").first()[0] < 0.9
