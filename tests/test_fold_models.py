"""Every walk-forward fold has out-of-fold predictions."""

from tidemark import registry

SF = "/root/testdata/sf0.001"


def test_each_fold_is_fitted(spark):
    folds = {r.fold for r in registry.QUERIES["s1_walk_forward"](spark, SF).collect()}
    got = {r.fold for r in registry.QUERIES["m2_fit_folds"](spark, SF).select("fold").distinct().collect()}
    assert len(folds) > 2 and got == folds
