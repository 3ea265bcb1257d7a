"""The models of the registered queries grow as many trees as the reference's, of its shape."""
from tapeloom.operators import models as md


def test_settings():
    assert (md.RETURN.trees, md.RETURN.depth, md.RETURN.rate, md.RETURN.rows, md.RETURN.columns) == (400, 4, 0.04, 0.8, 0.8)
    assert (md.OUTCOME.trees, md.OUTCOME.rate, md.OUTCOME.columns, md.OUTCOME.least_weight, md.OUTCOME.logistic) == (300, 0.05, 0.7, 30.0, True)
    assert (md.META.trees, md.META.rate, md.META.columns, md.META.logistic) == (400, 0.04, 0.8, True)
    assert (md.EVENT.trees, md.EVENT.rate, md.EVENT.columns, md.EVENT.logistic) == (300, 0.05, 0.8, True)
