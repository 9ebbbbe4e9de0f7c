"""Every registered query without a SQL oracle runs and returns its rows (sf0.001)."""
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

ROWS_ONLY = sorted(set(E.queries()) - set(E.oracle_sql()))

#: Rows that follow from a query's parameters: learning rates x folds, cells, features, numbers of topics.
ROWS = {"k1_logreg_cv": 15, "k12_grid_search": 200, "k12_grid_subsample": 54, "k12_grid_forest": 72, "k13_random_search": 100, "k9_kernel_grid": 75,
        "k5_importances": 4, "k19_permutation": 4, "j6_rfe": 4, "j12_sweep": 19, "j12_sweep_lsi": 19}


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    n = E.queries()[name](spark, SF_SMALL).count()
    assert n == ROWS[name] if name in ROWS else n > 0
