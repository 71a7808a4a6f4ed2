"""Every query on empty tables: no crash, and no rows but those of fixed reports."""

import pytest
from pyspark.sql import functions as F

from stayrate.plans import catalogue
from tests.conftest import TEST_DATA

#: Fits have nothing to learn from; they say so.
FITS = {"standardise", "logistic_select", "gbt_grid", "model_comparison", "feature_importance", "risk_scores_boosted"}


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("orders", "lineitem", "customer", "part"):
        spark.read.parquet(f"{TEST_DATA}/{name}.parquet").where(F.lit(False)).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(autouse=True)
def one_partition(confs):
    confs(spark__sql__shuffle__partitions="1")


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - FITS))
def test_query_on_empty_tables(spark, nothing, name):
    found = catalogue.QUERIES[name](spark, nothing)
    assert len(found.collect()) < 40 and found.columns


@pytest.mark.parametrize("name", sorted(FITS))
def test_fits_on_empty_tables_say_so(spark, nothing, name):
    with pytest.raises(ValueError, match="no rows"):
        catalogue.QUERIES[name](spark, nothing).collect()
