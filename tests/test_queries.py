import pytest

from compare import assert_same
from tracklens.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE[name], SF)


#: Row counts at sf0.001, worked out beforehand from the fixture's definition.
COUNTS = {"clean_pings": 927, "downsample_2min": 884, "going_dark": 215, "draught_change": 331, "teleport": 64, "loiter_candidates": 515, "close_pairs": 13, "encounters": 4, "vessel_scores": 15}


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_known_counts(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() == COUNTS[name]
