"""Every registered query of the tissue-image library against its SQL on the smallest tables."""

import pytest

from tesserae import plans

from .conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, DATA).toPandas()
    assert len(found), name
    if name in plans.ORACLE:
        wanted = duck.execute(plans.ORACLE[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found) == rows_of(wanted)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["j1_bbox_pairs", "j5_points_in_polygons", "j15_dilate_tiles", "d3_local_maxima"])
def test_no_cross_join(spark, name):
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


PIXELS = ["a9_pairwise_iou", "a10_panoptic_quality", "a10_panoptic_quality_optimal", "a11_aggregated_jaccard", "a12_aggregated_jaccard_plus", "a13_detection_scores", "a14_prediction_first_quality", "a15_all_scores", "entry_scores", "j8_unmatched", "w1_remap_labels", "w5_mosaic_2x2", "j15_dilate_tiles", "i17_filter_tissue_tiles"]


@pytest.mark.parametrize("name", PIXELS)
def test_tables_of_pixels_and_tiles_are_not_broadcast(spark, name):
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # Numbers of tiles come by ranges, a table of a row for each, which may be broadcast.
    assert plan.count("BroadcastExchange") <= 2 * (name == "w5_mosaic_2x2")
