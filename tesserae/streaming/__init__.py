"""Row-local steps on streams of instances. The domain has no event time, so there are no windows and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.instances import keep_core, to_global, touch_flags


def place_instances(instances: DataFrame, tile_size: int = 512) -> DataFrame:
    """Instances of arriving tiles in slide coordinates with edge flags, cut to the cores of their tiles. Every step looks at one
    row, so the same plan runs on a batch and on a stream."""
    return keep_core(touch_flags(to_global(instances)), tile_size)
