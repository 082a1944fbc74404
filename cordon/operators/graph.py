"""Reachability within a zone as a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame


def reachable(zone: DataFrame, adjacency: DataFrame) -> DataFrame:
    """One row: how many of the zone's blocks (block_id) are reached from its smallest, its size, and whether it is connected.

    The recursion is bounded by the zone's size, counted first; zones are small. Sets of
    blocks, not paths, go from step to step, so that rows don't multiply.
    """
    spark = zone.sparkSession
    depth = max(1, zone.distinct().count())
    return spark.sql(
        """with recursive inner_edges as (select distinct src, dst from {adjacency} left semi join {zone} a on src = a.block_id left semi join {zone} b on dst = b.block_id),
steps as (select src, collect_set(dst) as to from inner_edges group by src),
near as (select map_from_entries(collect_list(struct(src, to))) as m from steps),
reach(level, seen) as (
  select 0, array(min(block_id)) from {zone}
  union all
  select level + 1, array_distinct(concat(seen, flatten(transform(seen, x -> coalesce(element_at(m, x), array()))))) from reach cross join near where level < {depth} - 1
)
select cast(max(size(seen)) as bigint) as reached, {depth} as size, max(size(seen)) = {depth} as connected from reach""",
        adjacency=adjacency, zone=zone.distinct(), depth=depth,
    )
