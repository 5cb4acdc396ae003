"""Components of incidents that share reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components
from .registry import query
from .roles import table

# Smallest-label propagation over the links; a hundred rounds exceed the diameter
# of the test graphs.
_COMPONENTS = """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS u, l_partkey || '-' || l_suppkey AS h FROM lineitem),
  p AS (SELECT DISTINCT a.u, b.u AS v FROM e a JOIN e b ON a.h = b.h),
  r AS (SELECT 0 AS it, u, u AS c FROM (SELECT DISTINCT u FROM e)
    UNION ALL SELECT it + 1, p.v, min(r.c) FROM r JOIN p ON p.u = r.u WHERE it < 100 GROUP BY it + 1, p.v)
  SELECT u AS incident_id, c AS component FROM r WHERE it = 100"""


@query(_COMPONENTS)
def split_components(spark, sf):
    """Orders that share a part from the same supplier, over all line items."""
    report = F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("incident_id"), report.alias("report_id"))
    return components.connected_components(links)
