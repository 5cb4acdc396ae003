"""Connected components of incidents that share reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table


ROWS_PER_FILE = 500_000


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


#: Fewer than so many nodes can hold more than 1 / HUBS of all edge ends each.
HUBS = 1000
SALTS = 64


def _hubs(pairs: DataFrame, n: int) -> list:
    """The nodes u that hold more than n / HUBS of the at most ``n`` pairs (u, v); fewer than HUBS, whatever the table holds."""
    degrees = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    return [r["u"] for r in degrees.filter(F.col("degree") > n / HUBS).select("u").collect()]


def _with_least(pairs: DataFrame, hubs: list, least: DataFrame | None = None) -> DataFrame:
    """``pairs`` (u, v) with m, the smallest v of each u, or those whose u has a row in ``least``.

    Minima are combined on the map side. The pairs of a hub are salted and its
    minimum is repeated for every salt, so that they meet in many tasks.
    """
    if least is None:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if not hubs:
        return pairs.join(least, "u")
    hub = F.col("u").isin(hubs)
    salted = pairs.withColumn("salt", F.when(hub, F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.sequence(F.lit(0), F.when(hub, SALTS - 1).otherwise(0))
    return salted.join(least.withColumn("salt", F.explode(salts)), ["u", "salt"]).drop("salt")


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _hub_edges(links: DataFrame, node: str, hub: str) -> DataFrame:
    """Edges from each member of a hub to the hub's smallest member.

    A hub of n members gives n - 1 edges, never its pairs.
    """
    members = links.select(F.col(hub).alias("u"), F.col(node).alias("v")).dropna()
    counts = members.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top"), F.count(F.lit(1)).alias("degree"))
    counts = written_table(counts.filter("m < top"))  # a hub of one member links nothing
    n = counts.agg(F.sum("degree")).first()[0] or 0
    hubs = [r["u"] for r in counts.filter(F.col("degree") > n / HUBS).select("u").collect()]
    joined = _with_least(members, hubs, counts.select("u", "m"))
    return joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _large_star(edges: DataFrame, hubs: list) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node around it."""
    joined = _with_least(_both(edges), hubs).withColumn("m", F.least("u", "m"))
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hubs: list) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them.

    The edge from a node to its smallest neighbour stays; the other neighbours
    get an edge to that one in its place.
    """
    joined = _with_least(edges, hubs)
    return joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def connected_components(
    links: DataFrame, node: str = "incident_id", hub: str = "report_id", max_rounds: int = 100
) -> DataFrame:
    """(node, component) with the smallest node id as the name of a component.

    Alternates large-star and small-star rewrites of the edge list until it no
    longer changes, which takes a number of rounds logarithmic in the size.
    Group minima are combined on the map side, and the edges of a hub are not
    gathered anywhere. Every round ends in a table in the shared folder, so lost
    executors cost one round at most.
    """
    edges = written_table(_hub_edges(links, node, hub))
    state = _fingerprint(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        # a node has no more smaller neighbours after the first star than neighbours before it
        hubs = _hubs(_both(edges), 2 * state[0])
        # no more files than the edges need; rounds never add edges
        edges = written_table(_small_star(_large_star(edges, hubs), hubs).coalesce(1 + state[0] // ROWS_PER_FILE))
        new_state = _fingerprint(edges)
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = links.select(node).dropna().distinct()
    roots = edges.select(F.col("u").alias(node), F.col("v").alias("component"))
    return nodes.join(roots, node, "left").select(node, F.coalesce("component", node).alias("component"))
