"""Connected components by alternating large-star and small-star.

Edges stay in DataFrames. In each round a node's least neighbour comes from a
map-side combined ``min`` and goes back to the edges by ``send``, which deals
no hub's edges to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.storage import discard, stored


#: Keys of more than 1 / HOT of all rows count as hot; there are fewer than HOT of them.
HOT = 2000


def send(rows: DataFrame, values: DataFrame, key: str, number: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has one row a key and in
    ``number`` at least the key's rows; ``total`` bounds the sum of ``number``.

    Values of hot keys, under ``HOT`` by that bound, are broadcast, so the rows
    of a hot key stay where they are; all other keys are joined by shuffle.
    """
    least = F.lit(total / HOT)
    hot = F.broadcast(values.where(F.col(number) > least))
    marks = rows.join(hot, key, "left")
    rest = marks.where(F.col(number).isNull()).select(rows.columns)
    return marks.where(F.col(number).isNotNull()).unionByName(rest.join(values.where(F.col(number) <= least), key))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def star_edges(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Turn edges (u, v) into stars: rows (u, v) where v is the least node that
    u can reach and v < u. Nodes that are least have no row; self-loops, nulls
    and repeated edges are allowed. No edges give no rows. A round's edges are
    deleted once the next ones are written."""
    spark = edges.sparkSession
    edges, path = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            return edges
        # u > v in every edge; large-star: u's greater neighbours go to the least of u and its neighbours
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = edges.union(up).groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
        large = send(up, least, "u", "n", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        # small-star: u and its lesser neighbours go to the least of them; large-star left u few of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, newer = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(spark, path)
        path = newer
        after = _state(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
