"""Connected components of an edge table by large and small stars.

A star operation links the neighbours of a node to the smallest of them. Alternating both kinds
leaves one star for each component after few rounds. Minima are partial sums before they are
shuffled, the joins carry two columns and may be split by Spark, each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidence_engine.llm.common import Scratch, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    leaves = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return leaves.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node that is not its component's smallest; edges ``u, v``, written.

    Loops, repeated edges and missing ends change nothing.
    """
    scratch = Scratch(edges.sparkSession)
    edges = edges.select("u", "v").where("u <> v")
    now = scratch.write(edges, "edges")
    state = _state(now)
    while state[0]:
        old = scratch
        scratch = Scratch(edges.sparkSession)
        now = scratch.write(_small_star(_large_star(now)), "stars")
        old.clear()
        last, state = state, _state(now)
        if state == last:
            break
    out = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "components")
    scratch.clear()
    return out
