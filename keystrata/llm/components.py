"""Connected components of a distributed list of links: alternating large-star and small-star rounds.

Links are reduced to pairs (a, b) with b <= a.  A large-star round links every larger neighbour of a
vertex to the smallest vertex around it, a small-star round does so for the smaller ones; the rounds end
when the links no longer change, as stars around each component's smallest vertex.  Minima are
pre-aggregated before each shuffle, so a vertex with a third of all links is one row a task; ``hand_back``
splits the joins that hand a minimum back.  Each round is checkpointed in the shared folder, so lost
executors cost a round at most and no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


#: Rows of one key that a join takes in one task.
CROWD = 1 << 20


def hand_back(rows: DataFrame, found: DataFrame, key: str, crowd: int = CROWD) -> DataFrame:
    """``rows`` joined by ``key`` with ``found``, which has one row a key and in ``n`` how many rows the key has.

    A key of more than ``crowd`` rows meets its value in n / crowd places, by the rows' hashes.  What is
    broadcast is one row for each ``crowd`` rows at most.  ``n`` and the place are not returned.
    """
    places = F.ceil(F.col("n") / crowd).cast("int")
    many = found.where(F.col("n") > crowd).select(key, places.alias("places"))
    place = F.pmod(F.xxhash64(F.lit("place"), *rows.columns), F.coalesce("places", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(many), key, "left").withColumn("place", place).drop("places")
    copies = found.withColumn("place", F.explode(F.sequence(F.lit(0), places - 1))).drop("n")
    return dealt.join(copies, [key, "place"]).drop("place")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def connected_components(links: DataFrame, a: str = "a", b: str = "b", crowd: int = CROWD) -> DataFrame:
    """(vertex, component): for each vertex of a link, the smallest vertex it can reach.

    Null ends and self links are ignored; repeated links count once; no links give no rows.
    """
    shared_dir(links.sparkSession)
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct().checkpoint()
    state = _state(links)
    while state[0]:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        links = hand_back(around.where(F.col("v") > F.col("u")), least, "u", crowd).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hand_back(links, least, "a", crowd)
        links = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).union(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(links.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
