"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.store import stored as cut


def least_count(counts: DataFrame, most: int) -> int:
    """The least n that at most `most` rows of a table reach, so that no rows are sorted to find the most frequent.

    Counts of like size (a sixteenth of a power of two) are taken together.
    """
    sizes = counts.groupBy(F.floor(F.log2("n") * 16).alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("size")).collect()
    total, least = 0, 2**62
    for r in sizes:
        total += r["rows"]
        if total > most:
            break
        least = math.ceil(2 ** (r["size"] / 16) - 1e-6)
    return least


#: Rows of one key that a task may join.
HOT_ROWS = 10_000
#: No more keys than this count as hot; their list is broadcast.
HOT_KEYS = 100_000
#: Parts that the rows of a hot key are dealt over.
SALTS = 64


def dealt_join(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """rows joined to a table with one row a key; the rows of a key that very many share are dealt over several tasks."""
    most = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = cut(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*key))
    if hot.isEmpty():
        return rows.join(table, key)
    marked = hot.withColumn("hot", F.lit(True))
    salted = rows.join(F.broadcast(marked), key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = table.join(F.broadcast(marked), key, "left").withColumn("salt", F.explode(salts)).drop("hot")
    return salted.join(spread, [*key, "salt"]).drop("salt")


#: Edges a task works on, about; small graphs need few tasks a step.
ROWS_A_TASK = 200_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots themselves: root is the smallest node reachable.

    Each round turns the edges into stars around smaller nodes; it ends when a round changes
    nothing, and then every edge joins a node to the smallest node of its component. The grouping is
    a minimum a node, which Spark combines before the shuffle, and a join; no neighbourhood is
    collected. The edges shrink to one a node.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, tasks = state, 1 + state[0] // ROWS_A_TASK
        # Large star: each node's larger neighbours move to the smallest of its neighbours and itself.
        now = now.coalesce(tasks)
        join = (lambda rows, table: dealt_join(rows, table, ["u"])) if state[0] > HOT_ROWS else (lambda rows, table: rows.join(table, "u"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = join(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)
        # Small star: each node and its smaller neighbours move to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        moved = join(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
    raise RuntimeError("components did not settle")
