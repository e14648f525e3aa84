"""Transcripts over conversations: a role is a speaker, a turn a segment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.plans.registry import query


@query("""WITH f AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM f)
SELECT conv_id, min(turn) AS first_turn, role, count(*) AS n, sum(length(text)) AS chars FROM i GROUP BY conv_id, k, role""")
def merged_speakers(t):
    """Consecutive segments of one speaker collapse."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.withColumn("fresh", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)).withColumn("k", F.sum("fresh").over(w))
    return rows.groupBy("conv_id", "k", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).drop("k")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked_at FROM conversations""")
def carried_forward(t):
    """The last user turn, carried over the following ones."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("asked_at"))


@query("""WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) SELECT conv_id, count(*) AS speakers, round(max(n) * 1.0 / sum(n), 6) AS monologue FROM c GROUP BY 1""")
def speaker_diversity(t):
    c = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    return c.groupBy("conv_id").agg(F.count("*").alias("speakers"), F.round(F.max("n") / F.sum("n"), 6).alias("monologue"))


@query("SELECT conv_id, round(avg(CASE WHEN length(text) > 50 THEN 1.0 ELSE 0 END), 6) AS covered, max(turn) AS last_turn FROM conversations GROUP BY 1")
def segment_coverage(t):
    return t.conversations.groupBy("conv_id").agg(F.round(F.avg(F.when(F.length("text") > 50, 1.0).otherwise(0.0)), 6).alias("covered"), F.max("turn").alias("last_turn"))


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS BIGINT) AS grp FROM conversations")
def fixed_groups(t):
    """Map-reduce groups of three segments."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.floor((rn - 1) / 3).alias("grp"))
