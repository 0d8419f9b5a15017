"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation many times, each time a few turns longer.  Each
turn gets a hash of all turns up to it; a conversation whose last hash is also
that of a turn inside a longer one is a snapshot of that one and goes, by an
anti-join, and of equal conversations the one with the smallest id stays.  What
stays is rendered.

Hashes and offsets run along a conversation without gathering it: the turns are
range-partitioned, run inside each partition, and each partition's totals carry
over to the next, so even a conversation that holds most rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as K

#: Characters of a rendered conversation that go into one row, to the end of a turn.
SEGMENT = 1_000_000
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    """Marks that stand in a text are broken, so that it cannot open or close a turn."""
    return F.replace(F.replace(text, F.lit(BEGIN), F.lit("< |im_start|>")), F.lit(END), F.lit("< |im_end|>"))


def turn_hashes(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, role, text) with place, begin (characters of the rendering before the turn), rendered, and h1 and h2, the hash of all turns up to it."""
    order = ["turn", "role", "text"]
    turns = turns.distinct().repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    rendered = F.concat(F.lit(BEGIN), _safe(F.col("role")), F.lit("\n"), _safe(F.col("text")), F.lit(END + "\n"))
    turns = K.saved(turns.withColumn("rendered", rendered))
    inside, across = Window.partitionBy("part", "conv_id").orderBy(*order), Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = turns.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.sum(F.length("rendered")).alias("size"))
    before = before.select("part", "conv_id", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("n_before"), F.coalesce(F.sum("size").over(across), F.lit(0)).alias("size_before"))
    placed = turns.withColumn("n", F.row_number().over(inside)).withColumn("size", F.sum(F.length("rendered")).over(inside)).join(before, ["part", "conv_id"])
    placed = placed.select("part", "conv_id", *order, "rendered", (F.col("n") + F.col("n_before")).alias("place"), (F.col("size") + F.col("size_before") - F.length("rendered")).alias("begin"))
    placed = K.saved(placed.withColumn("h1", F.xxhash64(F.lit(1), "place", "role", "text")).withColumn("h2", F.xxhash64("text", "role", "place", F.lit(2))))
    before = placed.groupBy("part", "conv_id").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    before = before.select("part", "conv_id", *(F.coalesce(F.bit_xor(f"x{k}").over(across), F.lit(0).cast("long")).alias(f"x{k}") for k in (1, 2)))
    inside = Window.partitionBy("part", "conv_id").orderBy("place")
    hashed = placed.withColumns({f"h{k}": F.bit_xor(f"h{k}").over(inside) for k in (1, 2)}).join(before, ["part", "conv_id"])
    return K.saved(hashed.select("conv_id", *order, "place", "begin", "rendered", *(F.col(f"h{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"h{k}") for k in (1, 2))))


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one begins with."""
    last = hashed.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    hashed = hashed.select("conv_id", "place", "h1", "h2").join(last, "conv_id")
    ends = hashed.where("place = n_turns").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = hashed.where("place < n_turns").select("place", "h1", "h2").distinct()
    return ends.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rendered maximal conversations: conv_id, segment, n_turns, text.

    Turns stand in order of turn, role and text; equal rows count once.  A null
    role is `unknown` and a null text empty; a null turn comes first.  Rows without
    a conversation id are not taken.  A conversation that begins a longer one goes;
    of equal ones the smallest id stays.  n_turns is that of the conversation; its
    text is cut after the turn that begins in each SEGMENT characters, so nearly
    all have one row, segment 0.  Other columns are not read; an empty table gives
    no rows.
    """
    turns = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hashed = turn_hashes(turns.where("conv_id is not null"))
    kept = hashed.select("conv_id", "place", "begin", "rendered").join(maximal(hashed), "conv_id")
    parts = kept.groupBy("conv_id", "n_turns", F.floor(F.col("begin") / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("place", "rendered"))).alias("turns"))
    return parts.select("conv_id", "segment", F.col("n_turns").cast("long").alias("n_turns"), F.concat_ws("", F.col("turns.rendered")).alias("text"))


def op6_chat(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM turns GROUP BY conv_id),
prefixes AS (SELECT DISTINCT turns[1:k] AS turns FROM whole, unnest(range(1, len(turns))) AS t(k)),
kept AS (SELECT min(conv_id) AS conv_id, turns FROM whole WHERE turns NOT IN (SELECT turns FROM prefixes) GROUP BY turns)
SELECT conv_id, CAST(0 AS BIGINT) AS segment, CAST(len(turns) AS BIGINT) AS n_turns,
  list_aggregate(list_transform(turns, lambda x: concat('<|im_start|>', replace(replace(x.role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>'), chr(10),
    replace(replace(x.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>'), '<|im_end|>', chr(10))), 'string_agg', '') AS text
FROM kept
"""
