"""Chat formatting with cumulative-snapshot collapse, DataFrame operations only.

A chat log often holds the same conversation several times, each time a few turns
longer.  Rolling hashes of all turn prefixes find the conversations that are a
prefix of a longer one; an anti-join keeps the maximal ones, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.shared import durable, table

#: Turn numbers of one conversation that are numbered and hashed together.
CHUNK_TURNS = 1024
#: Turns in one rendered part; only longer conversations have several parts.
PART_TURNS = 512
LANES = ("_h0", "_h1", "_h2", "_h3")


def _prefix(values: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """Per-chunk sums turned into what lies before each chunk of a conversation."""
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return values.select(F.col("conv_id").alias("_c"), F.col("_chunk").alias("_k"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{key}{n}") for n in names])


def _same_chunk() -> Column:
    return F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_chunk") == F.col("_k"))


def number_turns(log: DataFrame) -> DataFrame:
    """Turns with their position (from 1) and the rolling hash of the prefix that ends there.

    The hash is a sum of turn hashes keyed by position in four 32-bit lanes, so it is
    computed as a prefix sum over chunks: a conversation of any length is spread over tasks.
    """
    turns = log.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    turns = turns.withColumn("_chunk", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS).cast("long"), F.lit(-(2**62))))
    inside = Window.partitionBy("conv_id", "_chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    counts = turns.groupBy("conv_id", "_chunk").agg(F.count("*").alias("_n"))
    placed = (
        turns.withColumn("_rn", F.row_number().over(inside))
        .join(_prefix(counts, "_b", ("_n",)), _same_chunk())
        .withColumn("pos", F.col("_rn") + F.col("_b_n"))
        .drop("_c", "_k", "_rn", "_b_n")
        .withColumn("_md5", F.md5(F.concat(F.col("pos"), F.lit(":"), F.length("role"), F.lit(":"), F.col("role"), F.col("text"))))
    )
    lanes = [F.conv(F.substring("_md5", 8 * i + 1, 8), 16, 10).cast("long").alias(n) for i, n in enumerate(LANES)]
    placed = placed.select("conv_id", "_chunk", "pos", "role", "text", *lanes)
    sums = placed.groupBy("conv_id", "_chunk").agg(*[F.sum(n).alias(n) for n in LANES])
    running = Window.partitionBy("conv_id", "_chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(_prefix(sums, "_b", LANES), _same_chunk()).select("conv_id", "pos", "role", "text", *[(F.sum(n).over(running) + F.col(f"_b{n}")).alias(n) for n in LANES])


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>"))


def collapse_and_render(log: DataFrame) -> DataFrame:
    """Maximal conversations as chat text: conv_id, part, n_turns, chat.

    Turns lie in the order turn (null first), role, text; exact repeats of a row count
    once.  A null role or text equals the empty string, a null conv_id is a conversation
    of its own.  A conversation goes when its turns (role, text) are a proper prefix of
    another's; of equal ones the smallest conv_id stays (null last).  Up to 512 turns make
    one part; chat of part 0, 1, ... joined by newlines is the whole.  Texts of any length
    are kept whole; other columns are ignored; an empty log gives no rows.
    """
    turns = durable(number_turns(log), "chat-turns")
    ends = turns.groupBy(F.col("conv_id").alias("_id")).agg(F.max("pos").alias("n_turns"))
    marked = turns.select("conv_id", "pos", *LANES).join(ends, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    longer = marked.filter("pos < n_turns").select("pos", *LANES).distinct()
    whole = marked.filter("pos = n_turns").groupBy("pos", *LANES).agg(F.min("conv_id").alias("_keep"))
    kept = durable(whole.join(longer, ["pos", *LANES], "left_anti").select("_keep", F.col("pos").alias("n_turns")), "chat-kept")
    return (
        turns.join(kept, F.col("conv_id").eqNullSafe(F.col("_keep")))
        .groupBy("conv_id", F.floor((F.col("pos") - 1) / PART_TURNS).cast("long").alias("part"), "n_turns")
        .agg(F.array_sort(F.collect_list(F.struct("pos", render_turn(F.col("role"), F.col("text")).alias("t")))).alias("_turns"))
        .select("conv_id", "part", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.col("_turns.t"), "\n").alias("chat"))
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
        count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
p AS (SELECT conv_id, pos, n_turns, role, text,
        string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM n),
longer AS (SELECT DISTINCT pos, prefix FROM p WHERE pos < n_turns),
whole AS (SELECT prefix, pos, min(conv_id) AS conv_id FROM p WHERE pos = n_turns GROUP BY prefix, pos),
kept AS (SELECT conv_id FROM whole w WHERE NOT EXISTS (SELECT 1 FROM longer l WHERE l.pos = w.pos AND l.prefix = w.prefix))
SELECT n.conv_id, CAST((n.pos - 1) // 512 AS BIGINT) AS part, n.n_turns,
       string_agg('<|im_start|>' || n.role || chr(10) || n.text || '<|im_end|>', chr(10) ORDER BY n.pos) AS chat
FROM n JOIN kept ON n.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY ALL
"""
