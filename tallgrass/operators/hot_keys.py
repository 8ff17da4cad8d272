"""Per-key results when a handful of keys hold most rows: exact offset chunking.

Rows are range-partitioned by (key, order), counted per block and key, and the counts are prefix-summed, so
that each row learns its exact number within its key. Numbers are cut into chunks of equal size; each chunk is
reduced on its own to a small state, and the states of a key are merged in order. A key of any size is thus
spread over as many tasks as it has chunks, and what meets in one task is one state per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.staging import ROW_BITS, ordered_blocks, settle

CHUNK_ROWS = 100_000
FEW_STARTS = 100_000  # (partition, hot key) pairs that are sent to every task; more of them are joined by a shuffle
FIELDS = ("SeedName", "target")


def stack_keys(df: DataFrame, fields: tuple[str, ...], keep: list[str]) -> DataFrame:
    """One row per input row and field: (field, key_value, *keep)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("key_value")) for f in fields])
    return df.select(F.explode(pairs).alias("_p"), *keep).select("_p.field", "_p.key_value", *keep)


def number_rows(df: DataFrame, keys: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """``df`` with ``_number``, each row's place (from 0) within its key in the given order.

    The only rows that meet in one task are the (block, key) counts of one key, at most one per block.
    """
    placed = ordered_blocks(df, [*keys, *order], blocks)
    counts = placed.groupBy("_block", *keys).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    offsets = offsets.withColumnsRenamed({k: f"_k_{k}" for k in keys}).withColumnRenamed("_block", "_b")
    on = (F.col("_block") == F.col("_b")) & F.expr(" and ".join(f"{k} <=> _k_{k}" for k in keys))
    return (
        placed.join(offsets, on)
        .withColumn("_number", F.col("_offset") + F.col("_pos") - F.col("_first"))
        .drop("_b", "_offset", "_first", "_block", "_pos", *[f"_k_{k}" for k in keys])
    )


def chunk_states(cells: DataFrame, fields: tuple[str, ...] = FIELDS, chunk_rows: int = CHUNK_ROWS, blocks: int | None = None) -> DataFrame:
    """One state per key and chunk of ``chunk_rows`` rows in the order of ``bin``.

    Columns: field, key_value, chunk, rows, posts, s_sum, s2_sum, bins, first_bin, last_bin, widest (micros
    between neighbouring bins of the chunk). A null ``n`` counts no posts, null sums add nothing, a null ``bin``
    counts as a row and as no bin.
    """
    rows = stack_keys(cells, fields, ["bin", "n", "s_sum", "s2_sum"]).withColumn(
        "_us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(bin as timestamp_ntz))")
    )
    keys = ["field", "key_value"]
    numbered = number_rows(rows.drop("bin"), keys, ["_us"], blocks).withColumn("chunk", F.floor(F.col("_number") / chunk_rows))
    last = F.lag("_us").over(Window.partitionBy(*keys, "chunk").orderBy("_number"))
    step = numbered.withColumn("_last", last)
    return step.groupBy(*keys, "chunk").agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("posts"),
        F.coalesce(F.sum("s_sum"), F.lit(0.0)).alias("s_sum"),
        F.coalesce(F.sum("s2_sum"), F.lit(0.0)).alias("s2_sum"),
        F.count_if(F.col("_us").isNotNull() & (F.col("_last").isNull() | (F.col("_last") != F.col("_us")))).alias("bins"),
        F.min("_us").alias("first_bin"),
        F.max("_us").alias("last_bin"),
        F.max(F.col("_us") - F.col("_last")).alias("widest"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """Chunk states merged in order: one row per field and key.

    A bin cut by a chunk's edge counts once; the gap across an edge competes for the widest. Columns: field,
    key_value, rows, posts, s_sum, s2_sum, bins, first_bin, last_bin (micros since 1970, null without any bin)
    and widest_gap_days.
    """
    keys = ["field", "key_value"]
    before = F.max("last_bin").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    edge = states.withColumn("_edge", before)
    return edge.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.sum("posts").alias("posts"),
        F.sum("s_sum").alias("s_sum"),
        F.sum("s2_sum").alias("s2_sum"),
        (F.sum("bins") - F.count_if(F.col("_edge") == F.col("first_bin"))).alias("bins"),
        F.min("first_bin").alias("first_bin"),
        F.max("last_bin").alias("last_bin"),
        (F.max(F.greatest("widest", F.col("first_bin") - F.col("_edge"))) / 86_400_000_000).alias("widest_gap_days"),
    )


def key_totals(cells: DataFrame, fields: tuple[str, ...] = FIELDS, chunk_rows: int = CHUNK_ROWS, blocks: int | None = None) -> DataFrame:
    """Totals of every key of every field, whole and exact whatever the skew.

    Null and blank keys are kept as they stand (they count in the whole). Repeated rows count as often as they are
    stored; portions of one cell are added up and count as one bin. An empty table gives no rows; other columns
    of ``cells`` are ignored.
    """
    return merge_states(chunk_states(cells, fields, chunk_rows, blocks))


def stored_chunks(rows: DataFrame, keys: list[str], sums: dict[str, Column], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One state per key and chunk of ``chunk_rows`` rows in stored order: keys, chunk, rows and the sums.

    For totals that no order changes: rows stay in their input partition. Keys are counted per input partition, prefix
    sums over partitions give each partition's first number of a key, and a local sort gives the rest. Only keys of more
    than one chunk need numbers. ``rows`` come from a table or a settled frame, whose partitions are the same when read
    again; elsewhere chunks may be uneven, but a row is in just one chunk whatever its number, so totals never change.
    """
    placed = rows.withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    ahead = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(ahead(*keys).orderBy("_part")), F.lit(0))
    first = F.coalesce(F.sum("_n").over(ahead("_part").orderBy(*keys)), F.lit(0))
    starts = counts.withColumns({"_offset": offset, "_first": first, "_all": F.sum("_n").over(Window.partitionBy(*keys))}).where(F.col("_all") > chunk_rows)
    starts = settle(starts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_offset") - F.col("_first")).alias("_shift")))
    starts = F.broadcast(starts) if starts.count() <= FEW_STARTS else starts
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    numbered = placed.sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)))
    chunk = F.coalesce(F.floor((F.col("_pos") + F.col("_shift")) / chunk_rows), F.lit(0))
    return numbered.join(starts, on, "left").groupBy(*keys, chunk.alias("chunk")).agg(F.count("*").alias("rows"), *[F.sum(c).alias(n) for n, c in sums.items()])


def heavy_keys(cells: DataFrame, percent: int = 2, fields: tuple[str, ...] = FIELDS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keys with at least ``percent`` of the rows or of the posts: (field, key_value, measure).

    The counts depend on no order, so rows are chunked where they lie (``stored_chunks``) and never sorted as a whole.

    Shares are of the whole table, blank and null keys included, though these are no keys themselves. The
    comparison is in integers, so that a share of exactly ``percent`` counts.
    """
    states = stored_chunks(stack_keys(cells, fields, ["n"]), ["field", "key_value"], {"posts": F.coalesce("n", F.lit(0))}, chunk_rows)
    totals = settle(states.groupBy("field", "key_value").agg(F.sum("rows").alias("rows"), F.sum("posts").alias("posts")))
    whole = totals.groupBy("field").agg(F.sum("rows").alias("_rows"), F.sum("posts").alias("_posts"))
    named = totals.where(F.length(F.regexp_replace("key_value", r"[\s\p{Z}]+", "")) > 0)
    both = named.join(F.broadcast(whole), "field")  # one row per field
    measures = F.array(
        F.when(F.col("rows") * 100 >= F.col("_rows") * percent, F.lit("rows")),
        F.when((F.col("posts") * 100 >= F.col("_posts") * percent) & (F.col("_posts") > 0), F.lit("posts")),
    )
    return both.select("field", "key_value", F.explode(F.array_compact(measures)).alias("measure"))
