"""Lineage cuts and totally ordered blocks, the two pieces that the exact distributed scans share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; where it is unset, a local one, in local mode only.

    On a cluster a folder of one machine would lose what other machines write, so there its absence is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tallgrass-checkpoint-"))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it from there: a lost executor repeats no upstream work."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_blocks(df: DataFrame, order: Sequence[str | Column], blocks: int | None = None) -> DataFrame:
    """Range-partition ``df`` into blocks of about equal size, sorted by ``order`` across and within blocks.

    Adds ``_block`` (0, 1, ... in order) and ``_pos`` (place in the block, from 0). Ties are split between
    blocks by the place a row had in the input, so that a third of all rows may be copies of one row and still no
    block holds more than its share. The result is checkpointed, hence stable for the joins that follow.
    """
    ties = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col("_tie")]
    ranged = ties.repartitionByRange(blocks or shuffle_width(df.sparkSession), *by).sortWithinPartitions(*by)
    return settle(
        ranged.drop("_tie")
        .withColumn("_block", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)))
    )
