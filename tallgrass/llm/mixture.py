"""Sources mixed to target shares of the size in tokens, by systematic sampling with capped repeats.

Expected copies are prefix-summed within each source, one random offset is added, and a document is emitted once for
each whole number that its stretch of the sum crosses. Documents lie in the order of their size, so that every size
contributes its part and the tokens reached stay close to the tokens wanted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.staging import ordered_blocks, settle

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT = 1 << 30  # one copy, as an integer: sums are exact, and as only their remainders matter, they never grow past 64 bits
MAX_SOURCES = 10_000


def _count_tokens(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in batch["text"]]
            yield batch[["source", "doc_id"]].assign(tokens=sizes, order=batch["order"].to_numpy())

    return run


def sized_texts(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each text of a listed source once: source, doc_id (of one of its copies), tokens and a hash to order by.

    ``source`` is compared without case and outer blanks. A text that stands under several documents or sources is
    one text, kept under the first source by name, so that no text can exceed its repeats through copies. Null and
    blank texts and sources without a target are left out.
    """
    tidy = F.lower(F.btrim(F.regexp_replace("source", r"[\s\p{Z}]+", " ")))
    listed = targets.select(tidy.alias("source")).distinct()
    rows = documents.select("doc_id", tidy.alias("source"), "text").where(F.length(F.regexp_replace("text", r"[\s\p{Z}]+", "")) > 0)
    rows = rows.join(F.broadcast(listed), "source", "left_semi")  # at most MAX_SOURCES rows, checked by _targets
    once = rows.groupBy("text").agg(F.min(F.struct("source", "doc_id")).alias("_f")).select("_f.source", "_f.doc_id", "text", F.xxhash64("text").alias("order"))
    return once.mapInPandas(_count_tokens(tokenizer), "source string, doc_id bigint, tokens bigint, order bigint")


def plan_rates(sizes: list[tuple[str, int]], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, float]:
    """Expected copies per document of each source.

    Without ``total`` the mixture is as large as the repeats allow: the scarcest source is used up. A source without
    any tokens is left out and the other shares keep their proportions. A larger ``total`` than possible is cut.
    """
    have = {s: n for s, n in sizes if n > 0}
    want = {s: (share, cap) for s, share, cap in targets if s in have and share and share > 0 and cap and cap > 0}
    whole = sum(share for share, _ in want.values())
    if not want:
        return {}
    most = min(cap * have[s] * whole / share for s, (share, cap) in want.items())
    size = most if total is None else min(total, most)
    return {s: min(size * share / whole / have[s], float(cap)) for s, (share, cap) in want.items()}


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    tidy = F.lower(F.btrim(F.regexp_replace("source", r"[\s\p{Z}]+", " ")))
    rows = targets.where("source is not null").groupBy(tidy.alias("source")).agg(F.max("target_share"), F.max("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return [tuple(r) for r in rows]


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER, blocks: int | None = None) -> DataFrame:
    """The mixture: source, doc_id, tokens (of one copy), copies (1 to the source's ``max_repeats``).

    Texts that get no copy don't appear. A document's copies differ from the expected number by less than one. An empty
    corpus or target list gives no rows.
    """
    spark = documents.sparkSession
    wanted = _targets(targets)
    sized = settle(sized_texts(documents, targets, tokenizer))
    sizes = [tuple(r) for r in sized.groupBy("source").agg(F.sum("tokens")).collect()]  # at most one row per target
    rates = plan_rates(sizes, wanted, total)
    step = [(s, int(rate * UNIT)) for s, rate in rates.items()]
    steps = F.broadcast(spark.createDataFrame(step, "source string, _step bigint"))  # at most MAX_SOURCES rows
    placed = ordered_blocks(sized.join(steps, "source"), ["source", "tokens", "order"], blocks)
    # a whole copy more or less ahead of a document moves both ends of its stretch alike, so remainders do
    part = lambda n: F.pmod(F.pmod(n, F.lit(UNIT)) * F.pmod(F.col("_step"), F.lit(UNIT)), F.lit(UNIT))
    parts = placed.groupBy("_block", "source", "_step").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum(part(F.col("_n"))).over(before), F.lit(0))).drop("_n", "_step")
    summed = placed.join(F.broadcast(parts), ["_block", "source"])  # at most blocks plus sources rows
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(UNIT))
    start = F.pmod(F.col("_before") + part(F.col("_pos") - F.col("_first")) + offset, F.lit(UNIT))
    copies = F.shiftright(start + F.col("_step"), 30)
    return summed.select("source", "doc_id", "tokens", copies.alias("copies")).where("copies > 0")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target_share, documents, copies, tokens reached and their share of the mixture."""
    tidy = F.lower(F.btrim(F.regexp_replace("source", r"[\s\p{Z}]+", " ")))
    wanted = targets.groupBy(tidy.alias("source")).agg(F.max("target_share").alias("target_share"))
    reached = mixture.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    rows = wanted.join(reached, "source", "left").na.fill(0, ["documents", "copies", "tokens"])
    return rows.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))
