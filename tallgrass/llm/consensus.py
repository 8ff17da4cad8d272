"""Consensus of several annotators: a feature-based classifier and confusion matrices, fitted together by EM.

The classifier's output is the label prior of an item; each annotator has a confusion matrix per platform, shrunk
towards the annotator's own over all platforms. Every pass reads all items where they lie and sends back sums whose
size depends on annotators, platforms and feature buckets, never on items.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.staging import settle

LABELS = ("FAVOR", "AGAINST", "NEUTRAL")
FEATURES = ("platform", "target", "main_type", "sub_type", "party", "actor_group")
BUCKETS = 512
PASSES = 25
RIDGE = 5.0
SHRINK = 20.0  # answers' worth of an annotator's overall matrix behind each platform's
PRIOR = np.array([[4.0, 1.0, 1.0], [1.0, 4.0, 1.0], [1.0, 1.0, 4.0]])
MAX_PAIRS = 200_000  # pairs of a coder and a platform, each with a matrix of nine numbers that every task gets (14 MB)


def latest_answers(coded: DataFrame) -> DataFrame:
    """One row per item and coder, its latest answer: platform, post_id, target, coder, label (null: blank), features.

    Platform and coder are compared without case and outer blanks. Of rows with the same ``coded_at`` the one with
    the greatest answer counts; a null ``coded_at`` is earliest; rows without platform, post, target or coder are
    left out; unknown answers count as blank.
    """
    tidy = lambda c: F.btrim(F.regexp_replace(c, r"[\p{Z}\s]+", " "))
    index = F.create_map(*[F.lit(x) for i, name in enumerate(LABELS) for x in (name, i)])
    code = lambda c: F.try_element_at(index, F.upper(tidy(c)))
    rows = coded.select(
        F.lower(tidy("platform")).alias("platform"), "post_id", "target", F.lower(tidy("coder")).alias("coder"), "coded_at",
        code("coded_stance").alias("label"), code("model_stance").alias("model"), *[c for c in FEATURES if c not in ("platform", "target")],
    )
    rows = rows.where("platform <> '' and post_id is not null and target is not null and coder <> ''")
    newest = F.struct(F.coalesce("coded_at", F.lit("")).alias("at"), F.coalesce("label", F.lit(-1)).alias("label"))
    keep = [F.max(c).alias(c) for c in ("model", *FEATURES) if c not in ("platform", "target")]
    latest = rows.groupBy("platform", "post_id", "target", "coder").agg(F.max(newest)["label"].alias("label"), *keep)
    return latest.withColumn("label", F.when(F.col("label") >= 0, F.col("label")))


def coder_pairs(latest: DataFrame) -> list[tuple[str, str]]:
    """The (coder, platform) that occur, sorted, with a checked bound: only these have matrices, not all combinations."""
    found = [tuple(r) for r in latest.select("coder", "platform").distinct().limit(MAX_PAIRS + 1).collect()]
    if len(found) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of a coder and a platform")
    return sorted(found)


def item_table(coded: DataFrame) -> tuple[DataFrame, list[tuple[str, str]], list[str]]:
    """(items, pairs, platforms). An item has its keys, ``place`` (platform's number), ``features`` (buckets), ``votes``
    (number of the coder's pair * 3 + label, blanks left out), ``coders`` (all who answered, blanks too) and ``model``.
    """
    latest = settle(latest_answers(coded))
    pairs = coder_pairs(latest)
    platforms = sorted({p for _, p in pairs})
    place = {p: i for i, p in enumerate(platforms)}
    numbers = latest.sparkSession.createDataFrame([(c, p, n, place[p]) for n, (c, p) in enumerate(pairs)], "coder string, platform string, _pair int, place int")
    latest = latest.join(F.broadcast(numbers), ["coder", "platform"])  # at most MAX_PAIRS rows
    vote = F.when(F.col("label").isNotNull(), F.col("_pair") * len(LABELS) + F.col("label"))
    about = [F.max(c).alias(c) for c in ("model", *FEATURES) if c not in ("platform", "target")]
    items = latest.groupBy("platform", "post_id", "target").agg(F.count("*").alias("coders"), F.sort_array(F.collect_list(vote)).alias("votes"), F.max("place").alias("place"), *about)
    buckets = [F.pmod(F.xxhash64(F.lit(f), F.coalesce(F.col(f), F.lit(""))), F.lit(BUCKETS)).cast("int") for f in FEATURES]
    items = items.select("platform", "post_id", "target", "coders", "votes", "model", "place", F.array(*buckets).alias("features"))
    return settle(items), pairs, platforms


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of lists, and the row each belongs to."""
    sizes = np.array([len(x) for x in lists], np.int64)
    values = np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes.sum() else np.zeros(0, np.int64)
    return values, np.repeat(np.arange(len(sizes)), sizes)


def posterior(batch: pd.DataFrame, matrices: np.ndarray | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label posterior, classifier's prior) per item; ``matrices`` (pair, truth, answer) None: vote shares."""
    features, row = _flat(batch["features"])
    score = np.zeros((len(batch), len(LABELS)))
    np.add.at(score, row, weights[features])
    prior = np.exp(score - score.max(axis=1, keepdims=True))
    prior /= prior.sum(axis=1, keepdims=True)
    votes, row = _flat(batch["votes"])
    if matrices is None:
        share = np.full((len(batch), len(LABELS)), 0.3)
        np.add.at(share, (row, votes % 3), 1.0)
        return share / share.sum(axis=1, keepdims=True), prior
    log = np.log(prior + 1e-12)
    np.add.at(log, row, np.log(matrices[votes // 3, :, votes % 3]))
    post = np.exp(log - log.max(axis=1, keepdims=True))
    return post / post.sum(axis=1, keepdims=True), prior


def _sums(shape: tuple[int, int], matrices: np.ndarray | None, weights: np.ndarray):
    """One pass over a partition: expected answer counts (the model's per platform behind the coders') and the classifier's slopes."""
    pairs, platforms = shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((pairs + platforms, 3, 3))
        slope, curve = np.zeros((BUCKETS, 3)), np.zeros((BUCKETS, 3))
        for batch in batches:
            post, prior = posterior(batch, matrices, weights)
            votes, row = _flat(batch["votes"])
            np.add.at(counts, (votes // 3, slice(None), votes % 3), post[row])
            known = batch["model"].notna().to_numpy()
            model = batch["model"].to_numpy()[known].astype(int)
            np.add.at(counts, (pairs + batch["place"].to_numpy()[known], slice(None), model), post[known])
            features, row = _flat(batch["features"])
            np.add.at(slope, features, (post - prior)[row])
            np.add.at(curve, features, (prior * (1 - prior))[row])
        flat = np.concatenate([counts.ravel(), slope.ravel(), curve.ravel()])
        used = np.flatnonzero(flat)
        yield pd.DataFrame({"slot": used, "value": flat[used]})

    return run


def _gather(items: DataFrame, shape: tuple[int, int], matrices: np.ndarray | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sums = items.mapInPandas(_sums(shape, matrices, weights), "slot bigint, value double").groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
    cut = sum(shape) * 9
    flat = np.zeros(cut + BUCKETS * 6)
    flat[sums["slot"]] = sums["value"]
    return flat[:cut].reshape(sum(shape), 3, 3), flat[cut : cut + BUCKETS * 3].reshape(BUCKETS, 3), flat[cut + BUCKETS * 3 :].reshape(BUCKETS, 3)


def _normal(counts: np.ndarray) -> np.ndarray:
    return counts / counts.sum(axis=-1, keepdims=True)


def fit(items: DataFrame, pairs: list[tuple[str, str]], platforms: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrices per pair, classifier weights, expected counts); ends when no matrix moves by a thousandth. If that takes
    more than ``passes`` passes, the last ones count and a warning says how far they still moved."""
    shape, matrices, weights, moved = (len(pairs), platforms), None, np.zeros((BUCKETS, 3)), 1.0
    coders = np.unique([c for c, _ in pairs], return_inverse=True)[1]
    for _ in range(passes):
        counts, slope, curve = _gather(items, shape, matrices, weights)
        whole = np.zeros((coders.max() + 1, 3, 3))
        np.add.at(whole, coders, counts[: len(pairs)])
        new = _normal(counts[: len(pairs)] + SHRINK * _normal(whole + PRIOR)[coders])
        # one regularised Newton step per pass, by the diagonal; divided as each item has several features
        weights = weights + (slope - RIDGE * weights) / ((curve + RIDGE) * len(FEATURES))
        moved = 1.0 if matrices is None else np.abs(new - matrices).max()
        matrices = new
        if moved < 1e-3:
            break
    else:
        warnings.warn(f"the matrices still move by {moved:.4f} after {passes} passes", stacklevel=2)
    return matrices, weights, _gather(items, shape, matrices, weights)[0]


def _decide(matrices: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            post, _ = posterior(batch, matrices, weights)
            best = post.argmax(axis=1)
            votes, row = _flat(batch["votes"])
            tally = np.zeros((len(batch), 3))
            np.add.at(tally, (row, votes % 3), 1.0)
            n = tally.sum(axis=1)
            pairs = (tally * (tally - 1)).sum(axis=1)
            yield batch[["platform", "post_id", "target", "coders"]].assign(
                stance=[LABELS[b] for b in best], confidence=post.max(axis=1), answers=n.astype(int),
                support=np.where(n > 0, tally[np.arange(len(best)), best] / np.maximum(n, 1), np.nan),
                agreement=np.where(n > 1, pairs / np.maximum(n * (n - 1), 1), np.nan),
            )

    return run


RESULT = "platform string, post_id string, target string, coders bigint, stance string, confidence double, answers int, support double, agreement double"


def consensus(coded: DataFrame, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(items, annotators).

    items: platform, post_id, target, coders (all who coded it, blanks too), stance, confidence, answers, support (share
    of answers that gave the stance) and agreement (share of equal pairs of answers; NaN below two answers).
    annotators: platform, annotator (``model_stance`` is one), answers and reliability (expected share of right answers).
    An item without any answer takes the classifier's label. Ties of the posterior go to the first of ``LABELS``. An
    empty table gives no rows. The model's own label counts for its reliability only, never for the consensus.
    """
    items, pairs, platforms = item_table(coded)
    spark = coded.sparkSession
    if not pairs:
        return spark.createDataFrame([], RESULT), spark.createDataFrame([], "platform string, annotator string, answers bigint, reliability double")
    matrices, weights, counts = fit(items, pairs, len(platforms), passes)
    decided = items.select("platform", "post_id", "target", "coders", "votes", "place", "features").mapInPandas(_decide(matrices, weights), RESULT)
    who = [(p, c) for c, p in pairs] + [(p, "model_stance") for p in platforms]
    rows = [(*name, int(round(n.sum())), float(np.trace(n) / n.sum())) for name, n in zip(who, counts) if n.sum() > 0]
    return decided, spark.createDataFrame(rows, "platform string, annotator string, answers bigint, reliability double")
