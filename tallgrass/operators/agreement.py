"""Agreement between raters, quality of labels and of probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, gold: str, pred: str, labels: Sequence[str], weight: Column | None = None) -> DataFrame:
    """All pairs of labels with their (weighted) count, zero where there is none: gold, pred, n."""
    grid = rows.sparkSession.createDataFrame([(g, p) for g in labels for p in labels], "gold string, pred string")
    counts = rows.where(F.col(gold).isin(*labels) & F.col(pred).isin(*labels)).groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("n"))
    return grid.join(counts, ["gold", "pred"], "left").na.fill(0.0, ["n"])


def channel(matrix: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """Row-normalised confusion with additive smoothing: chance of ``pred`` given ``gold``."""
    own = F.col("n") + smoothing
    return matrix.select("gold", "pred", (own / F.sum(own).over(Window.partitionBy("gold"))).alias("p"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """Per label: precision, recall, f1 and support; a ratio over nothing is 0."""
    by = lambda c, name: matrix.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(name))
    hit = matrix.where("gold = pred").select(F.col("gold").alias("label"), F.col("n").alias("hit"))
    t = by("gold", "support").join(by("pred", "called"), "label").join(hit, "label")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t = t.withColumn("precision", over(F.col("hit"), F.col("called"))).withColumn("recall", over(F.col("hit"), F.col("support")))
    return t.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def overall_scores(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, macro and support-weighted f1, Cohen's kappa."""
    per = class_scores(matrix).agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    rows = matrix.groupBy(F.col("gold").alias("l")).agg(F.sum("n").alias("r"))
    cols = matrix.groupBy(F.col("pred").alias("l")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "l").agg(F.sum(F.col("r") * F.col("c")).alias("rc"), F.sum("r").alias("n"))
    hits = matrix.agg(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0.0)).alias("h"))
    one = hits.join(F.broadcast(chance)).join(F.broadcast(per))  # three one-row tables
    po, pe = F.col("h") / F.col("n"), F.col("rc") / (F.col("n") * F.col("n"))
    return one.select(po.alias("accuracy"), "macro_f1", "weighted_f1", F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def fleiss_kappas(answers: DataFrame, item: Sequence[str], label: str) -> DataFrame:
    """(raters, items, kappa): kappa over the items of each number of answers, so that no item is left out; one answer
    alone shows no agreement and has no kappa."""
    counts = answers.groupBy(*item, label).agg(F.count("*").alias("n"))
    full = counts.withColumn("raters", F.sum("n").over(Window.partitionBy(*item)))
    per_item = full.groupBy("raters", *item).agg(F.sum(F.col("n") * F.col("n")).alias("_sq"))
    po = per_item.groupBy("raters").agg(F.count("*").alias("items"), F.avg((F.col("_sq") - F.col("raters")) / F.nullif(F.col("raters") * (F.col("raters") - 1), F.lit(0))).alias("po"))
    marginal = full.groupBy("raters", label).agg(F.sum("n").alias("m")).groupBy("raters").agg((F.sum(F.col("m") * F.col("m")) / F.pow(F.sum("m"), 2)).alias("pe"))
    return po.join(marginal, "raters").select("raters", "items", F.when((F.col("pe") < 1) & (F.col("raters") > 1), (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def fleiss_kappa(answers: DataFrame, item: Sequence[str], label: str, raters: int) -> DataFrame:
    """One row: kappa over the items with exactly ``raters`` answers, and their number."""
    counts = answers.groupBy(*item, label).agg(F.count("*").alias("n"))
    full = counts.withColumn("_k", F.sum("n").over(Window.partitionBy(*item))).where(F.col("_k") == raters)
    per_item = full.groupBy(*item).agg(((F.sum(F.col("n") * F.col("n")) - raters) / (raters * (raters - 1))).alias("p"))
    marginal = full.groupBy(label).agg(F.sum("n").alias("m"))
    pe = marginal.agg((F.sum(F.col("m") * F.col("m")) / F.pow(F.sum("m"), 2)).alias("pe"))
    return per_item.agg(F.avg("p").alias("po"), F.count("*").alias("items")).join(F.broadcast(pe)).select("items", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def majority(answers: DataFrame, item: Sequence[str], label: str) -> DataFrame:
    """Per item the label most raters gave; items whose first place is shared are left out."""
    counts = answers.groupBy(*item, label).agg(F.count("*").alias("n"))
    best = counts.withColumn("_top", F.max("n").over(Window.partitionBy(*item))).where("n = _top")
    return best.groupBy(*item).agg(F.count("*").alias("_ties"), F.min(label).alias(label), F.max("n").alias("votes")).where("_ties = 1").drop("_ties")


def pairwise_agreement(answers: DataFrame, item: Sequence[str], rater: str, label: str) -> DataFrame:
    """Per pair of raters: common items and the share on which they agree. An item is met by its few raters only."""
    a = answers.select(*item, F.col(rater).alias("rater_a"), F.col(label).alias("_a"))
    b = answers.select(*item, F.col(rater).alias("rater_b"), F.col(label).alias("_b"))
    both = a.join(b, list(item)).where("rater_a < rater_b")
    return both.groupBy("rater_a", "rater_b").agg(F.count("*").alias("items"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agree"))


def ranked_probability_score(p: Column, outcome: Column) -> Column:
    """Score of an array of three probabilities against the outcome 0, 1 or 2: squared error of the running sums."""
    first = F.pow(p[0] - (outcome <= 0).cast("double"), 2)
    return (first + F.pow(p[0] + p[1] - (outcome <= 1).cast("double"), 2)) / 2


def log_score(p: Column, outcome: Column) -> Column:
    return -F.log(F.greatest(F.element_at(p, outcome + 1), F.lit(1e-12)))


def tempered(p: Column, temperature: Column | float) -> Column:
    """Probabilities raised to 1 / temperature and made to sum to one again."""
    raised = F.transform(p, lambda v: F.pow(F.greatest(v, F.lit(1e-12)), 1 / (F.lit(temperature) if isinstance(temperature, float) else temperature)))
    whole = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raised, lambda v: v / whole)


def fit_temperature(rows: DataFrame, p: str, outcome: str, grid: Sequence[float]) -> DataFrame:
    """Mean log score for each temperature of a short grid, in one pass: temperature, nll (the least is the fit)."""
    scores = [F.avg(log_score(tempered(F.col(p), float(t)), F.col(outcome))).alias(f"t{i}") for i, t in enumerate(grid)]
    table = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(grid)])
    return rows.agg(*scores).select(F.explode(table).alias("_t")).select("_t.*")


def murphy(binned: DataFrame, score: str, outcome: str) -> DataFrame:
    """One row: brier, reliability, resolution and uncertainty of scores that carry a ``bin``."""
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("f"), F.avg(outcome).alias("o"))
    base = binned.agg(F.avg(outcome).alias("base"), F.avg(F.pow(F.col(score) - F.col(outcome), 2)).alias("brier"))
    j = per.join(F.broadcast(base))
    n = F.sum("n")
    return j.agg(
        F.max("brier").alias("brier"), (F.sum(F.col("n") * F.pow(F.col("f") - F.col("o"), 2)) / n).alias("reliability"),
        (F.sum(F.col("n") * F.pow(F.col("o") - F.col("base"), 2)) / n).alias("resolution"), F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )


def profile_scores(rows: DataFrame, keys: Sequence[str], gold: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """Precision, recall and f1 of each label per key, in one pass; a ratio over nothing is 0."""
    sums = rows.groupBy(*keys).agg(*[F.count_if(c).alias(f"_{n}{i}") for i, x in enumerate(labels) for n, c in (("h", (F.col(gold) == x) & (F.col(pred) == x)), ("c", F.col(pred) == x), ("s", F.col(gold) == x))])
    table = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), *[F.col(f"_{n}{i}").alias(n) for n in "hcs"]) for i, x in enumerate(labels)]))
    t = sums.select(*keys, table.alias("_t")).select(*keys, "_t.*")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t = t.withColumns({"precision": over(F.col("h"), F.col("c")), "recall": over(F.col("h"), F.col("s"))})
    return t.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("h", "c", "s")
