"""Reading level of each document: the smallest frequency-ranked vocabulary that covers it, and its sentences.

Words of the English texts are ranked by frequency over the whole corpus. A document's coverage rank is the rank of
the last word needed to cover a fixed share of its tokens, most frequent words first. Ranks and the sentences' build
are computed in SQL and calibrated on rated texts by logistic regression, whose fitted form is again SQL.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.staging import settle

COVER = 0.9
HALF = 0.7
HEAD_RANKS = 4_000  # the most frequent words, broadcast: a bound that no corpus changes
LEVELS = (1, 2, 3, 4)

# Short function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for it with as his on be at by had not are but from or have an they which you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split(),
    "fr": "le la les des du de un une et en est que qui dans pour pas sur au aux ce cette ces son sa ses leur leurs par avec plus ne se il elle ils elles nous vous je tu mais ou où donc si sont été être avoir a ont à d l n s qu c j m notre nos votre vos mon ma mes tout tous très après chez dès malgré reste selon parce hier depuis".split(),
    "es": "el la los las de del un una y en es que por para con no su sus se al lo como más pero le ya o este esta esto ese esa porque entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros según qué otra vez".split(),
    "de": "der die das den dem des ein eine einer einem einen und in ist zu von mit auf für nicht sich im dass er sie es wir ich ihr als auch an nach wie bei aus um am sind noch so war hat werden über oder aber vor zur zum nur wird bis durch seit sagt".split(),
}

ENGLISH_ENDINGS = ("ing", "ness", "ly", "ity", "ised", "ized", "ically", "eous", "ious", "ship", "hood")  # after three letters an ending counts as a function word
FEATURES = ("cover", "half", "sentence", "long", "clauses", "letters")
KNOWN = 0.5  # share of an English text's words that other texts of the corpus use too, and that no other language claims
LABELLED = 50_000  # most rated documents that the calibration is fitted on, by hash of their id
RIDGE = 1.0
ROUNDS = 30


def texts_with_words(documents: DataFrame) -> DataFrame:
    """doc_id, words (lower-case, in order), words told without names (``plain``) and sentence figures of each text.

    Links, tags and mentions are no prose. A sentence ends at a stop or a line end; in a text without any stop, as
    transcripts are, "and" joins sentences. ``marks`` counts the stops inside sentences. Names, told by a capital inside
    a sentence, say nothing about difficulty. Repeated rows of one doc_id collapse; null and blank texts are left out.
    """
    label = F.lower(F.trim("lang")) if "lang" in documents.columns else F.lit(None).cast("string")
    stored = documents.select("doc_id", "text", F.coalesce((label != "") & (label != "en"), F.lit(False)).alias("foreign")).where("doc_id is not null and text is not null")
    once = stored.groupBy("doc_id", "text").agg(F.max("foreign").alias("foreign"))
    prose = once.select("doc_id", "foreign", F.regexp_replace("text", r"(?:https?://\S+|[#@][\p{L}\d_-]+|\bURL\b)", " ").alias("text"))
    unnamed = F.regexp_replace("text", r"(?<=[\p{Ll}\d,;:)] )\p{Lu}[\p{L}'’-]*", "")
    stops = F.regexp_count("text", F.lit(r"[.!?…]+(?:[\s\"'»”)]|$)|\S\s*\n+\s*\S"))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    read = F.struct(
        words(F.col("text")).alias("words"), words(unnamed).alias("plain"),
        F.when(stops > 0, stops).otherwise(F.regexp_count(F.lower("text"), F.lit(r"\s(?:and|et|y|und)\s")) + 1).alias("sentences"),
        F.regexp_count("text", F.lit(r"[,;:]")).alias("marks"),
    )
    # behind a generator the columns are values: filters that use them don't take the text apart again
    return prose.select("doc_id", "foreign", F.explode(F.array(read)).alias("_r")).select("doc_id", "foreign", "_r.*").where(F.size("plain") > 0)


def _share(language: str) -> Column:
    """How many words of the text are function words of the language."""
    ends = lambda w: reduce(or_, [w.endswith(e) & (F.length(w) >= 3 + len(e)) for e in ENGLISH_ENDINGS])
    known = lambda w: w.isin(FUNCTION_WORDS[language]) | (ends(w) if language == "en" else F.lit(False))
    return F.size(F.filter("words", known))


def english(texts: DataFrame) -> DataFrame:
    """The texts that may be English, by the words themselves: clearly more English function words and endings than
    function words of any other language listed. ``profile`` leaves those that only look so by a few words shared with
    another language out again."""
    scored = texts.withColumns({f"_{k}": _share(k) for k in FUNCTION_WORDS})
    others = F.greatest(*[F.col(f"_{k}") for k in FUNCTION_WORDS if k != "en"])
    return scored.where((F.col("_en") * 2 > others * 3) & (F.col("_en") > 0)).drop(*[f"_{k}" for k in FUNCTION_WORDS])


def word_ranks(counts: DataFrame) -> DataFrame:
    """(word, rank, own) from (word, n, own): one more than the number of words that are more frequent; equal counts share
    a rank.

    Words are first counted by their count, so that the ordered sum runs over distinct counts only, of which N words of
    text have at most the square root of 2 N.
    """
    by_count = counts.groupBy("n").agg(F.count("*").alias("_words"))
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_count.withColumn("rank", F.coalesce(F.sum("_words").over(above), F.lit(0)) + 1).select("n", "rank")
    return counts.join(ranks, "n").select("word", "rank", "own")


def coverage_ranks(texts: DataFrame, cover: float = COVER, half: float = HALF) -> DataFrame:
    """(doc_id, coverage_rank, half_rank, known): the least ranks down to which a document's words cover ``cover`` and
    ``half`` of its tokens, and the share of tokens that are words of the corpus's English: a word that stands in another
    text too, and of whose texts fewer than half are labelled with some other language (column ``foreign``, if any)."""
    foreign = F.col("foreign") if "foreign" in texts.columns else F.lit(False)
    counts = settle(texts.select("doc_id", foreign.alias("foreign"), F.explode("plain").alias("word")).groupBy("doc_id", "foreign", "word").agg(F.count("*").alias("n")))
    totals = counts.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("_docs"), F.count_if("foreign").alias("_foreign"))
    ranks = settle(word_ranks(totals.select("word", "n", ((F.col("_docs") > 1) & (F.col("_foreign") * 2 < F.col("_docs"))).alias("own"))))
    # few words stand in nearly every text: they meet their ranks by broadcast, all others by a shuffle without hot keys
    head = ranks.where(F.col("rank") <= HEAD_RANKS).orderBy("rank", "word").limit(HEAD_RANKS)
    first = counts.join(F.broadcast(head), "word", "left")
    rest = first.where("rank is null").drop("rank", "own").join(ranks, "word")
    ranked = first.where("rank is not null").select("doc_id", "n", "rank", "own").unionByName(rest.select("doc_id", "n", "rank", "own"))
    by_rank = ranked.groupBy("doc_id", "rank").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("_own"))
    whole = Window.partitionBy("doc_id")
    running = by_rank.withColumn("_sum", F.sum("n").over(whole.orderBy("rank"))).withColumn("_all", F.sum("n").over(whole))
    reach = lambda share: F.min(F.when(F.col("_sum") >= F.col("_all") * share, F.col("rank")))
    return running.groupBy("doc_id").agg(reach(cover).alias("coverage_rank"), reach(half).alias("half_rank"), (F.sum("_own") / F.max("_all")).alias("known"))


def profile(documents: DataFrame, cover: float = COVER) -> DataFrame:
    """English documents with coverage_rank, words per sentence and the calibration's features."""
    texts = settle(english(texts_with_words(documents)))
    long = F.size(F.filter("plain", lambda w: F.length(w) >= 9)) / F.size("plain")
    letters = F.aggregate("plain", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)) / F.size("plain")
    figures = texts.select("doc_id", (F.size("words") / F.col("sentences")).alias("sentence_words"), (F.col("marks") / F.col("sentences")).alias("sentence_marks"), long.alias("long"), letters.alias("letters"))
    rows = figures.join(coverage_ranks(texts, cover), "doc_id").where(F.col("known") >= KNOWN)
    c, h, s = F.log("coverage_rank"), F.log("half_rank"), F.log(F.least("sentence_words", F.lit(80.0)))
    return rows.select("doc_id", "coverage_rank", "sentence_words", c.alias("cover"), h.alias("half"), s.alias("sentence"), "long", F.log1p("sentence_marks").alias("clauses"), "letters")


def rated_levels(labels: DataFrame) -> DataFrame:
    """(doc_id, above): for each step of the scale the share of raters who put the text above it.

    A rater's repeated rows count once, by their mean; levels off the scale don't count.
    """
    once = labels.where(F.col("level").isin(*LEVELS) & F.col("doc_id").isNotNull()).groupBy("doc_id", "rater").agg(F.avg("level").alias("level"))
    above = F.array(*[F.avg((F.col("level") > k).cast("double")) for k in LEVELS[:-1]])
    return once.groupBy("doc_id").agg(above.alias("above"))


def terms(x: np.ndarray) -> np.ndarray:
    """Each feature, each product of two, and one."""
    i, j = np.triu_indices(x.shape[1])
    return np.column_stack([np.ones(len(x)), x, x[:, i] * x[:, j]])


def calibrate(rated: DataFrame) -> tuple[list[float], list[float], list[list[float]]]:
    """(means, scales, weights): for each step of the scale a regularised logistic regression of the raters' shares on
    the features and their products, by reweighted least squares; None-like zeros where there are no labels."""
    rows = rated.select("above", *FEATURES).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).toPandas()
    size = 1 + len(FEATURES) + len(FEATURES) * (len(FEATURES) + 1) // 2
    if rows.empty:
        return [0.0] * len(FEATURES), [1.0] * len(FEATURES), [[-1.0] + [0.0] * (size - 1)] * (len(LEVELS) - 1)
    raw = rows[list(FEATURES)].to_numpy(float)
    means, scales = raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-6)
    x = terms((raw - means) / scales)
    shares = np.array([list(a) for a in rows["above"]])
    penalty = RIDGE * np.eye(size)
    penalty[0, 0] = 1e-6
    weights = []
    for k in range(shares.shape[1]):
        w = np.zeros(size)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (shares[:, k] - p) - penalty @ w)
            w = w + np.clip(move, -5, 5)
            if np.abs(move).max() < 1e-6:
                break
        weights.append([float(v) for v in w])
    return [float(v) for v in means], [float(v) for v in scales], weights


def chance_above(step: int, fitted: tuple[list[float], list[float], list[list[float]]]) -> Column:
    """Chance that raters put a text above the step, as a column over the features."""
    means, scales, weights = fitted
    z = [(F.col(f) - F.lit(m)) / F.lit(s) for f, m, s in zip(FEATURES, means, scales)]
    products = [z[i] * z[j] for i, j in zip(*np.triu_indices(len(FEATURES)))]
    total = F.lit(weights[step][0])
    for w, term in zip(weights[step][1:], [*z, *products]):
        total = total + term * F.lit(w)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def reading_levels(documents: DataFrame, labels: DataFrame, cover: float = COVER) -> DataFrame:
    """Each English document's reading level: doc_id, coverage_rank, sentence_words, score (1 to 4) and level.

    Language is told from the words, whatever a text's own ``lang`` says: a text is English if it has more function words
    of English than of any other language and at least ``KNOWN`` of its words are used by other English texts of the
    corpus. Texts without words and texts in other languages are left out. The calibration is fitted on at most ``LABELLED`` rated documents; all documents count for the ranks and are scored. Without labels the level is 1 everywhere. Other columns are
    ignored; empty tables give no rows.
    """
    profiled = settle(profile(documents, cover))
    fitted = calibrate(profiled.join(rated_levels(labels), "doc_id"))
    above = [chance_above(k, fitted) for k in range(len(LEVELS) - 1)]
    scored = profiled.select("doc_id", "coverage_rank", "sentence_words", *[a.alias(f"_above{k}") for k, a in enumerate(above)])
    steps = [F.col(f"_above{k}") for k in range(len(above))]
    level = F.lit(1)
    for k, step in enumerate(steps):
        level = F.when(step >= 0.5, F.lit(k + 2)).otherwise(level)
    return scored.select("doc_id", "coverage_rank", "sentence_words", (F.lit(1.0) + sum(steps, F.lit(0.0))).alias("score"), level.alias("level"))
