"""Posts of every platform as one kind of document, and the targets that documents carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.text import blank_to_null, cleaned_target, joined, spelling_key, strip

# When text read off an image counts.
OCR_CONFIDENCE = 0.75
OCR_WORDS = 3
OCR_CHARS = 1000
COLUMNS = ("id", "platform", "createtime", "Document", "ParentDocument", "seed")


def has_field(df: DataFrame, path: str) -> bool:
    """Does the schema have a (nested) field, going through structs by dots?"""
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            return False
        kind = kind[part].dataType
    return True


def optional(df: DataFrame, path: str, kind: str = "string") -> Column:
    """A field if the schema has it, else a null of the kind."""
    return F.col(path) if has_field(df, path) else F.lit(None).cast(kind)


def _document(df: DataFrame, platform: str, ident: Column, time: Column, text: Column, parent: Column) -> DataFrame:
    return df.select(ident.cast("string").alias("id"), F.lit(platform).alias("platform"), time.alias("createtime"), text.alias("Document"), parent.alias("ParentDocument"), "seed")


def bluesky_documents(df: DataFrame) -> DataFrame:
    """A bare repost takes the reposted text, else the link's title and description; a post with text has them as context."""
    own, original = blank_to_null(F.col("text")), blank_to_null(optional(df, "original_post_text"))
    link = joined([optional(df, "embed_title"), optional(df, "embed_description")], " ")
    parent = F.coalesce(optional(df, "reply.parent.record.text"), F.when(own.isNotNull(), original))
    return _document(df, "bluesky", F.col("id"), F.col("date"), F.coalesce(own, original, link), parent)


def admitted_ocr(df: DataFrame) -> Column:
    """Text read off images with enough confidence and at least three words of letters, cut to its limit."""
    flat = strip(F.regexp_replace(optional(df, "ocr_text"), r"\s+", " "))
    sure = F.when(optional(df, "ocr_mean_conf", "double") >= OCR_CONFIDENCE, flat)
    return F.substring(F.when(F.regexp_count(sure, F.lit(r"\p{L}{3,}")) >= OCR_WORDS, sure), 1, OCR_CHARS)


def instagram_documents(df: DataFrame) -> DataFrame:
    """Caption, then the image's text; either alone will do."""
    return _document(df, "instagram", F.col("id"), F.col("taken_at").cast("string"), F.concat_ws("\n", blank_to_null(F.col("caption.text")), admitted_ocr(df)), F.lit(None).cast("string"))


def twitter_documents(df: DataFrame) -> DataFrame:
    """The answered post, else the quoted one, as parent; links and forwarding marks replaced."""
    tidy = lambda c: strip(F.regexp_replace(F.regexp_replace(c, r"https://t\.co/\w+", "URL"), r"(?i)^rt @\w+:?\s*", ""))
    answered = F.nullif(F.nullif("inReplyToTweetId", F.lit("None")), F.lit("-1"))
    posts = df.groupBy(F.col("id").alias("_pid")).agg(F.min("rawContent").alias("_parent"))
    j = df.withColumn("_pid", answered).join(posts, "_pid", "left")
    parent = F.coalesce("_parent", optional(df, "quotedTweet.rawContent"))
    return _document(j, "twitter", F.col("id"), F.col("date"), tidy(F.col("rawContent")), tidy(parent))


def tiktok_documents(df: DataFrame, authors: DataFrame) -> DataFrame:
    """Caption, then what was said: one turn after the other, other people's turns in quotes where several speak."""
    once = df.groupBy("video_id").agg(F.min_by(F.struct("createtime", "desc", "seed", "transcripts"), F.struct("createtime", "desc")).alias("_v")).select("video_id", "_v.*")
    own = authors.groupBy(F.col("video_id").cast("string").alias("video_id"), F.col("speaker_index").cast("bigint").alias("speaker")).agg(F.max("is_author").alias("is_author"))
    segments = once.select("video_id", F.posexplode("transcripts.segments").alias("n", "s")).select("video_id", "n", "s.start", strip(F.col("s.text")).alias("text"), F.regexp_extract("s.speaker", r"(\d+)\D*$", 1).try_cast("bigint").alias("speaker"))
    known = segments.join(own, ["video_id", "speaker"])
    w = Window.partitionBy("video_id").orderBy("start", "n")
    new = F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(1))
    runs = known.withColumn("_new", new).withColumn("turn", F.sum("_new").over(w)).withColumn("_many", F.size(F.collect_set("speaker").over(Window.partitionBy("video_id"))) > 1)
    turns = runs.groupBy("video_id", "turn").agg(F.array_sort(F.collect_list(F.struct("start", "n", "text"))).alias("t"), F.first("is_author").alias("a"), F.first("_many").alias("m"))
    said = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    quoted = turns.select("video_id", "turn", F.when(F.col("a") | ~F.col("m"), said).otherwise(F.concat(F.lit('"'), said, F.lit('"'))).alias("said"))
    spoken = quoted.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("t")).select("video_id", F.array_join(F.transform("t", lambda x: x["said"]), " ").alias("_spoken"))
    j = once.join(spoken, "video_id", "left")
    return _document(j, "tiktok", F.col("video_id"), F.col("createtime"), F.concat_ws("\n", blank_to_null(F.col("desc")), blank_to_null(F.col("_spoken"))), F.lit(None).cast("string"))


def usable(documents: DataFrame) -> DataFrame:
    """Documents with at least one letter."""
    return documents.where(F.col("Document").rlike(r"\p{L}"))


def all_text(parent: Column, own: Column) -> Column:
    """Parent and own text in one, as a model reads them."""
    return F.when(parent.isNotNull(), F.concat(parent, F.lit("; "), own)).otherwise(own)


def clean_targets(targets: Column) -> Column:
    """Every entry of a list cleaned, in place; nothing is exploded."""
    return F.transform(targets, cleaned_target)


def spelling_forms(targets: DataFrame, column: str = "target") -> DataFrame:
    """(target, form): each spelling with its group's most frequent one; ties go to the shorter, then the first by name."""
    counts = targets.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("target")).agg(F.count("*").alias("n")).withColumn("key", spelling_key(F.col("target")))
    best = counts.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), F.length("target").alias("l"), F.col("target").alias("t"))).alias("_b"))
    return counts.join(best, "key").select("target", F.col("_b.t").alias("form"))


def mapped_targets(documents: DataFrame, key: list[str], mapping: DataFrame, column: str = "Targets") -> DataFrame:
    """(key, Targets): lists rewritten by a table (target, form), each form once, in the order of first standing.

    The table may be as large as the vocabulary, so it is joined and not broadcast; empty lists stay empty.
    """
    rows = documents.select(*key, F.posexplode(column).alias("pos", "target")).join(mapping, "target", "left")
    firsts = rows.groupBy(*key, F.coalesce("form", "target").alias("form")).agg(F.min("pos").alias("pos"))
    lists = firsts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("_l")).select(*key, F.transform("_l", lambda x: x["form"]).alias("_t"))
    return documents.select(*key).distinct().join(lists, key, "left").select(*key, F.coalesce("_t", F.array().cast("array<string>")).alias(column))


def language_scores(rows: DataFrame, target: str, lang: str) -> DataFrame:
    """Per target: documents, share that isn't English (of those with a language) and the most frequent language."""
    per = rows.groupBy(target).agg(F.count("*").alias("n"), F.avg((F.col(lang) != "en").cast("double")).alias("other"))
    top = rows.where(F.col(lang).isNotNull()).groupBy(target, lang).agg(F.count("*").alias("k")).groupBy(target).agg(F.min(F.struct((-F.col("k")).alias("k"), F.col(lang).alias("l"))).alias("_t"))
    return per.join(top, target, "left").select(target, "n", "other", F.col("_t.l").alias("language"))


def to_translate(target: Column, other: Column) -> Column:
    """Is a target a candidate for translation: letters, not long, no handle, no digits, foreign letters or foreign use."""
    foreign = target.rlike(r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]") | (other >= 0.4)
    return target.rlike(r"\p{L}") & (F.length(target) <= 300) & ~target.startswith("@") & ~target.rlike(r"(^|\s)\S*\d\S*") & foreign


def in_batches(rows: DataFrame, column: str, result: str, model, size: int = 256) -> DataFrame:
    """``rows`` with ``result``, computed once per distinct text by ``model`` (a list of texts to a list of strings).

    The distinct texts go through the model in batches where they lie; three failures of a batch end the task.
    """
    import pandas as pd

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.iloc[start : start + size]
                for attempt in range(3):
                    try:
                        out = model(part[column].tolist())
                        break
                    except Exception:
                        if attempt == 2:
                            raise
                yield pd.DataFrame({column: part[column].to_numpy(), result: out})

    texts = rows.where(F.col(column).isNotNull()).select(column).distinct()
    return rows.join(texts.mapInPandas(run, f"{column} string, {result} string"), column, "left")


# Entries that name nothing.
NO_TARGET = ("none", "n/a", "unknown", "url")


def usable_target(target: Column) -> Column:
    """Is an entry a target at all: letters, 3 to 300 characters, no link, handle or tag, no word for nothing."""
    plain = F.trim(target)
    return target.rlike(r"\p{L}") & F.length(plain).between(3, 300) & ~target.rlike("^(https?://|@|#)") & ~F.lower(plain).isin(*NO_TARGET)
