"""Texts that stop before their author did: cut mid-word, mid-sentence or in the middle of a transfer.

The final token is looked up in tries over the corpus's vocabulary: an unknown token that properly begins known
words was cut. Whether known words can end a sentence is counted from the corpus's finished sentences, and lengths at
which values of a field pile up tip the undecided cases.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.lookalike import LATIN_LOOK, table_form
from tallgrass.llm.trie import Trie
from tallgrass.staging import settle, shuffle_width

TOKEN = re.compile(r"#?[^\W_]+(?:[-'’][^\W_]+)*")
SENTENCE_END = re.compile(r"(?<=[.!?])[\"'»”)]*\s+|\n+")
STOPPED = re.compile(r"[.!?][\"'»”)]*$")
# what only a cut leaves behind: broken bytes, entities and escapes, a reader's "more" link, an open remark
MARKED = re.compile(r"(�|&(?:#?\w{0,6})|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9a-fA-F]?|‍|<[^<>\s]{0,20})$")
MORE = re.compile(r"(\s*(?:…|\.\.\.)\s*(?:(?:see|read|show|load) more|voir plus|\d+/\d+|(?:lire|afficher) la suite|ver más|leer más|mehr anzeigen|mehr lesen)|\s*\[(?:\.\.\.|…|truncated|more|cut)\]|\s*\((?:cont|more|cut|continued|suite)\b[^)]*\)?)$", re.IGNORECASE)
COMMON = re.compile("[\x00-\x7e\u00a1-\u00ac\u00ae-\u024f\u2013-\u2026]*")  # nothing in these ranges is wide, joined, without width or a look-alike
DOTS = re.compile(r"\s*(?:…|\.{2,})$")
TAIL = re.compile(r"(?:\s|^)(?:URL|https?://\S+|#[\w-]+|@[\w.]+|\(\d{4}\))$", re.IGNORECASE)

LEVELS = (("a", "b", "x", "y", "z"), ("a", "x", "y", "z"), ("x", "y", "z"), ("a", "b", "z"), ("b", "y", "z"), ("a", "z"), ("b", "z"), ("y", "z"), ("z",))
COUNTED = 200_000  # counts that a task holds before it passes them on
HEAD = 4  # characters that tries are sharded by
KNOWN = 2  # times a word must stand inside sentences to be known
ENOUGH = 3  # sentences behind a count before it is believed
NEIGHBOURS, PILE, SIGMAS = 5, 2, 5  # a length piles up if it is PILE times and SIGMAS deviations above those around it


def smooth(text: str) -> str:
    """Wide, joined and look-alike forms as plain letters, signs without width gone, so that spelling tricks don't matter."""
    if text.isascii() or (COMMON.fullmatch(text) and unicodedata.is_normalized("NFC", text)):
        return text
    flat = "".join(c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c) != "Cf" or c == "‍")
    if any(c in LATIN_LOOK or unicodedata.east_asian_width(c) == "F" or "ﬀ" <= c <= "ﬆ" for c in flat):
        flat = re.sub(r"\S+", lambda m: table_form(m.group()) if not m.group().isascii() else m.group(), flat)
    return flat


@lru_cache(maxsize=100_000)
def shape(token: str, first: bool) -> str:
    """A token's class: digits by their number, names (capital inside a sentence) as one, other words themselves."""
    if token[0].isdigit():
        return "0" * min(len(token), 5)
    return "^" if token[0].isupper() and not first else token.lower()


def contexts(sentence: str) -> list[tuple[str, str, str, str, str, bool]]:
    """(first, second, third last, second last, last token so far, is it the end) at each place of a sentence."""
    return places(TOKEN.findall(sentence))


def places(tokens: list[str]) -> list[tuple[str, str, str, str, str, bool]]:
    """``contexts`` of a sentence's tokens."""
    firsts = [t[0] for t in tokens]
    if len(tokens) > 3 and 10 * sum(map(str.isupper, firsts)) > 7 * sum(map(str.isalpha, firsts)):
        tokens = [t.lower() for t in tokens]  # a text all in capitals names nothing by them
    shapes = [shape(t, i == 0) for i, t in enumerate(tokens)]
    head = [*shapes[:2], "", ""][:2]
    padded = ["", "", *shapes]
    return [(head[0], head[1] if i else "", padded[i], padded[i + 1], s, i == len(shapes) - 1) for i, s in enumerate(shapes)]


def _pictures_off(text: str) -> str:
    while text and (unicodedata.category(text[-1]) in ("So", "Sk", "Mn", "Cf") or text[-1] in "\"'»” "):
        text = text[:-1]
    return text


def tail_of(text: str) -> dict:
    """What the end of a text shows: ``state`` is cut, done or open; open ends carry their last tokens."""
    out = {"state": "done", "a": "", "b": "", "x": "", "y": "", "z": "", "token": "", "phrase": ""}
    flat = smooth(text).rstrip()
    if not flat:
        return out
    flags = re.search("[\U0001f1e6-\U0001f1ff]+$", flat)
    if MARKED.search(flat) or MORE.search(flat) or (flags and len(flags.group()) % 2):
        return out | {"state": "cut"}
    body = flat
    while True:
        bare = _pictures_off(TAIL.sub("", body).rstrip())
        if bare == body:
            break
        body = bare
    lines = body.rsplit("\n\n", 1)
    if len(lines) == 2 and len(lines[1].split()) <= 3 and not STOPPED.search(lines[1]):
        body = lines[0].rstrip()  # a signature or a closing word
    adorned = body != flat
    body = DOTS.sub("", body)
    if not body or STOPPED.search(body):
        last = flat.split()[-1].lower()
        return out | {"state": "adorned", "token": last} if adorned and last[0] == "#" else out
    if body[-1] in ",;:-–—(/&":
        return out | {"state": "cut"}
    last = SENTENCE_END.split(body)[-1]
    tokens = TOKEN.findall(last)
    if not tokens:
        return out
    a, b, x, y, z, _ = places(tokens)[-1]
    lower = [t.lower() for t in tokens]
    return out | {"state": "open", "a": a, "b": b, "x": x, "y": y, "z": z, "token": lower[-1], "phrase": " ".join(lower[-2:]) if len(lower) > 1 else ""}


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.concat([batch[["key"]].reset_index(drop=True), pd.DataFrame([tail_of(t) for t in batch["text"]], columns=["state", "a", "b", "x", "y", "z", "token", "phrase"])], axis=1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts and words of the finished sentences of some batches, counted; words under 'y' and 'z' as they are written."""
    ends, words = Counter(), Counter()

    def counted() -> pa.RecordBatch:
        a, b, x, y, z, end = zip(*ends) if ends else ((),) * 6
        before, word = zip(*words) if words else ((), ())
        n, m, empty = list(ends.values()), list(words.values()), [""] * len(words)
        columns = [[*a, *empty], [*b, *empty], [*x, *empty], [*y, *empty], [*z, *empty], [""] * len(n) + list(before), [""] * len(n) + list(word)]
        arrays = [pa.array(c, pa.string()) for c in columns] + [pa.array([k * e for k, e in zip(n, end)] + [0] * len(m), pa.int64()), pa.array(n + m, pa.int64())]
        ends.clear()
        words.clear()
        return pa.RecordBatch.from_arrays(arrays, ["a", "b", "x", "y", "z", "before", "word", "ended", "seen"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            sentences = [s for s in SENTENCE_END.split(MORE.sub("", smooth(text))) if s]
            for s in sentences:
                tokens = TOKEN.findall(s)
                lower = [t.lower() for t in tokens]
                if STOPPED.search(s) and not DOTS.search(s):
                    ends.update(places(tokens))
                    words.update(zip(["", *lower], lower))
                else:  # of an unfinished sentence all but the last token is known
                    words.update(zip([""] * len(lower), lower[:-1]))
        if len(ends) + len(words) > COUNTED:
            yield counted()
    yield counted()


COUNTS = "a string, b string, x string, y string, z string, before string, word string, ended bigint, seen bigint"


def _look_up(vocabulary: pd.DataFrame, tails: pd.DataFrame) -> pd.DataFrame:
    """Of each tail of a shard: is it unknown after the word before it, yet the beginning of what is known there?"""
    trie = Trie([f"{b}\u0001{w}" for b, w in zip(vocabulary["before"], vocabulary["word"])])
    begins = [trie.is_proper_prefix(f"{b}\u0001{t}") for b, t in zip(tails["before"], tails["tail"])]
    return tails[["before", "tail"]].assign(begins=pd.Series(begins, index=tails.index, dtype=bool))


def begun(tails: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(before, tail, begins): distinct tails against the words known after the same word; ``before`` is '' where a word
    counts wherever it stands.

    Tries are sharded by the word before and the first ``HEAD`` characters, so neither the followers of a common word
    nor the words of one letter meet in one task. A tail shorter than that begins a word if it is one of the short
    prefixes that words have, of which there are few, and no word itself.
    """
    width = 4 * shuffle_width(vocabulary.sparkSession)
    shard = lambda c: F.pmod(F.xxhash64("before", F.substring(c, 1, HEAD)), F.lit(width)).cast("int")
    long = tails.where(F.length("tail") >= HEAD).withColumn("shard", shard("tail"))
    near = vocabulary.where(F.length("word") >= HEAD).withColumn("shard", shard("word"))
    hits = near.groupBy("shard").cogroup(long.groupBy("shard")).applyInPandas(_look_up, "before string, tail string, begins boolean")
    short = tails.where(F.length("tail") < HEAD)
    starts = F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD - 1), F.length("word") - 1)), lambda n: F.substring(F.col("word"), F.lit(1), n))
    prefixes = vocabulary.where(F.length("word") > 1).select("before", F.explode(starts).alias("tail")).distinct().withColumn("begins", F.lit(True))
    found = short.join(prefixes, ["before", "tail"]).join(vocabulary.withColumnRenamed("word", "tail"), ["before", "tail"], "left_anti")
    return hits.unionByName(found.select("before", "tail", "begins"))


def field_values(posts: DataFrame) -> DataFrame:
    """(id, platform, field, text) of both text fields; null and blank texts left out."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("Document", "ParentDocument")])
    rows = posts.select("id", "platform", F.explode(fields).alias("_f")).select("id", "platform", "_f.field", "_f.text")
    return rows.where(F.length(F.regexp_replace("text", r"[\s\p{Z}]+", "")) > 0)


def piled_lengths(values: DataFrame) -> DataFrame:
    """(platform, field, length) at which more values end than around it."""
    counts = values.groupBy("platform", "field", "length").agg(F.count("*").alias("n"))
    around = Window.partitionBy("platform", "field").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    rest = (F.sum("n").over(around) - F.col("n")) / (2 * NEIGHBOURS)
    return counts.withColumn("_rest", rest).where((F.col("n") >= PILE * F.col("_rest")) & (F.col("n") >= F.col("_rest") + SIGMAS * F.sqrt(F.col("_rest") + 1))).select("platform", "field", "length")


def end_chances(open_: DataFrame, ends: DataFrame) -> DataFrame:
    """(key, ends, level): how often the tokens before an open end stand at the end of a finished sentence.

    Contexts of all levels are looked up by one join; the most specific one that was seen ``ENOUGH`` times counts, the
    sentence's beginning and its last three tokens (levels 2 and 3) half each where both were.
    """
    contexts = F.array(*[F.struct(F.lit(i).alias("level"), F.concat_ws("\u0001", *keys).alias("context")) for i, keys in enumerate(LEVELS)])
    wanted = open_.select("key", F.explode(contexts).alias("_c")).select("key", "_c.level", "_c.context")
    near = ends.join(open_.select("z").distinct(), "z", "left_semi")
    counts = near.select(F.explode(contexts).alias("_c"), "ended", "seen").groupBy("_c.level", "_c.context").agg(F.sum("ended").alias("e"), F.sum("seen").alias("n")).where(F.col("n") >= ENOUGH)
    found = wanted.join(counts, ["level", "context"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("level", (F.col("e") / F.col("n")).alias("p")))).alias("p"), F.min("level").alias("level"))
    at = lambda i: F.try_element_at("p", F.lit(i))
    half = F.coalesce((at(2) + at(3)) / 2, at(2), at(3))
    return found.select("key", F.when(F.col("level").isin(2, 3), half).otherwise(F.try_element_at("p", "level")).alias("ends"), "level")


def judge(values: DataFrame) -> DataFrame:
    """Distinct (id, platform, field) of ``values``' texts with ``cut`` and the evidence: length, state, begins, ends (chance that the last
    tokens end a sentence), level (of the counts used) and piled."""
    keyed = values.withColumns({"key": F.sha2("text", 256), "length": F.length("text")})
    texts = settle(keyed.groupBy("key").agg(F.first("text").alias("text")))  # one key, one text
    stored = keyed.select("id", "platform", "field", "length", "key").distinct()
    tails = settle(texts.mapInPandas(_tails, "key string, state string, a string, b string, x string, y string, z string, token string, phrase string"))
    counted = settle(texts.select("text").mapInArrow(_counts, COUNTS).groupBy("a", "b", "x", "y", "z", "before", "word").agg(F.sum("ended").alias("ended"), F.sum("seen").alias("seen")))
    ends = counted.where("word = ''").drop("before", "word")
    spelled = counted.where("word <> ''")

    open_ = tails.where("state in ('open', 'adorned') and token <> ''").withColumn("before", F.split_part("phrase", F.lit(" "), F.lit(1)))
    anywhere = open_.select(F.lit("").alias("before"), F.col("token").alias("tail"))
    after = open_.where("phrase <> ''").select("before", F.col("token").alias("tail"))
    words = spelled.groupBy("word").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= KNOWN).select(F.lit("").alias("before"), "word")
    pairs = spelled.where("before <> ''").select("before", "word").join(after.select("before").distinct(), "before", "left_semi")
    looked = settle(begun(anywhere.unionByName(after).distinct(), words.unionByName(pairs)).where("begins"))

    scored = open_.join(looked.where("before = ''").select(F.col("tail").alias("token"), "begins"), "token", "left")
    scored = scored.join(looked.where("before <> ''").select("before", F.col("tail").alias("token"), F.col("begins").alias("follows")), ["before", "token"], "left")
    scored = scored.select("key", F.coalesce("begins", F.lit(False)).alias("begins"), F.coalesce("follows", F.lit(False)).alias("follows"), (F.col("z") == "^").alias("name"))
    chances = settle(end_chances(open_.where("state = 'open'"), ends))
    scored = scored.join(chances, "key", "left").withColumn("level", F.coalesce("level", F.lit(len(LEVELS))))

    evidence = tails.select("key", "state").join(scored, "key", "left")
    piled = piled_lengths(stored).withColumn("piled", F.lit(True))
    rows = stored.join(evidence, "key").join(piled, ["platform", "field", "length"], "left").drop("key")
    rows = rows.withColumn("piled", F.coalesce("piled", F.lit(False)))
    opened = F.col("state") == "open"
    doubt = F.coalesce("ends", F.lit(0.5))
    cut = (
        (F.col("state") == "cut")
        | (F.coalesce("begins", F.lit(False)) & F.col("state").isin("open", "adorned"))
        | (opened & F.coalesce("follows", F.lit(False)) & ((F.col("level") >= 3) | F.col("name") | F.col("piled")))
        | (opened & (doubt < 0.5))
        | (opened & F.col("piled") & (doubt < 0.9))
    )
    return rows.withColumn("cut", cut)


def truncated(posts: DataFrame) -> DataFrame:
    """Cut values: (id, platform, field).

    Texts that end with a stop, a picture, a link, a tag, a signature or a closing quote are finished, also at a
    length that others are cut at; dots after a whole sentence are style. Null and blank values, repeated rows, rows
    without key and empty tables are allowed; other columns are ignored. Every text is read whole.
    """
    return judge(field_values(posts)).where("cut").select("id", "platform", "field").distinct()


def truncation_report(posts: DataFrame) -> DataFrame:
    """Per platform: values, cut values and their share."""
    rows = judge(field_values(posts)).groupBy("platform", "id", "field").agg(F.max("cut").alias("cut"))
    return rows.groupBy("platform").agg(F.count("*").alias("values"), F.count_if("cut").alias("cut_values"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_share"))
