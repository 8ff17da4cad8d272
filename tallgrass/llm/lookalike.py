"""One form for texts that look alike but differ in their characters.

The corpus's plain tokens form vocabulary tries. A token with unusual characters is walked through the trie by a
weighted edit automaton in which look-alikes, wide and joined forms and ignorable characters cost nothing and
everything else exceeds the budget; it takes the spelling found there. Tokens without a match are rewritten by
table. Case, visible accents, words and punctuation are left alone.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.trie import Trie
from tallgrass.staging import settle, shuffle_width

# Letters of other scripts that are drawn like a Latin letter of the same case.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ү": "Y", "Ӏ": "I", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "һ": "h", "ѵ": "v", "ү": "y", "ӏ": "l",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
}
OTHER = {"օ": "o", "ɡ": "g", "ո": "n", "հ": "h", "ս": "u", "‐": "-", "‑": "-", "﹣": "-", "ꓳ": "O"}
LATIN_LOOK = CYRILLIC | GREEK | OTHER
# Script letters without a Latin double; one of them in a token shows which script the token is written in.
BACK = {"CYRILLIC": {}, "GREEK": {}}
for _script, _table in (("CYRILLIC", CYRILLIC), ("GREEK", GREEK)):
    for _letter, _latin in _table.items():
        BACK[_script].setdefault(_latin, _letter)

PLAIN = r"^[\x21-\x7e¡-¬®-ıĴ-ľŁ-ňŊ-ž]*$"
PLAIN_TEXT = r"^[ \n\x21-\x7e¡-¬®-ıĴ-ľŁ-ňŊ-ž]*$"
TASK_TOKENS = 5_000  # distinct tokens that are worth a task of their own
SHARD_TOKENS = 200_000  # distinct tokens that a trie holds on average, at most
ZWJ = "‍"
COMPAT = ("<wide>", "<narrow>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")


def _pictured(char: str) -> bool:
    return unicodedata.category(char) in ("So", "Sk") or char == "️"


SHOWN: dict[str, str] = {}  # what characters show, as far as met: at most one entry per character there is


def _visible(char: str) -> str:
    """What a character shows: '' if nothing, its Latin double, the letters of a wide or joined form, or itself."""
    shown = SHOWN.get(char)
    if shown is None:
        shown = SHOWN[char] = _shown(char)
    return shown


def _shown(char: str) -> str:
    if char in LATIN_LOOK:
        return LATIN_LOOK[char]
    kind = unicodedata.category(char)
    if kind == "Cf" or char in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= char <= "️":
        return ""
    form = unicodedata.decomposition(char)
    if form.startswith(COMPAT) and kind[0] in "LNPS" and char not in "…⋯‥":
        return unicodedata.normalize("NFKC", char)
    return char


def units(token: str) -> str:
    """The visible signs of a token, decomposed: equal for tokens that look alike, different otherwise.

    A joiner between two pictures changes the picture and stays; elsewhere it shows nothing.
    """
    out = []
    for i, char in enumerate(token):
        if char == ZWJ and 0 < i < len(token) - 1 and _pictured(token[i - 1]) and _pictured(token[i + 1]):
            out.append(char)
        else:
            out.append(_visible(char))
    flat = unicodedata.normalize("NFD", "".join(out))
    return "".join(LATIN_LOOK.get(c, c) for c in flat)


def table_form(token: str) -> str:
    """The token rewritten by table alone; a pure function of its visible signs.

    A token that holds a letter of another script without a Latin double is written in that script throughout.
    """
    signs = units(token)
    for script, back in BACK.items():
        if any(unicodedata.name(c, "").startswith(script) for c in signs):
            return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in signs))
    return unicodedata.normalize("NFC", signs)


def matches(trie: Trie, token: str, budget: int = 0) -> list[tuple[int, str]]:
    """Vocabulary words within ``budget`` of the token: (cost, word), cheapest first.

    The automaton's states are places in the token's visible signs; along a branch of the trie an equal sign costs
    0, any other substitution, insertion or deletion 1. At budget 0 only branches that look like the token are walked.
    """
    signs = units(token)
    found: list[tuple[int, str]] = []
    stack = [(trie.root(), {0: 0})]
    while stack:
        node, places = stack.pop()
        if trie.is_word(node) and len(signs) in places:
            found.append((places[len(signs)], trie.words[node[0]]))
        for char, child in trie.children(node):
            step = {}
            shown = units(char)
            for place, cost in places.items():
                end = place + len(shown)
                options = [(end, cost)] if signs.startswith(shown, place) else [(place, cost + 1), (place + 1, cost + 1)]
                for p, c in options:
                    if p <= len(signs) and c <= budget and c < step.get(p, budget + 1):
                        step[p] = c
            if budget:
                for p in sorted(step):
                    while p < len(signs) and step[p] + 1 <= budget and step[p] + 1 < step.get(p + 1, budget + 1):
                        step[p + 1] = step[p] + 1
                        p += 1
            if step:
                stack.append((child, step))
    return sorted(found)


def _sharded(width: int):
    """Tokens with the shard of their visible signs, so that tokens that look alike meet and no others need to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(shard=[zlib.crc32(units(t).encode("utf-8", "surrogatepass")) % width for t in batch["token"]])

    return run


def _spell(plain: pd.DataFrame, odd: pd.DataFrame) -> pd.DataFrame:
    """Canonical spelling of each odd token of a shard, from the shard's trie or else from the table."""
    trie, uses = Trie(plain["token"]), dict(zip(plain["token"], plain["uses"]))
    out = []
    for token in odd["token"]:
        found = matches(trie, token)
        out.append(min(found, key=lambda f: (f[0], -uses[f[1]], f[1]))[1] if found else table_form(token))
    # an empty list would make a column of no type: columns are declared, whatever a shard holds
    return pd.DataFrame({"token": pd.Series(odd["token"].to_numpy(), dtype=object), "spelling": pd.Series(out, dtype=object)})


def tidy(text):
    """Blanks of every kind as one plain blank, line ends as tokens of their own, outer blanks off."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?|[  \x85]", "\n"), r"[\p{Zs}\t\x0b\f]", " ")
    return F.regexp_replace(F.regexp_replace(lines, "\n", " \n "), r"^ +| +$", "")


def spellings(tokens: DataFrame, width: int | None = None) -> DataFrame:
    """(token, spelling) of the odd ones among distinct tokens (token, uses).

    Tokens that look alike share a shard, by a hash of what they show, and a shard holds at most about ``SHARD_TOKENS``;
    only shards with an odd token get a trie. ASCII shows itself, so most of the vocabulary is sharded in the JVM.
    """
    tokens = settle(tokens)
    n = tokens.count()
    width = width or max(shuffle_width(tokens.sparkSession), n // SHARD_TOKENS)
    tasks = max(1, min(width, n // TASK_TOKENS))  # walking tries costs time, not bytes: by bytes all shards would meet in one task
    ascii_ = F.col("token").rlike(r"^[\x21-\x7e]+$")
    own = tokens.where(ascii_).select("token", "uses", (F.crc32("token") % width).cast("int").alias("shard"))
    others = tokens.where(~ascii_).mapInPandas(_sharded(width), "token string, uses bigint, shard int")
    plain = F.col("token").rlike(PLAIN)
    odd = settle(others.where(~plain))
    words = own.unionByName(others.where(plain)).join(odd.select("shard").distinct(), "shard", "left_semi")
    words, odd = words.repartition(tasks, "shard"), odd.repartition(tasks, "shard")
    return words.groupBy("shard").cogroup(odd.groupBy("shard")).applyInPandas(_spell, "token string, spelling string")


def canonical(rows: DataFrame, text: str = "text", width: int | None = None) -> DataFrame:
    """``rows`` with ``canonical`` in the place of their text, equal for texts that look alike.

    Rows without a text are left out; blank texts give ''. Texts are tidied once; those of plain characters are done
    with that, and only the odd tokens of the others are looked up, one row per text and odd token. Repeated rows are kept.
    """
    names = [c for c in rows.columns if c != text]
    tidied = rows.where(F.col(text).isNotNull()).select(F.struct(*names).alias("_row"), tidy(F.col(text)).alias("_tidy"))
    tidied = settle(tidied.withColumn("_odd", ~F.col("_tidy").rlike(PLAIN_TEXT)))
    trim = lambda c: F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")
    tokens = F.split("_tidy", " ")
    vocabulary = tidied.select(F.explode(tokens).alias("token")).where("token <> '' and token <> '\n'").groupBy("token").agg(F.count("*").alias("uses"))
    spelled = spellings(vocabulary, width)
    taken = tidied.where("_odd").select("_row", tokens.alias("_tokens"), F.sha2("_tidy", 256).alias("_key"))
    looked = taken.select("_key", F.explode("_tokens").alias("token")).where(~F.col("token").rlike(PLAIN)).distinct().join(spelled, "token")
    table = looked.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("token", "spelling"))).alias("_table"))
    words = F.transform("_tokens", lambda t: F.coalesce(F.try_element_at("_table", t), t))
    done = taken.join(table, "_key", "left").select("_row.*", trim(F.array_join(words, " ")).alias("canonical"))
    return tidied.where(~F.col("_odd")).select("_row.*", trim(F.col("_tidy")).alias("canonical")).unionByName(done)


def digests(posts: DataFrame, targets: DataFrame, width: int | None = None) -> DataFrame:
    """(field, key, own, shown): of every document, target entry and listed target the digests of its text and of its
    canonical form; null keys and blank texts left out, repeated rows once."""
    digest = lambda c: F.unhex(F.sha2(c, 256))
    documents = posts.select(F.lit("Document").alias("field"), F.col("id").alias("key"), F.col("Document").alias("text"))
    entries = posts.select(F.lit("Targets").alias("field"), F.col("id").alias("key"), F.explode("Targets").alias("text"))
    listed = targets.select(F.lit("listed").alias("field"), F.col("target_id").cast("string").alias("key"), F.col("target").alias("text"))
    every = documents.unionByName(entries).unionByName(listed).where("key is not null").withColumn("own", digest("text"))
    rows = canonical(every, width=width).where("canonical <> ''")
    return settle(rows.select("field", "key", "own", digest("canonical").alias("shown")).distinct())


def alike_documents(forms: DataFrame, block: int = 10_000) -> DataFrame:
    """Pairs of ids whose documents look the same and aren't: (key_a, key_b), smaller id first.

    ``forms`` are the documents' ``digests``. A class in which every text is the same string yields nothing. Large
    classes are cut in blocks of ``block`` rows on one side, so no class meets in one task.
    """
    rows = forms.select(F.col("key").alias("id"), "own", "shown")
    mixed = rows.groupBy("shown").agg(F.count("*").alias("_n"), (F.min("own") != F.max("own")).alias("_mixed")).where("_mixed")
    rows = rows.join(mixed, "shown").withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    left = rows.select("shown", F.col("id").alias("key_a"), F.col("own").alias("own_a"), F.pmod(F.xxhash64("id", "own"), F.col("_blocks")).cast("int").alias("_salt"))
    right = rows.select("shown", F.col("id").alias("key_b"), F.col("own").alias("own_b"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_salt"))
    pairs = left.join(right, ["shown", "_salt"]).where((F.col("own_a") != F.col("own_b")) & (F.col("key_a") < F.col("key_b")))
    return pairs.select("key_a", "key_b").distinct()


def alike_targets(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """(key_a, key_b): posts with an entry of ``Targets`` that looks like a listed target and isn't equal to it."""
    known = listed.select(F.col("key").alias("key_b"), F.col("own").alias("plain"), "shown")
    hits = entries.withColumnRenamed("key", "key_a").join(known, "shown").where(F.col("own") != F.col("plain"))
    return hits.select("key_a", "key_b").distinct()


def lookalikes(posts: DataFrame, targets: DataFrame, width: int | None = None) -> DataFrame:
    """Documents and targets that look alike but differ: (field, key_a, key_b).

    Null or blank documents, null targets and empty lists match nothing; several rows of one id are compared text
    by text, and a pair is reported once; an empty table gives no rows; other columns are ignored.
    """
    forms = digests(posts, targets, width)
    of = lambda field: forms.where(F.col("field") == field).drop("field")
    documents = alike_documents(of("Document")).select(F.lit("Document").alias("field"), "key_a", "key_b")
    return documents.unionByName(alike_targets(of("Targets"), of("listed")).select(F.lit("Targets").alias("field"), "key_a", "key_b"))


def alike_classes(posts: DataFrame, targets: DataFrame, width: int | None = None) -> DataFrame:
    """Classes of documents that look the same, without their pairs: (id, class, members, links).

    One row per id and text: ``class`` is the hexadecimal digest of the common form, ``members`` the rows of the class
    and ``links`` those of them whose text differs. Texts that stand alone are classes of one.
    """
    forms = digests(posts, targets, width).where("field = 'Document'").select("key", "own", "shown")
    copies = forms.groupBy("shown", "own").agg(F.count("*").alias("_copies"))
    sizes = copies.groupBy("shown").agg(F.sum("_copies").alias("members"))
    rows = forms.join(copies, ["shown", "own"]).join(sizes, "shown")
    return rows.select(F.col("key").alias("id"), F.lower(F.hex("shown")).alias("class"), "members", (F.col("members") - F.col("_copies")).alias("links"))
