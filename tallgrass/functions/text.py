"""Text columns: tidying, cutting, cleaning of targets, links and keys."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from the ends of a target.
TRAILING = ",.:?!\"'“”‘’…"
LEADING = "@#\"'“”‘’"
# Emoji ranges.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2600}-\x{26FF}]"


def strip(c: Column, chars: str | None = None) -> Column:
    """Both ends free of blanks of any kind, or of the given characters."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "") if chars is None else F.btrim(c, F.lit(chars))


def blank_to_null(c: Column) -> Column:
    """Stripped text, null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def replace_first(c: Column, pattern: str, to: str) -> Column:
    """The first match replaced; ``pattern`` must not hold groups."""
    return F.regexp_replace(c, f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{to}$2")


def joined(parts: list[Column], by: str) -> Column:
    """The parts that aren't blank, joined; null if none is left."""
    return blank_to_null(F.concat_ws(by, *[blank_to_null(p) for p in parts]))


def cleaned_target(c: Column) -> Column:
    """A target without remarks in brackets, emoji, outer punctuation, all after a comma and forwarding marks.

    Fixed values: the patterns and their order decide which spellings come out equal.
    """
    c = replace_first(c, r"\s*\([^)]*\)", "")
    c = F.regexp_replace(c, EMOJI, "")
    c = F.rtrim(c, F.lit(TRAILING))
    c = F.ltrim(c, F.lit(LEADING))
    c = F.regexp_replace(c, r"(?s),.*$", "")
    c = F.regexp_replace(F.regexp_replace(c, "^rt @ ", ""), "^rt@", "")
    return strip(c)


def spelling_key(c: Column) -> Column:
    """Letters and digits alone, in lower case: equal for spelling variants."""
    return F.lower(F.regexp_replace(c, r"[^0-9\p{L}]+", ""))


def cut_at_boundary(c: Column, limit: int, kept: float = 0.5) -> Column:
    """Text longer than ``limit`` characters cut back to its last sentence, line or word end within them.

    A boundary that keeps less than the share ``kept`` is passed over for the bare cut.
    """
    cut = strip(F.substring(c, 1, limit))
    ends = (r"(?s)^(.*[.!?…。！？])(?:\s|$)", r"(?s)^(.*)\n", r"(?s)^(.*)\s")
    boundary = strip(F.coalesce(*[F.nullif(F.regexp_extract(cut, e, 1), F.lit("")) for e in ends]))
    short = F.when(F.length(boundary) >= kept * F.length(cut), boundary).otherwise(cut)
    return F.when(F.length(c) > limit, short).otherwise(c)


def shortened(c: Column, limit: int = 300) -> Column:
    """Markup made harmless in its first bracket of either kind; longer text ends in three dots."""
    safe = replace_first(replace_first(c, "<", "&lt;"), ">", "&gt;")
    return F.when(F.length(safe) > limit, F.concat(F.substring(safe, 1, limit - 3), F.lit("..."))).otherwise(safe)


def content_key(*parts: Column) -> Column:
    """64-bit key of everything a model sees; nulls and blanks are the same."""
    return F.xxhash64(F.concat_ws("\u0000", *[F.coalesce(p, F.lit("")) for p in parts]))


def short_code(ident: Column) -> Column:
    """A media number in the base-64 alphabet of short links."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    at = lambda i: F.call_function("div", ident, F.lit(64**i)) % 64
    digits = F.concat(*[F.substring(F.lit(letters), at(i).cast("int") + 1, 1) for i in range(10, -1, -1)])
    return F.regexp_replace(digits, "^A+(?=.)", "")


def permalink(platform: Column, handle: Column, ident: Column) -> Column:
    """The public address of a post."""
    at = F.split(ident, "/")
    return (
        F.when(platform == "twitter", F.concat(F.lit("https://twitter.com/"), handle, F.lit("/status/"), ident))
        .when(platform == "tiktok", F.concat(F.lit("https://www.tiktok.com/@"), handle, F.lit("/video/"), ident))
        .when(platform == "bluesky", F.concat(F.lit("https://bsky.app/profile/"), at[0], F.lit("/post/"), F.element_at(at, -1)))
    )


def platform_of(handle_id: Column) -> Column:
    """The middle part of ``<id>-<platform>-<name>``."""
    return F.lower(F.try_element_at(F.split(handle_id, "-"), F.lit(2)))


def contains_any(c: Column, literals: Sequence[str]) -> Column:
    """Does the text hold any of the literals; none at all gives false. One pattern, so the text is walked once."""
    return c.rlike("|".join(re.escape(x) for x in literals)) if literals else F.when(c.isNotNull(), F.lit(False))


def without_values(c: Column, values: Sequence[str]) -> Column:
    """Null where the text is one of the values that stand for nothing."""
    return F.when(~c.isin(*values), c)


def embed_link(url: Column) -> Column:
    """The address under which a post's page can be embedded, from its permalink; null for any other address."""
    video = F.regexp_extract(url, r"tiktok\.com/(?:@[^/]*/)?video/(\d+)", 1)
    image = F.regexp_extract(url, r"instagram\.com/(?:p|reel)/([\w-]+)", 1)
    post = F.regexp_extract(url, r"bsky\.app/profile/([^/]+)/post/", 1)
    key = F.regexp_extract(url, r"/post/([^/?#]+)", 1)
    tweet = F.regexp_extract(url, r"twitter\.com/[^/]+/status/(\d+)", 1)
    return (
        F.when(video != "", F.concat(F.lit("https://www.tiktok.com/embed/v2/"), video))
        .when(image != "", F.concat(F.lit("https://www.instagram.com/p/"), image, F.lit("/embed")))
        .when(post != "", F.concat(F.lit("https://embed.bsky.app/embed/"), post, F.lit("/app.bsky.feed.post/"), key))
        .when(tweet != "", F.concat(F.lit("https://platform.twitter.com/embed/Tweet.html?id="), tweet))
    )


def axis_label(names: Column, loadings: Column, most: int = 3) -> Column:
    """The strongest of several signed parts of an axis as ``+name, -name``; ties go by name."""
    pairs = F.arrays_zip(loadings.alias("l"), names.alias("n"))
    order = lambda a, b: F.when(F.abs(a["l"]) > F.abs(b["l"]), -1).when(F.abs(a["l"]) < F.abs(b["l"]), 1).when(a["n"] < b["n"], -1).otherwise(1)
    return F.array_join(F.transform(F.slice(F.array_sort(pairs, order), 1, most), lambda p: F.concat(F.when(p["l"] < 0, "-").otherwise("+"), p["n"])), ", ")


def first_match(c: Column, rules: Sequence[tuple[str, str]], other: Column) -> Column:
    """The name of the first rule (name, pattern) that matches without regard to case, else ``other``."""
    out = other
    for name, pattern in reversed(rules):
        out = F.when(F.lower(c).rlike(pattern), F.lit(name)).otherwise(out)
    return out
