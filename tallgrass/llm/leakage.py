"""Passages of held-out evaluation items inside a training corpus.

Each shard of the corpus is indexed where it lies: its words become a Burrows-Wheeler transform with wavelet-tree
ranks, all phrases of the items are searched backward at once, occurrences are found from sampled suffix positions,
and per document the hits are merged into stretches, chained in the item's order. Documents are never moved.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.fmindex import FMIndex
from tallgrass.staging import settle

PHRASE_WORDS = 8
SHARE = 0.5
SHARD_WORDS = 500_000
PART_ITEMS = 20_000  # about as many posts as executors get at once; a larger evaluation set is searched in several parts
INSTRUCTION_TEXTS = 3  # a line that leads or ends this many longer texts is an instruction, no part of a post
WORD = re.compile(r"[^\W_]+")
SPAN = "doc_id bigint, item_id bigint, covered_words int, item_words int, starts array<int>, ends array<int>"


def words_of(text: str) -> list[str]:
    """Words without case, blanks, punctuation and line marks."""
    return [w.casefold() for w in WORD.findall(unicodedata.normalize("NFC", text))]


def split_lines(text: str | None) -> list[list[str]]:
    """The words of each line of an item that has any."""
    return [w for w in (words_of(line) for line in (text or "").splitlines()) if w]


def outer_lines(lines: list[list[str]]) -> list[tuple[str, str]]:
    """(line, rest) of each line that may be an instruction of the text: its words, and those of all other lines if
    these are more. A post is thus no instruction, however many items ask about it."""
    joined = [" ".join(line) for line in lines]
    size = sum(len(line) for line in lines)
    return [(joined[i], "\n".join(joined[:i] + joined[i + 1 :])) for i, line in enumerate(lines) if 2 * len(line) < size]


def without_instructions(lines: list[list[str]], shared: dict[str, int]) -> list[str]:
    """The words of a text without the instructions that lead and end it; ``shared`` has the texts behind each one.

    A shared line between two own ones belongs to the post. If every line is shared, the least shared one stays, so
    that no post is emptied.
    """
    known = [shared.get(" ".join(line), 0) for line in lines]
    own = [i for i, n in enumerate(known) if n < INSTRUCTION_TEXTS]
    if not own and lines:
        least = min(known)
        own = [i for i, n in enumerate(known) if n == least]
    return [w for line in lines[own[0] : own[-1] + 1] for w in line] if own else []


def item_posts(items: DataFrame) -> DataFrame:
    """(post, size, item_ids) of the distinct posts of all items: words with blanks between, their number, and the items.

    Items that ask about one post with other targets or instructions share one row and are searched once. Instructions
    are told by the number of different texts they stand around.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [split_lines(t) for t in batch["text"]]
            pairs = [(i, "", line, rest) for i, own in zip(batch["item_id"], lines) for line, rest in outer_lines(own)]
            whole = [(i, "\n".join(" ".join(w) for w in own), "", "") for i, own in zip(batch["item_id"], lines)]
            yield pd.DataFrame(pairs + whole, columns=["item_id", "body", "line", "rest"])

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            posts = []
            for body, shared in zip(batch["body"], batch["shared"]):
                counts = {r["line"]: r["texts"] for r in shared} if shared is not None else {}
                posts.append(without_instructions([line.split(" ") for line in body.split("\n")], counts))
            yield pd.DataFrame({"item_id": batch["item_id"].to_numpy(), "post": pd.Series([" ".join(p) for p in posts], dtype=object), "size": [len(p) for p in posts]})

    rows = items.select("item_id", "text").where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    parsed = settle(rows.mapInPandas(parse, "item_id bigint, body string, line string, rest string"))
    lines = parsed.where("line <> ''")
    shared = lines.groupBy("line").agg(F.countDistinct("rest").alias("texts")).where(F.col("texts") >= INSTRUCTION_TEXTS)
    about = lines.join(shared, "line").groupBy("item_id").agg(F.collect_list(F.struct("line", "texts")).alias("shared"))
    bodies = parsed.where("body <> ''").select("item_id", "body").join(about, "item_id", "left")
    posts = bodies.mapInPandas(strip, "item_id bigint, post string, size int")
    return posts.groupBy("post", "size").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def best_chain(pieces: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """Most item words that stretches (item start, document start, length) cover in both orders, and the stretches.

    A stretch that overlaps the one before it counts from where that one ends.
    """
    pieces = sorted(pieces, key=lambda p: (p[1] + p[2], p[0] + p[2]))
    p, q, n = (np.array(x) for x in zip(*pieces))
    best, before = n.astype(np.int64).copy(), np.full(len(n), -1)
    for k in range(1, len(n)):
        cut = np.maximum(0, np.maximum(p[:k] + n[:k] - p[k], q[:k] + n[:k] - q[k]))
        total = np.where((cut < n[k]) & (p[:k] < p[k]) & (q[:k] < q[k]), best[:k] + n[k] - cut, -1)
        j = int(total.argmax())
        if total[j] > best[k]:
            best[k], before[k] = total[j], j
    k, chain = int(best.argmax()), []
    covered = int(best[k])
    while k >= 0:
        chain.append(pieces[k])
        k = int(before[k])
    return covered, chain[::-1]


def stretches(hits: np.ndarray, phrase: int = PHRASE_WORDS) -> list[tuple[int, int, int]]:
    """Phrase hits (item place, document place) joined along their diagonals: (item start, document start, words)."""
    hits = np.unique(hits, axis=0)
    diagonal = hits[:, 1] - hits[:, 0]
    order = np.lexsort((hits[:, 0], diagonal))
    hits, diagonal = hits[order], diagonal[order]
    new = np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (hits[1:, 0] > hits[:-1, 0] + phrase)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hits)) - 1
    return [(int(hits[a, 0]), int(hits[a, 1]), int(hits[b, 0] - hits[a, 0] + phrase)) for a, b in zip(first, last)]


class Queries:
    """The items' phrases over one small vocabulary: 0 ends a text, 1 is any word no item has, or a document's edge."""

    def __init__(self, posts: list[tuple[list[int], list[str]]], phrase: int = PHRASE_WORDS) -> None:
        self.ids: dict[str, int] = {}
        self.items = [items for items, _ in posts]
        self.lengths = [len(words) for _, words in posts]
        self.phrase = phrase
        places = defaultdict(list)
        for post, (_, words) in enumerate(posts):
            code = [self.ids.setdefault(w, len(self.ids) + 2) for w in words]
            for k in range(len(code) - phrase + 1):
                places[tuple(code[k : k + phrase])].append((post, k))
        self.phrases = np.array(list(places), np.int64).reshape(-1, phrase)
        self.places = list(places.values())
        self.sigma = len(self.ids) + 2


def _search(queries: Queries, share: float):
    def shard(docs: list[tuple[int, str, np.ndarray, np.ndarray]]) -> pd.DataFrame | None:
        """docs: (id, text, codes with runs of foreign words as one 1, word number of each code)."""
        text = np.concatenate([np.append(c, 1) for _, _, c, _ in docs])
        starts = np.cumsum([0] + [len(c) + 1 for _, _, c, _ in docs])
        index = FMIndex(text, queries.sigma)
        low, high = index.search(queries.phrases)
        count = high - low
        if not count.any():
            return None
        which = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        at = index.locate(rows)
        doc = np.searchsorted(starts, at, side="right") - 1
        hits = defaultdict(list)
        for phrase, d, place in zip(which, doc, at - starts[doc]):
            for post, k in queries.places[phrase]:
                hits[d, post].append((k, place))
        out = []
        for (d, post), pairs in hits.items():
            length = queries.lengths[post]
            pieces = stretches(np.array(pairs), queries.phrase)
            if sum(n for _, _, n in pieces) < share * length:
                continue
            covered, chain = best_chain(pieces)
            if covered >= share * length:
                doc_id, raw, _, number = docs[d]
                spans = [m.span() for m in WORD.finditer(unicodedata.normalize("NFC", raw))]
                merged: list[list[int]] = []
                for _, q, n in sorted(chain, key=lambda c: c[1]):
                    a, b = spans[number[q]][0], spans[number[q + n - 1]][1]
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                out += [(doc_id, item, covered, length, [m[0] for m in merged], [m[1] for m in merged]) for item in queries.items[post]]
        return pd.DataFrame(out, columns=["doc_id", "item_id", "covered_words", "item_words", "starts", "ends"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                code = np.array([queries.ids.get(w, 1) for w in words_of(text)], np.int64)
                keep = np.ones(len(code), bool)
                keep[1:] = (code[1:] != 1) | (code[:-1] != 1)
                if np.count_nonzero(code != 1) < queries.phrase:
                    continue
                docs.append((doc_id, text, code[keep], np.flatnonzero(keep)))
                size += int(keep.sum()) + 1
                if size >= SHARD_WORDS:
                    found = shard(docs)
                    docs, size = [], 0
                    if found is not None:
                        yield found
        if docs:
            found = shard(docs)
            if found is not None:
                yield found

    return run


def leaked(documents: DataFrame, items: DataFrame, share: float = SHARE, phrase: int = PHRASE_WORDS, part_items: int = PART_ITEMS) -> DataFrame:
    """Documents that hold at least ``share`` of an item's post in stretches of ``phrase`` words or more.

    Gives doc_id, item_id, covered_words, item_words and the spans to remove as character offsets ``starts`` and
    ``ends`` into the NFC form of the text, merged and in order. Whole texts are searched, whatever their length;
    null and blank texts hold nothing; items of fewer words than a phrase are never found; repeated documents are
    each reported; of an item's several texts the least counts; items may be empty. Other columns are ignored. Items are
    searched in parts of about ``part_items`` posts, each of which every executor gets; documents stay in their partition.
    """
    posts = settle(item_posts(items).where(F.col("size") >= phrase))
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    parts = -(-posts.count() // part_items)
    found = []
    for k in range(parts):
        rows = posts.where(F.pmod(F.xxhash64("post"), F.lit(parts)) == k).toLocalIterator()
        queries = Queries([(list(r["item_ids"]), r["post"].split(" ")) for r in rows], phrase)
        if len(queries.phrases):
            found.append(texts.mapInPandas(_search(queries, share), SPAN))
    return reduce(DataFrame.unionByName, found) if found else documents.sparkSession.createDataFrame([], SPAN)


def leaked_items(found: DataFrame) -> DataFrame:
    """Every leaked item with the number of documents that hold it: (item_id, documents)."""
    return found.select("item_id", "doc_id").distinct().groupBy("item_id").count().withColumnRenamed("count", "documents")
