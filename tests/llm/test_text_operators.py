"""The text operators: brute force, exact properties, and the defined edge cases."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallgrass.llm import consensus, cutoff, fmindex, leakage, lookalike, mixture, reading, transcripts
from tallgrass.llm.trie import Trie

POST = "id string, platform string, Document string, ParentDocument string, Targets array<string>, key string, text string, state string, tokens int, cut string"


def posts(spark, rows):
    return spark.createDataFrame([(*r, "k", "t", "s", 1, "c") for r in rows], POST)


# tries and indexes


def test_trie():
    words = ["car", "cart", "cat", "do", "é", "éa", ""]
    t = Trie(words)
    assert all(w in t for w in words) and "ca" not in t and "dog" not in t
    assert t.is_proper_prefix("ca") and not t.is_proper_prefix("car") and not t.is_proper_prefix("x")
    found, stack = [], [("", t.root())]
    while stack:
        path, node = stack.pop()
        if t.is_word(node):
            found.append(path)
        stack += [(path + c, n) for c, n in t.children(node)]
    assert sorted(found) == sorted(words)
    assert not list(Trie([]).children(Trie([]).root()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_index_finds_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 5, 400)
    text[100:200] = text[0:100]
    index = fmindex.FMIndex(text, 5)
    phrases = np.array([text[i : i + 3] for i in rng.integers(0, 390, 30)] + [[4, 4, 4], [1, 2, 1]])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b))) == want


# 1: cut texts


FULL = [f"We still need a good answer on {t} before the {e} in {p}." for t in ("water fees", "rent control", "night trains") for e in ("vote", "debate") for p in ("Foxgate", "Elkridge", "Stonebury")] + [
    f"I talked with {n} farmers about {t} and most of them want a new {e}!" for n in (12, 340, 555) for t in ("water fees", "rent control", "night trains") for e in ("vote", "debate")
]


def cuts(spark, extra):
    rows = [(f"f{i}", "p", t, None, None) for i, t in enumerate(FULL)] + [(f"x{i}", "p", t, None, None) for i, t in enumerate(extra)]
    return {int(r["id"][1:]) for r in cutoff.truncated(posts(spark, rows)).collect() if r["id"][0] == "x"}


def test_cut_and_finished_ends(spark):
    cut = ["We still need a good ans", "We still need a good answer on", "I talked with 12 farmers about water fees", "We still need a good answer on water fees befor…", "I talked with 340 farmers and&am", "I talked with 12 far��",
           "We still need a good answer [truncated]", "I talked with 12 farmers about rent con https://a.example", "We still need a good answer on water fees,"]
    done = ["We still need a good answer on water fees before the vote in Foxgate", "I talked with 12 farmers about water fees and most of them want a new vote #Now", "We still need a good answer on rent control before the vote in Elkridge …", "Fine. URL", "Thanks!\n\nMore soon",
            '"We still need a good answer on rent control before the vote in Elkridge."', "We still need a good answer on rent control before the vote in Elkridge. 👨‍👩‍👧", "", "   "]
    found = cuts(spark, cut + done)
    assert found == set(range(len(cut)))


def test_cut_edge_cases(spark):
    assert cutoff.truncated(posts(spark, [])).count() == 0
    rows = [(None, None, "We still need a good ans", None, None), ("1", "p", None, "", [None]), ("2", "p", "x " * 60_000 + "end.", None, None), ("2", "p", "x " * 60_000 + "end.", None, None)]
    got = cutoff.truncated(posts(spark, rows + [(f"f{i}", "p", t, None, None) for i, t in enumerate(FULL)])).collect()
    assert [tuple(r) for r in got] == [(None, None, "Document")]
    assert cutoff.truncation_report(posts(spark, rows)).columns == ["platform", "values", "cut_values", "cut_share"]


# 5: look-alikes


def test_units_tell_apart_what_a_reader_can():
    same = [("ｆｏｒｅｓｔ", "forest"), ("fоrеst", "forest"), ("fo​rest", "forest"), ("ﬁeld", "field"), ("été", "été"), ("top‑up", "top-up"), ("K", "K")]
    for a, b in same:
        assert lookalike.units(a) == lookalike.units(b), (a, b)
    for a, b in [("Forest", "forest"), ("ete", "été"), ("👨‍👩‍👧", "👨👩👧"), ("forest", "forests"), ("l'eau", "leau"), ("Тихая", "Тиxая_")]:
        assert lookalike.units(a) != lookalike.units(b), (a, b)
    assert lookalike.table_form("Тихая") == "Тихая" and lookalike.table_form("fоrеst") == "forest"


def test_automaton_costs():
    trie = Trie(["forest", "forests", "farm", "field"])
    assert lookalike.matches(trie, "fоr​est") == [(0, "forest")]
    assert lookalike.matches(trie, "fxrest") == []
    assert lookalike.matches(trie, "forestt", budget=1) == [(1, "forest"), (1, "forests")]


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    swap = {"o": "о", "a": "а", "e": "е", " ": " ", "i": "i​", "f": "ｆ"}
    base = ["forest harvest tax", "a wide field of oats", "Forest harvest tax", "no\nbreak here", "no break here", "тихая станция"]
    rows = []
    for i in range(40):
        t = rng.choice(base)
        rows.append((f"{i:03d}", "p", "".join(swap.get(c, c) if rng.random() < 0.15 else c for c in t), None, [rng.choice(base).replace("o", rng.choice("oо")), None]))
    rows += [rows[3], (rows[3][0], "q", "other text", None, None), ("n", "p", None, None, None), ("e", "p", "  ", None, []), (None, "p", base[0], None, None)]
    targets = spark.createDataFrame([(7, "forest harvest tax", "z"), (8, "тихая станция", "z"), (9, None, "z")], "target_id bigint, target string, text string")
    got = {tuple(r) for r in lookalike.lookalikes(posts(spark, rows), targets).collect()}

    def look(t):
        return lookalike.units(unicodedata.normalize("NFC", t).replace(" ", " ")).strip()

    want = set()
    for a in rows:
        for b in rows:
            if a[0] and b[0] and a[0] < b[0] and a[2] and b[2] and a[2].strip() and a[2] != b[2] and look(a[2]) == look(b[2]):
                want.add(("Document", a[0], b[0]))
        for t in a[4] or []:
            for k, target in ((7, "forest harvest tax"), (8, "тихая станция")):
                if a[0] and t and t != target and look(t) == look(target):
                    want.add(("Targets", a[0], str(k)))
    assert got == want
    assert lookalike.lookalikes(posts(spark, []), targets.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 200, 2000])
def test_pairs_at_any_width(spark, parts):
    """Shards with plain tokens and no odd one, and the other way round, at every number of partitions."""
    rows = [("a", "p", "forest tax and other plain words", None, ["forest tax"]), ("b", "p", "f\u043erest tax and other plain words", None, ["f\u043erest tax", "\u0442\u0438\u0445\u0430\u044f"]), ("c", "p", "something else", None, None)]
    targets = spark.createDataFrame([(7, "forest tax", "z")], "target_id bigint, target string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(parts, 200)))
    try:
        got = {tuple(r) for r in lookalike.lookalikes(posts(spark, rows), targets, width=parts).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {("Document", "a", "b"), ("Targets", "b", "7")}


def test_classes_count_members_and_links(spark):
    rows = [(k, "p", t, None, None) for k, t in [("a", "forest"), ("b", "f\u043erest"), ("c", "forest"), ("d", "tax"), ("d", "tax"), (None, "forest"), ("e", " "), ("f", None)]]
    targets = spark.createDataFrame([], "target_id bigint, target string, text string")
    got = {r["id"]: r for r in lookalike.alike_classes(posts(spark, rows), targets).collect()}
    assert {k: (r["members"], r["links"]) for k, r in got.items()} == {"a": (3, 1), "b": (3, 2), "c": (3, 1), "d": (1, 0)}
    assert len({got[k]["class"] for k in "abc"}) == 1
    assert lookalike.alike_classes(posts(spark, []), targets).count() == 0


# 6: transcripts


VIDEO = "video_id string, author_name string, seed struct<Handle:string>, transcripts struct<segments:array<struct<start:double,text:string,speaker:string>>>, author string, text string"


def turns(spark, videos, authors=()):
    df = spark.createDataFrame([(v, h, (h,), None if s is None else (s,), "a", "t") for v, h, s in videos], VIDEO)
    a = spark.createDataFrame(list(authors), "video_id bigint, speaker_index int, is_author boolean")
    return [tuple(r) for r in transcripts.speaker_turns(df, a).orderBy("video_id", "turn_no").collect()]


def test_turns(spark):
    segments = [
        (5.0, "[00:05] Yes (laughs) um, it is", "SPEAKER_01"), (1.0, "so hello", "S0"), (2.0, "(applause)", "SPK1"), (2.5, "Uhh...", "SPK1"), (3.0, "and welcome", None),
        (None, "[00:06.50] >> speaker_0: right", ""), (5.0, "[00:05] Yes (laughs) um, it is", "SPEAKER_01"), (8.0, "I think so", "@Me7"), (9.0, None, "S1"),
    ]
    got = turns(spark, [("1", "me7", segments), ("1", "me7", segments[:2])], [(1, 2, True), (1, 2, True), (1, 0, False)])
    assert got == [("1", 1, 0, 1000, "so hello and welcome"), ("1", 2, 1, 5000, "Yes it is"), ("1", 3, 0, 6500, "right"), ("1", 4, 2, 8000, "I think so")]


def test_missing_labels_follow_the_turn_before_and_the_first_ones_their_words():
    labels = [None, 0, None, 1, None, 0]
    words = [["budget", "vote"], ["cats", "dogs"], ["budget"], ["budget", "vote"], ["cats"], ["cats", "dogs"]]
    assert transcripts.infer(labels, words)[1:] == [0, 0, 1, 1, 0]
    assert transcripts.infer([None, 1, 0], [["a"], ["a"], ["b"]]) == [1, 1, 0]
    # a long run that sounds like the other speaker still goes on with the turn before it
    run = [0, 1, 0, *[None] * 50, 0, 1]
    said = [["a"] * 9, ["b"] * 9, ["a"] * 9, *[["b"] * 9] * 50, ["a"], ["b"]]
    assert transcripts.infer(run, said) == [0, 1, *[0] * 52, 1]
    assert transcripts.infer([None, None], [["a"], ["b"]]) == [None, None]


def test_handle_of_an_author_without_a_row_is_one_speaker_by_words_or_by_elimination(spark):
    me = transcripts.AUTHOR
    said = [["budget", "vote"] * 3, ["cats", "dogs"] * 3, ["budget", "vote"] * 3, ["cats", "dogs"], ["vote"], ["cats", "mice"]]
    assert transcripts.infer([0, 1, 0, me, 0, me], said) == [0, 1, 0, 1, 0, 1]
    assert transcripts.infer([0, 1, 0, me, 0, me], said[:3] + said[:1] + said[4:5] + said[:1]) == [0, 1, 0, 0, 0, 0]
    assert transcripts.infer([0, me, None], [["a"]] * 3, [0, 1]) == [0, 1, 1]
    assert transcripts.infer([0, me, None], [["a"]] * 3, [0, 1, 2]) == [0, me, me]
    schema = VIDEO + ", speaker_embeddings array<struct<speaker_index:bigint,embedding:array<float>>>"
    voices = {"1": [(0, None), (1, [0.5])], "2": None, "3": [(0, None), (1, None), (2, None), (None, None)], "4": []}
    segments = [(1.0, "hello", "S0"), (2.0, "well", "@Me"), (3.0, "go on", None), (4.0, "bye", "S0")]
    rows = [(v, "me", ("me",), (segments,), "a", "t", x) for v, x in voices.items()]
    authors = spark.createDataFrame([(9, 1, True)], "video_id bigint, speaker_index int, is_author boolean")
    got = transcripts.speaker_turns(spark.createDataFrame(rows, schema), authors).orderBy("video_id", "turn_no").collect()
    turn = [[(r["speaker_index"], r["start_ms"], r["text"]) for r in got if r["video_id"] == v] for v in voices]
    assert turn[0] == [(0, 1000, "hello"), (1, 2000, "well go on"), (0, 4000, "bye")]
    assert turn[2] == [(0, 1000, "hello"), (None, 2000, "well go on"), (0, 4000, "bye")]
    assert turn[1] == turn[3] == [(0, 1000, "hello well go on bye")]


def test_transcript_edge_cases(spark):
    assert turns(spark, [("1", "h", None), ("2", "h", []), ("3", "h", [(1.0, "[Music]", "S0"), (None, "um", None)]), (None, "h", [(1.0, "x", "S0")])]) == []
    assert turns(spark, [("4", None, [(1.0, "hello", "someone"), (float("nan"), "there", None)])]) == [("4", 1, None, 1000, "hello there")]
    long = [(float(i), "word " * 50, "S0") for i in range(2000)]
    assert len(turns(spark, [("5", "h", long)])) == 1
    assert turns(spark, []) == []


# 7: consensus


CODED = "platform string, post_id string, target string, model_stance string, coded_stance string, coder string, coded_at string, main_type string, sub_type string, party string, actor_group string, votes string, label int"


def coded(spark, rows):
    return spark.createDataFrame([(*r, "m", None, "p", "g", "v", 1) for r in rows], CODED)


def test_trustworthy_few_outweigh_unreliable_many(spark):
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(150):
        t = rng.choice(consensus.LABELS)
        truth[str(i)] = t
        for c in ("good1", "good2"):
            rows.append(("x", str(i), "t", t, t if rng.random() < 0.97 else rng.choice(consensus.LABELS), c, "2024"))
        for c in ("lazy1", "lazy2", "lazy3"):
            if rng.random() < 0.7:
                rows.append(("x", str(i), "t", t, "NEUTRAL" if rng.random() < 0.9 else rng.choice(consensus.LABELS), c, "2024"))
    items, who = consensus.consensus(coded(spark, rows))
    got = {r["post_id"]: r["stance"] for r in items.collect()}
    votes = defaultdict(Counter)
    for r in rows:
        votes[r[1]][r[4]] += 1
    right = sum(got[k] == t for k, t in truth.items())
    # the two reliable coders disagree on about 6 items of 150, which nothing in the answers can settle
    assert right >= 140 and right > sum(votes[k].most_common(1)[0][0] == t for k, t in truth.items()) + 20
    r = {x["annotator"]: x["reliability"] for x in who.collect()}
    assert r["good1"] > 0.9 and r["lazy1"] < 0.6 and r["model_stance"] > 0.9


def test_latest_answer_case_and_blanks(spark):
    rows = [("X ", "1", "t", "FAVOR", " favor ", "A", "2024-01-01"), ("x", "1", "t", "FAVOR", "against", "a ", "2024-02-01"), ("x", "1", "t", "FAVOR", "against", "a", "2024-02-01"), ("x", "1", "t", "FAVOR", "", "b", None), ("x", "1", "t", None, "huh", "c", "2024"),
            (None, "1", "t", "FAVOR", "FAVOR", "d", "2024"), ("x", None, "t", "FAVOR", "FAVOR", "d", "2024"), ("x", "2", "t", None, None, "a", None)]
    items, _ = consensus.consensus(coded(spark, rows), passes=2)
    got = {r["post_id"]: r for r in items.collect()}
    assert got["1"]["coders"] == 3 and got["1"]["answers"] == 1 and got["1"]["stance"] == "AGAINST"
    assert got["2"]["coders"] == 1 and got["2"]["answers"] == 0
    empty, who = consensus.consensus(coded(spark, []))
    assert empty.count() == 0 and who.count() == 0


# 8: leakage


ITEM = "item_id bigint, text string, doc_id string"
DOC = "doc_id bigint, text string, lang string, source string, item_id string, starts string, tokens string, order string, words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s[0] if s else "en", s[1] if len(s) > 1 else "a", "i", "s", "t", "o", "w") for i, t, *s in rows], DOC)


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    items = [(i, "Say the stance.\n" + " ".join(rng.choice(words) for _ in range(30)) + "\nOne word only.", None) for i in range(12)]
    rows = []
    for i in range(60):
        own = items[rng.randrange(12)][1].split("\n")[1].split()
        a, n = rng.randrange(20), rng.choice([6, 8, 15, 22, 30])
        b = rng.randrange(20)
        text = " ".join([*(rng.choice(words) for _ in range(5)), *own[a : a + n], "noise", *own[b : b + 9], *(rng.choice(words) for _ in range(5))])
        rows.append((i, text.upper() if i % 3 else "> " + text.replace(" w1", ",\n> w1")))
    rows += [(100, None), (101, ""), (102, "  "), (103, items[0][1] * 400), (103, items[0][1] * 400), (None, items[0][1]), (104, "One word only. Say the stance.")]
    got = {(r["doc_id"], r["item_id"]): r for r in leakage.leaked(docs(spark, rows), spark.createDataFrame(items, ITEM)).collect()}
    own = {i: r["post"].split(" ") for r in leakage.item_posts(spark.createDataFrame(items, ITEM)).collect() for i in r["item_ids"]}
    assert all(len(w) == 30 for w in own.values())
    for i, text in rows:
        if text is None or i is None:
            continue
        w = leakage.words_of(text)
        for item, p in own.items():
            best = brute(p, w) if len(w) < 200 else (30 if item == 0 else 0)
            assert ((i, item) in got) == (2 * best >= 30), (i, item, best)
            if (i, item) in got:
                assert got[i, item]["covered_words"] == best
    spans = got[103, 0]
    kept = unicodedata.normalize("NFC", rows[63][1])
    assert leakage.words_of(kept[spans["starts"][0] : spans["ends"][-1]])[:3] == own[0][:3]


def brute(p, w, phrase=8):
    """Most words of p covered in order by stretches of at least ``phrase`` words: plain dynamic programming over starts."""
    runs = []
    for i in range(len(p)):
        for j in range(len(w)):
            if p[i] == w[j] and (i == 0 or j == 0 or p[i - 1] != w[j - 1]):
                n = 0
                while i + n < len(p) and j + n < len(w) and p[i + n] == w[j + n]:
                    n += 1
                if n >= phrase:
                    runs.append((i, j, n))
    runs.sort(key=lambda r: (r[1] + r[2], r[0] + r[2]))
    best = []
    for k, (i, j, n) in enumerate(runs):
        value = n
        for m in range(k):
            a, b, c = runs[m]
            cut = max(0, a + c - i, b + c - j)
            if cut < n and a < i and b < j:
                value = max(value, best[m] + n - cut)
        best.append(value)
    return max(best, default=0)


@pytest.mark.parametrize("asked", [1, 3, 10, 100])
def test_no_item_of_one_post_is_lost(spark, asked):
    """One post asked about with many targets, under many instructions, alone, and with short lines around it."""
    rng = random.Random(asked)
    say = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    post, other = say(60), say(40)
    items = [(i, "Say the stance of the text.\n" + post + "\nOne word only.", "d") for i in range(asked)]
    items += [(1000 + i, f"Which stance does it take toward target{i} please?\n" + post, "d") for i in range(asked)]
    items += [(2000 + i, post + f"\n#tag{i}", "d") for i in range(asked)] + [(3000, post, "d"), (3001, "Say the stance of the text.\n" + other + "\nOne word only.", "d")]
    items += [(4000 + i, "Say the stance of the text.\n" + say(30) + "\nOne word only.", "d") for i in range(5)]
    items += [(5000 + i, "Say the stance of the text.\nShared line in the middle of all.\nSay the stance of the text.", "d") for i in range(3)]
    spark_items = spark.createDataFrame(items, ITEM)
    found = leakage.leaked(docs(spark, [(1, "start " + post + " end"), (2, other), (3, "Say the stance of the text. One word only.")]), spark_items, part_items=2).collect()
    ids = {i for i, *_ in items}
    assert {r["item_id"] for r in found if r["doc_id"] == 1} == {i for i in ids if i <= 3000}
    assert {r["item_id"] for r in found if r["doc_id"] == 2} == {3001}
    assert not [r for r in found if r["doc_id"] == 3]
    assert {r["covered_words"] for r in found if r["item_id"] < 1000 and r["doc_id"] == 1} == {60}


def test_leak_edge_cases(spark):
    none = spark.createDataFrame([], ITEM)
    assert leakage.leaked(docs(spark, [(1, "a b c")]), none).count() == 0
    short = spark.createDataFrame([(1, "too short a post", None), (2, None, None), (None, "x " * 20, None)], ITEM)
    assert leakage.leaked(docs(spark, [(1, "too short a post")]), short).count() == 0
    assert leakage.leaked(docs(spark, []), spark.createDataFrame([(1, "a b c d e f g h i j", None)], ITEM)).count() == 0


# 9: mixture


def target_table(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "source string, target_share double, max_repeats int, tokens int")


def test_mixture_shares_caps_and_copies(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("one two three four five six".split()) for _ in range(rng.randrange(3, 60))) + f" {i}", "en", " Big " if i % 2 else "big") for i in range(400)]
    rows += [(1000 + i, f"small text number {i} of the few", "en", "small") for i in range(30)]
    rows += [(2000 + i, "small text number 3 of the few", "en", "small") for i in range(300)] + [(3000, "left out", "en", "other"), (3001, None, "en", "big"), (3002, " ", "en", None)]
    t = target_table(spark, [("big", 0.8, 1), ("SMALL", 0.2, 3), ("none", 0.3, 2), (None, 0.1, 1)])
    got = mixture.mix(docs(spark, rows), t, blocks=5).collect()
    assert {r["source"] for r in got} == {"big", "small"}
    size = Counter()
    for r in got:
        assert 1 <= r["copies"] <= {"big": 1, "small": 3}[r["source"]]
        size[r["source"]] += r["tokens"] * r["copies"]
    texts = {i: x for i, x, *_ in rows}
    used = Counter(texts[r["doc_id"]] for r in got)
    assert max(used.values()) == 1  # copies of a text are one text
    assert size["small"] / sum(size.values()) == pytest.approx(0.2, abs=0.02)
    report = {r["source"]: r for r in mixture.shares(mixture.mix(docs(spark, rows), t), t).where("source is not null").collect()}
    assert report["none"]["tokens"] == 0 and report["big"]["share"] == pytest.approx(0.8, abs=0.02)
    again = mixture.mix(docs(spark, rows[::-1]), t, blocks=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_copies_follow_the_prefix_sums(spark):
    """Copies at each place against whole numbers crossed by plain prefix sums, whatever the blocks."""
    rows = [(i, f"text number {i} " + "word " * (i % 7), "en", "a" if i % 3 else "b") for i in range(300)]
    t = target_table(spark, [("a", 0.5, 5), ("b", 0.5, 3)])
    sized = sorted(tuple(r) for r in mixture.sized_texts(docs(spark, rows), t).select("source", "tokens", "order", "doc_id").collect())
    rates = mixture.plan_rates([(s, sum(r[1] for r in sized if r[0] == s)) for s in "ab"], [("a", 0.5, 5), ("b", 0.5, 3)])
    want = {}
    for s in "ab":
        first = spark.range(1).selectExpr(f"pmod(xxhash64(7, '{s}'), {mixture.UNIT})").first()[0]
        total = first
        for _, _, _, doc_id in [r for r in sized if r[0] == s]:
            step = int(rates[s] * mixture.UNIT)
            want[doc_id] = (total + step) // mixture.UNIT - total // mixture.UNIT
            total += step
    for blocks in (1, 3, 7):
        got = {r["doc_id"]: r["copies"] for r in mixture.mix(docs(spark, rows), t, blocks=blocks).collect()}
        assert got == {k: v for k, v in want.items() if v}


def test_mixture_edge_cases(spark):
    t = target_table(spark, [("a", 0.5, 2), ("b", 0.5, 1)])
    assert mixture.mix(docs(spark, []), t).count() == 0
    assert mixture.mix(docs(spark, [(1, "text", "en", "a")]), target_table(spark, [])).count() == 0
    got = mixture.mix(docs(spark, [(1, "word " * 50_000, "en", "a"), (2, "word", "en", "b")]), t, total=10**9).collect()
    assert all(r["copies"] <= 2 for r in got)
    assert mixture.plan_rates([("a", 10), ("b", 5)], [("a", 0.5, 2), ("b", 0.5, 1), ("c", None, 1)]) == {"a": 0.5, "b": 1.0}


# 10: reading level


SIMPLE = "My dog is big. I like my dog. We go to the park. It is warm and dry. "
HARD = "Notwithstanding the aforementioned jurisdictional considerations, the interdisciplinary methodology presupposes institutional accountability, whereas the epistemic legitimacy of longitudinal estimation remains, by implication, contested throughout. "


def test_levels_on_held_out_texts(spark):
    rng = random.Random(3)
    rows, labels, truth = [], [], {}
    for i in range(120):
        hard = i % 3 == 0
        parts = (HARD if hard else SIMPLE).split(" ")
        rng.shuffle(parts)
        text = " ".join(parts) + (HARD if hard else SIMPLE)
        rows.append((i, text, "fr" if i % 5 == 0 else None))
        truth[i] = 4 if hard else 1
        if i < 60:
            labels += [(i, "r1", truth[i], "x"), (i, "r2", truth[i], "x"), (i, "r2", truth[i], "x")]
    rows += [(500, "Le chat est dans la maison et il ne sort pas de la rue. " * 3, "en"), (501, None, "en"), (502, "", "en"), (503, "!!! 123", "en"), (None, SIMPLE, "en"), (504, SIMPLE * 3000, "en"), (3, rows[3][1], None)]
    labels += [(None, "r1", 4, "x"), (501, "r1", 9, "x"), (999, None, None, "x")]
    df = docs(spark, [(i, t, lang) for i, t, lang in rows])
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, level int, above string")
    got = {r["doc_id"]: r["level"] for r in reading.reading_levels(df, lab).collect()}
    assert set(got) == set(truth) | {504}
    assert np.mean([got[i] == truth[i] for i in range(60, 120)]) >= 0.9
    assert reading.reading_levels(df, lab.limit(0)).count() == len(got)
    assert reading.reading_levels(df.limit(0), lab).count() == 0


OTHERS = {
    "nl": "De minister heeft gisteren in Den Haag gezegd dat de nieuwe wet was uitgesteld en dat we in de kamer of daarbuiten nog wachten.",
    "da": "Regeringen har i dag besluttet at den nye lov skal gælde for alle under atten og at man har under et halvt år til at få den på plads.",
    "sv": "Regeringen har i dag beslutat att den nya lagen ska gälla för alla under arton och att man har ett halvt år på sig i alla fall.",
    "pl": "Rząd podjął dzisiaj decyzję, że nowa ustawa będzie obowiązywać od stycznia i to na pewno nie będzie po myśli opozycji, a my do tego by wrócili.",
}


def test_other_languages_are_no_english(spark):
    """Texts in languages that no list names, alone, labelled as English, and many with their own label."""
    rng = random.Random(6)
    rows = []
    for i in range(60):
        parts = (HARD if i % 3 == 0 else SIMPLE).split(" ")
        rng.shuffle(parts)
        rows.append((i, " ".join(parts) + (HARD if i % 3 == 0 else SIMPLE), "en"))
    rows += [(100 + i, t, lang) for i, t in enumerate(OTHERS.values()) for lang in ("en",)]
    rows += [(200 + 10 * i + k, t + f" {k}", code) for i, (code, t) in enumerate(OTHERS.items()) for k in range(8)]
    got = {r["doc_id"] for r in reading.profile(docs(spark, rows)).collect()}
    assert got == set(range(60))


def test_word_ranks_and_coverage(spark):
    rows = [(1, "the the the cat"), (2, "the cat sat"), (3, "zebra zebra quagga")]
    texts = spark.createDataFrame([(i, t.split()) for i, t in rows], "doc_id bigint, plain array<string>")
    counts = Counter(w for _, t in rows for w in t.split())
    rank = {w: 1 + sum(c > counts[w] for c in counts.values()) for w in counts}
    got = {r["doc_id"]: r["coverage_rank"] for r in reading.coverage_ranks(texts).collect()}
    for i, t in rows:
        by = defaultdict(int)
        for w in t.split():
            by[rank[w]] += 1
        total, want = 0, None
        for r in sorted(by):
            total += by[r]
            if total >= 0.9 * len(t.split()):
                want = r
                break
        assert got[i] == want
