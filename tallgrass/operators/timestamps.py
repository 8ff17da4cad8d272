"""Timestamps of mixed format, precision and zone to one instant in UTC.

Every value is turned into the array of its valid interpretations. Over each source's record order the cheapest
chain of interpretations is chosen (Viterbi): an interpretation has a cost of its own, and neighbours pay for a
switch of format and for a jump back in time. A record with one interpretation cuts the chain, so only runs of
ambiguous records are walked; runs that reach the edge of a block are joined by min-plus products of their
transfer matrices, which makes the result the same as that of one walk over the whole source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.trailing import is_blank
from tallgrass.staging import ordered_blocks

# The zone letters in use in Canada, English and French, in minutes from UTC.
ZONE_LETTERS = {
    "Z": 0, "UTC": 0, "GMT": 0,
    "NST": -210, "NDT": -150, "HNT": -210, "HAT": -150,
    "AST": -240, "ADT": -180, "HNA": -240, "HAA": -180,
    "EST": -300, "EDT": -240, "HNE": -300, "HAE": -240,
    "CST": -360, "CDT": -300, "HNC": -360, "HAC": -300,
    "MST": -420, "MDT": -360, "HNR": -420, "HAR": -360,
    "PST": -480, "PDT": -420, "HNP": -480, "HAP": -420,
}
MONTHS = [
    ("jan", "janv", "january", "janvier"), ("feb", "fev", "fév", "févr", "fevr", "february", "février", "fevrier"),
    ("mar", "mars", "march"), ("apr", "avr", "april", "avril"), ("may", "mai"), ("jun", "juin", "june"),
    ("jul", "juil", "july", "juillet"), ("aug", "aou", "aoû", "août", "aout", "august"),
    ("sep", "sept", "september", "septembre"), ("oct", "october", "octobre"), ("nov", "november", "novembre"),
    ("dec", "déc", "december", "décembre", "decembre"),
]

DAY_US = 86_400_000_000
EARLIEST_US = 1_577_836_800_000_000  # 2020-01-01
END_US = 1_767_225_600_000_000  # 2026-01-01

CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
ZONE = r"([A-Za-z]+/[A-Za-z_/]+|[A-Za-z]{1,5}|[+-]\d{2}:?(?:\d{2})?)?"
# Each pattern is rewritten to year;month;day;hour;minute;second;fraction;half of day;zone;region.
PATTERNS = [
    ("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[Tt ]{CLOCK} ?{ZONE}(?:\[([^\]]+)\])?$", "$1;$2;$3;$4;$5;$6;$7;;$8;$9"),
    ("digits", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))? ?{ZONE}$", "$1;$2;$3;$4;$5;$6;$7;;$8;"),
    ("day_first", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}),?[Tt ]{CLOCK} ?([AaPp]\.?[Mm]\.?)? ?{ZONE}$", "$3;$2;$1;$4;$5;$6;$7;$8;$9;"),
    ("mail", rf"^(?:[A-Za-z]{{2,9}}\.?,? )?(\d{{1,2}}) ([A-Za-zéûÉÛ]{{3,9}})\.?,? (\d{{4}}),? {CLOCK} ?{ZONE}$", "$3;$2;$1;$4;$5;$6;$7;;$8;"),
    ("unix", rf"^(?:[A-Za-z]{{3,9}} )([A-Za-z]{{3,9}}) +(\d{{1,2}}) {CLOCK} (?:{ZONE} )?(\d{{4}})$", "$8;$1;$2;$3;$4;$5;$6;;$7;"),
    ("written", rf"^(?:[A-Za-z]{{3,9}}, )?([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}}),?(?: at)? {CLOCK} ?([AaPp]\.?[Mm]\.?)? ?{ZONE}$", "$3;$1;$2;$4;$5;$6;$7;$8;$9;"),
    ("french", r"^(?:\p{L}{3,9} )?(\d{1,2})(?:er)? (\p{L}{3,9})\.? (\d{4}),? (?:à|a) (\d{1,2}) ?[hH] ?(\d{2})?(?: ?(?:min)? ?(\d{2}) ?s?)?$", "$3;$2;$1;$4;$5;$6;;;;"),
    ("short", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}),?[Tt ]{CLOCK} ?([AaPp]\.?[Mm]\.?)? ?{ZONE}$", "20$1;$2;$3;$4;$5;$6;$7;$8;$9;"),
]
EPOCH = r"^(\d{9,19})(?:[.](\d{1,9}))?$"

SWITCH_COST = 1.0
BACKWARD_COST = 1.0
SECOND_PASS_COST = 5.0  # the later reading of a clock hour that occurs twice: above all that two neighbours can add


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def _fraction(text: Column) -> Column:
    """Digits after the point, as microseconds (further digits are cut)."""
    return F.coalesce(F.substring(F.rpad(text, 6, "0"), 1, 6).try_cast("bigint"), F.lit(0))


def _month(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for i, group in enumerate(MONTHS, 1) for name in group for x in (name, i)])
    return F.coalesce(text.try_cast("int"), F.try_element_at(names, F.lower(text)))


def _wall(turned: bool = False) -> Column:
    """Microseconds of the written date and clock, as if in UTC; null where there is no such date or clock.

    ``turned`` takes the day of a short date for its year and the other way round.
    """
    at = lambda i: F.element_at("_fields", i)
    year, day = (F.concat(F.lit("20"), at(4)), F.substring(at(2), 3, 2)) if turned else (at(2), at(4))
    date = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(_month(at(3)).cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
    half, hour = F.col("_half"), F.col("_hour")
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    minute = F.coalesce(F.nullif(at(6), F.lit("")).try_cast("int"), F.lit(0))
    second = F.coalesce(F.nullif(at(7), F.lit("")).try_cast("int"), F.lit(0))
    clock = (hour * 3600 + minute * 60 + second).cast("bigint") * 1_000_000 + _fraction(at(8))
    good = F.col("_hour").between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    return F.when(good, F.unix_date(date).cast("bigint") * DAY_US + clock)


def _to_utc(us: Column, zone: Column) -> Column:
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), zone))


def with_readings(records: DataFrame, value: str, zone: str) -> DataFrame:
    """``records`` with ``readings``, all valid readings of a value: array of (us, cost, form, zoned).

    ``value`` names a string column, ``zone`` a column with the name of the zone that holds where the value names
    none. Numbers of 9 to 19 digits are tried as seconds, milli-, micro- and nanoseconds since 1970 and, at 14
    digits, as date and clock. Dates in digits alone have the year or the day first; where the year has two digits both
    orders are readings, so that 21-02-23 is 23 February 2021 in the form of iso or 21 February 2023 with the day first.
    An hour that occurs twice gives both instants, the later one at a cost; one that is skipped is read with the offset
    before the change. A value that names an unknown zone, no such date, or an instant outside 2020 to 2025 gives no reading.
    """
    regions = sorted(available_timezones())
    clean = F.col("_clean")
    rewritten = F.lit(None).cast("string")
    for name, pattern, to in reversed(PATTERNS):
        rewritten = F.when(clean.rlike(pattern), F.regexp_replace(clean, pattern, name + ";" + to)).otherwise(rewritten)
    at = lambda i: F.element_at("_fields", i)
    letters = F.create_map(*[F.lit(x) for k, v in ZONE_LETTERS.items() for x in (k, v * 60)])
    digits = F.regexp_replace("_written", r"\D", "")
    minutes = F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("int"), F.lit(0))
    numeric = F.when(F.startswith("_written", F.lit("-")), -1).otherwise(1) * (F.substring(digits, 1, 2).try_cast("int") * 3600 + minutes * 60)
    offset = F.when(F.col("_written").rlike(r"^[+-]"), numeric).otherwise(F.try_element_at(letters, F.upper("_written")))
    named = F.when(F.contains("_written", F.lit("/")), F.col("_written")).when((F.col("_written") == "") & (F.col("_region") != ""), F.col("_region"))
    place = F.when(F.col("_named").isNotNull(), F.when(F.col("_named").isin(regions), F.col("_named"))).when(F.col("_written") == "", F.col(zone))

    # each step is a column of its own, so that no pattern is matched twice
    steps = records.withColumn("_clean", _tidy(F.col(value)))
    steps = steps.withColumn("_fields", F.split(rewritten, ";")).withColumn("_written", at(10)).withColumn("_region", at(11))
    steps = steps.withColumn("_offset", offset).withColumn("_named", named).withColumn("_place", place)
    steps = steps.withColumn("_hour", at(5).try_cast("int")).withColumn("_half", F.lower(F.substring(at(9), 1, 1))).withColumn("_wall", _wall())
    steps = steps.withColumn("_turned", F.when(at(1) == "short", _wall(turned=True)))
    for wall, early in (("_wall", "_early"), ("_turned", "_turned_early")):
        steps = steps.withColumn(early, F.when(F.col("_offset").isNull(), _to_utc(F.col(wall), F.col("_place"))))
    steps = steps.withColumn("_number", F.regexp_extract(clean, EPOCH, 1).try_cast("bigint")).withColumn("_tail", F.regexp_extract(clean, EPOCH, 2))

    reading = lambda us, cost, what, zoned: F.struct(us.cast("bigint").alias("us"), F.lit(cost).alias("cost"), what.alias("form"), zoned.alias("zoned"))
    zoned = F.col("_offset").isNotNull() | F.col("_named").isNotNull()
    number, yes = F.col("_number"), F.lit(True)
    scaled = lambda unit: F.when(number.between(EARLIEST_US // unit, END_US // unit), number * unit)
    thousandths = F.coalesce(F.substring(F.rpad("_tail", 3, "0"), 1, 3).try_cast("bigint"), F.lit(0))

    def clock(wall: str, early: str, form: Column) -> list[Column]:
        again = F.col(early) + 3_600_000_000
        twice = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(again), F.col("_place"))) == F.col(wall)
        return [
            F.when(F.col("_offset").isNotNull(), reading(F.col(wall) - F.col("_offset").cast("bigint") * 1_000_000, 0.0, form, zoned)),
            reading(F.col(early), 0.0, form, zoned),
            F.when(twice, reading(again, SECOND_PASS_COST, form, zoned)),
        ]

    readings = F.array(
        *clock("_wall", "_early", F.when(at(1) == "short", "iso").otherwise(at(1))),
        *clock("_turned", "_turned_early", F.lit("day_first")),
        reading(scaled(1_000_000) + _fraction(F.col("_tail")), 0.0, F.lit("seconds"), yes),
        reading(scaled(1000) + thousandths, 0.0, F.lit("millis"), yes),
        reading(scaled(1), 0.0, F.lit("micros"), yes),
        reading(F.expr("_number div 1000"), 0.0, F.lit("nanos"), yes),
    )
    usable = F.filter(readings, lambda r: r.isNotNull() & r["us"].between(EARLIEST_US, END_US - 1))
    scratch = ["_clean", "_fields", "_written", "_region", "_offset", "_named", "_place", "_hour", "_half", "_wall", "_turned", "_early", "_turned_early", "_number", "_tail"]
    return steps.withColumn("readings", usable).drop(*scratch)


def _penalty(form_a: str, us_a: int, form_b: str, us_b: int) -> float:
    return SWITCH_COST * (form_a != form_b) + BACKWARD_COST * (us_b < us_a)


def _step(costs: np.ndarray, before: list, now: list) -> tuple[np.ndarray, np.ndarray]:
    """Costs (start x before) moved on to ``now``: the new costs and, per start, the best predecessor."""
    move = np.array([[_penalty(a[2], a[0], b[2], b[0]) for b in now] for a in before])
    total = costs[:, :, None] + move[None]
    own = np.array([b[1] for b in now])
    return total.min(axis=1) + own, total.argmin(axis=1)


def _solve(left: tuple | None, run: list[list], right: tuple | None) -> list[int]:
    """The cheapest choice in each record of an ambiguous run between two settled neighbours (None at a source's ends)."""
    first = run[0]
    costs = np.array([[c[1] + (_penalty(left[2], left[0], c[2], c[0]) if left else 0.0) for c in first]])
    back = []
    for before, now in zip(run, run[1:]):
        costs, best = _step(costs, before, now)
        back.append(best[0])
    end = costs[0] + np.array([_penalty(c[2], c[0], right[2], right[0]) if right else 0.0 for c in run[-1]])
    picks = [int(end.argmin())]
    for best in reversed(back):
        picks.append(int(best[picks[-1]]))
    return picks[::-1]


def _transfer(rows: list[list]) -> np.ndarray:
    """Least cost from each candidate of the first record to each of the last, own costs included."""
    k = len(rows[0])
    costs = np.full((k, k), np.inf)
    costs[range(k), range(k)] = [c[1] for c in rows[0]]
    for before, now in zip(rows, rows[1:]):
        costs, _ = _step(costs, before, now)
    return costs


PIECE = "_block int, _source string, _heads array<struct<us:bigint,form:string>>, _tails array<struct<us:bigint,form:string>>, _matrix array<array<double>>"


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(source, settled readings' columns..., candidates) in order; candidates are None where there is one reading."""
    for batch in batches:
        yield from zip(batch["_source"], batch["_us"], batch["_form"], batch["_cands"], batch["_key"], batch["_block"])


def _cands(us: int, form: str, many) -> list[tuple]:
    return [(int(us), 0.0, form)] if many is None else [(int(c["us"]), float(c["cost"]), c["form"]) for c in many]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the first and the last source of a block: its transfer matrix over the block.

    A settled record in a piece splits its matrix into a column and a row, so what is kept is the run at either end.
    """
    done: list[dict] = []
    head: list[list] = []  # the first run up to the first settled record
    tail: list[list] = []  # from the last settled record on
    cut = False
    source, block = None, None

    def close() -> None:
        if not head:
            return
        matrix = _transfer(head)
        if cut:
            matrix = matrix[:, :1] + _transfer(tail)[:1]
        last = tail[-1] if cut else head[-1]
        done.append({"_block": block, "_source": source, "_heads": [{"us": c[0], "form": c[2]} for c in head[0]], "_tails": [{"us": c[0], "form": c[2]} for c in last], "_matrix": matrix.tolist()})
        if len(done) > 2:
            done.pop(1)

    for s, us, form, many, _, b in _records(batches):
        if s != source or not head:
            close()
            source, block, head, tail, cut = s, b, [], [], False
        now = _cands(us, form, many)
        if cut:
            tail = [now] if len(now) == 1 else [*tail, now]
        else:
            head.append(now)
            if len(now) == 1:
                cut, tail = True, [now]
    close()
    if done:
        yield pd.DataFrame(done)


def _join_pieces(pieces: pd.DataFrame) -> pd.DataFrame:
    """The choice at the first and last record of each piece of one source, cheapest over all pieces together."""
    pieces = pieces.sort_values("_block")
    costs, back, before = None, [], None
    for heads, tails, matrix in zip(pieces["_heads"], pieces["_tails"], pieces["_matrix"]):
        m = np.array([list(r) for r in matrix])
        if costs is None:
            total = m
        else:
            move = np.array([[_penalty(a["form"], a["us"], b["form"], b["us"]) for b in heads] for a in before])
            enter = (costs[:, None] + move).min(axis=0)
            total = enter[:, None] + m
            back.append((costs[:, None] + move).argmin(axis=0))
        best_head = total.argmin(axis=0)
        costs, before = total.min(axis=0), list(tails)
        back.append(best_head)
    picks, at = [], int(costs.argmin())
    steps = list(back)
    while steps:
        head = int(steps.pop()[at])
        picks.append((head, at))
        at = int(steps.pop()[head]) if steps else 0
    picks.reverse()
    return pd.DataFrame({"_block": pieces["_block"].to_numpy(), "_source": pieces["_source"].to_numpy(), "_head": [p[0] for p in picks], "_tail": [p[1] for p in picks]})


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each ambiguous record with its chosen reading; a run waits for its right neighbour."""
    source, left, run, keys, edge, fresh = None, None, [], [], None, True

    def flush(right: tuple | None, last: bool) -> pd.DataFrame | None:
        nonlocal run, keys
        if not run:
            return None
        rows = [list(enumerate(r)) for r in run]
        if edge is not None and fresh:
            rows[0] = [rows[0][edge[0]]]
        if edge is not None and last:
            rows[-1] = [rows[-1][edge[1]]] if len(rows) > 1 or not fresh else [(edge[1], run[-1][edge[1]])]
        picks = _solve(left, [[c for _, c in r] for r in rows], right)
        chosen = [r[p][1] for r, p in zip(rows, picks)]
        out = pd.DataFrame({"_key": keys, "us": [c[0] for c in chosen], "form": [c[2] for c in chosen]})
        run, keys = [], []
        return out

    for batch in batches:
        settled = batch["_cands"].isna().to_numpy()
        many = np.flatnonzero(~settled)
        sources = batch["_source"].to_numpy()
        changes = np.flatnonzero(sources[1:] != sources[:-1]) + 1
        # only the neighbourhood of ambiguous records and of changes of source is walked
        look = sorted({0, len(batch) - 1} | {x for i in many for x in (i - 1, i, i + 1) if 0 <= x < len(batch)} | {x for i in changes for x in (i - 1, i)})
        for i in look:
            row = batch.iloc[i]
            if row["_source"] != source:
                out = flush(None, True)
                if out is not None:
                    yield out
                source, left, fresh = row["_source"], None, True
                edge = None if pd.isna(row["_head"]) else (int(row["_head"]), int(row["_tail"]))
            now = _cands(row["_us"], row["_form"], row["_cands"])
            if len(now) == 1:
                out = flush(now[0], False)
                if out is not None:
                    yield out
                left, fresh = now[0], False
            else:
                run.append(now)
                keys.append(row["_key"])
    out = flush(None, True)
    if out is not None:
        yield out


def resolve(records: DataFrame, source: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Choose one reading per record of ``records``, which has an array column ``readings`` (see ``with_readings``).

    Gives the records that have any reading, with ``readings`` replaced by ``us``, ``form`` and ``zoned``.
    """
    names = [c for c in records.columns if c != "readings"]
    sourced = records.withColumn("_source", F.to_json(F.struct(*source)))
    # filtered behind the checkpoint: pushed below it, the predicate would repeat the whole parsing
    usable = ordered_blocks(sourced, ["_source", *order], blocks).where(F.size("readings") > 0)
    placed = usable.withColumn("_key", F.shiftleft(F.col("_block").cast("bigint"), 33) + F.col("_pos"))
    slim = placed.select(
        "_block", "_key", "_source",
        F.element_at("readings", 1)["us"].alias("_us"), F.element_at("readings", 1)["form"].alias("_form"),
        F.when(F.size("readings") > 1, F.transform("readings", lambda r: F.struct(r["us"].alias("us"), r["cost"].alias("cost"), r["form"].alias("form")))).alias("_cands"),
    )
    pieces = slim.mapInPandas(_pieces, PIECE)
    edges = pieces.groupBy("_source").applyInPandas(_join_pieces, "_block int, _source string, _head int, _tail int")
    edges = edges.select(F.col("_block").alias("_eb"), F.col("_source").alias("_es"), "_head", "_tail")
    # at most two rows per block: a bound that doesn't depend on the data
    known = slim.join(F.broadcast(edges), (F.col("_block") == F.col("_eb")) & (F.col("_source") == F.col("_es")), "left").drop("_eb", "_es")
    ambiguous = known.mapInPandas(_choose, "_key bigint, us bigint, form string")
    only = placed.where(F.size("readings") == 1).select(*names, F.element_at("readings", 1).alias("_r"))
    many = placed.where(F.size("readings") > 1).join(ambiguous.withColumnsRenamed({"us": "_us", "form": "_form"}), "_key")
    pick = F.element_at(F.filter("readings", lambda r: (r["us"] == F.col("_us")) & (r["form"] == F.col("_form"))), 1)
    both = only.unionByName(many.select(*names, pick.alias("_r")))
    return both.select(*names, "_r.us", "_r.form", "_r.zoned")


def normalise(posts: DataFrame, zones: DataFrame, blocks: int | None = None) -> DataFrame:
    """One instant per post: (platform, id, utc_us, form).

    ``posts`` has platform, id, value (string), account and province; ``zones`` has province and zone and is a
    fixed short table. A blank or unknown province means UTC. Of a post's several readings one that has a single form
    goes before one that the walk chose among forms, then one that names its zone before one that doesn't, then the
    earliest. Posts without any usable time, null or blank values and null ids are left out; repeated rows collapse; an
    empty table gives no rows.
    """
    local = zones.select(F.col("province").alias("_province"), F.col("zone").alias("_zone")).where(F.col("_zone").isin(sorted(available_timezones()))).dropDuplicates(["_province"])
    named = posts.select("platform", "id", "value", "account", "province").where(F.col("id").isNotNull() & ~is_blank("value")).dropDuplicates()
    placed = named.join(F.broadcast(local), F.trim("province") == F.col("_province"), "left")  # a fixed table of provinces
    local_zone = placed.select("platform", "id", "account", "value", F.coalesce("_zone", F.lit("UTC")).alias("zone"))
    records = with_readings(local_zone, "value", "zone").drop("value", "zone")
    records = records.withColumn("open", F.size(F.array_distinct(F.transform("readings", lambda r: r["form"]))) > 1)
    read = resolve(records, ["platform", "account"], ["id"], blocks)
    best = F.min(F.struct("open", (~F.col("zoned")).alias("bare"), "us", "form"))
    return read.groupBy("platform", "id").agg(best.alias("_b")).select("platform", "id", F.col("_b.us").alias("utc_us"), F.col("_b.form").alias("form"))


def post_times(bluesky: DataFrame, instagram: DataFrame, tiktok: DataFrame, zones: DataFrame, blocks: int | None = None) -> DataFrame:
    """``normalise`` over the three platforms' own fields."""

    def take(df: DataFrame, platform: str, key: str, value: str) -> DataFrame:
        return df.select(F.lit(platform).alias("platform"), F.col(key).alias("id"), F.col(value).cast("string").alias("value"), F.col("seed.Handle").alias("account"), F.col("seed.Province").alias("province"))

    posts = take(bluesky, "bluesky", "id", "date").unionByName(take(instagram, "instagram", "id", "taken_at")).unionByName(take(tiktok, "tiktok", "video_id", "createtime"))
    return normalise(posts, zones, blocks)
