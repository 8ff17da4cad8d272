"""File sources and sinks: fault-tolerant scans, partitions from names, atomic and incremental publishing."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """One scan of several paths; columns a file lacks are null, and only the wanted ones are read."""
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    df = reader.parquet(*paths)
    if columns is None:
        return df
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in columns])


def scan_tolerant(spark: SparkSession, paths: Sequence[str], schema: StructType | None = None) -> DataFrame | None:
    """Like ``scan``, but files that can't be read are skipped, with a warning if none is left.

    With a schema, Spark skips corrupt files while reading; without one each path is opened on its own.
    """
    if schema is not None:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(*paths)
    good = None
    for path in paths:
        try:
            df = spark.read.parquet(path)
        except AnalysisException:
            continue
        except Exception as e:  # a broken footer surfaces as a job failure
            warnings.warn(f"{path} is left out: {str(e)[:100]}", stacklevel=2)
            continue
        good = df if good is None else good.unionByName(df, allowMissingColumns=True)
    if good is None:
        warnings.warn("no file could be read", stacklevel=2)
    return good


def name_parts(pattern: str, names: Sequence[str]) -> list[Column]:
    """Columns from the file name by a regular expression, one per group."""
    base = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return [F.regexp_extract(base, pattern, i + 1).alias(n) for i, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; typed by ``schema`` or by looking at the whole file."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, whole: bool = False) -> DataFrame:
    """Records, one per line, or one document per file with ``whole``."""
    reader = spark.read.option("multiLine", str(whole).lower())
    return (reader.schema(schema) if schema else reader).json(path)


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = (), per_file: int | None = None) -> None:
    """Zstandard parquet; with partitions only those that ``df`` holds are replaced, each in one commit."""
    writer = (df.repartition(*partition_by) if partition_by else df).write.mode("overwrite").option("compression", "zstd")
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def write_by_extension(df: DataFrame, path: str) -> None:
    """CSV with a header or parquet, as the name says."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", "true").csv(path)
    else:
        publish(df, path)


def config_key(config: Mapping, used: Sequence[str] | None = None) -> str:
    """A short digest of the settings that matter; order and numeric type don't."""

    def plain(v):
        if isinstance(v, Mapping):
            return {str(k): plain(v[k]) for k in sorted(v, key=str)}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    kept = {k: config[k] for k in (used if used is not None else config) if k in config}
    return hashlib.blake2b(json.dumps(plain(kept), sort_keys=True).encode(), digest_size=8).hexdigest()


def part_digests(rows: DataFrame, part: Sequence[str]) -> DataFrame:
    """(part, digest, rows): a digest of each part's content that depends neither on order nor on file times."""
    return rows.groupBy(*part).agg(F.sum(F.xxhash64(F.to_json(F.struct(*rows.columns))).cast("decimal(20,0)")).cast("string").alias("digest"), F.count("*").alias("rows"))


def stale_parts(now: DataFrame, recorded: DataFrame, part: Sequence[str]) -> DataFrame:
    """Parts whose content isn't what the last build recorded; new ones too."""
    return now.join(recorded.select(*part, "digest"), [*part, "digest"], "left_anti").select(*part)


def missing_parts(wanted: DataFrame, done: DataFrame, part: Sequence[str]) -> DataFrame:
    """Parts that have no output yet."""
    return wanted.select(*part).distinct().join(done.select(*part).distinct(), list(part), "left_anti")


def rebuild(spark: SparkSession, source: DataFrame, part: Sequence[str], build: Callable[[DataFrame], DataFrame], out: str, manifest: str) -> int:
    """Rebuild the parts whose source content changed; gives their number. ``build`` keeps the part columns.

    The manifest is written last, so an interrupted build is repeated, never taken for done.
    """
    digests = part_digests(source, part)
    try:
        recorded = spark.read.parquet(manifest)
        todo = stale_parts(digests, recorded, part)
    except AnalysisException:
        todo = digests.select(*part)
    n = todo.count()
    if n:
        publish(build(source.join(todo, list(part), "left_semi")), out, part)  # parts may be many: Spark broadcasts them if they are small
        digests.write.mode("overwrite").parquet(manifest)
    return n


def head(spark: SparkSession, path: str, k: int) -> DataFrame:
    """The first ``k`` rows of a parquet table in stored order: a look at it, not a sample. Reads no more than it must."""
    return spark.read.parquet(path).limit(k)


def merged_fields(hits: DataFrame, source: str = "_source", fields: str = "fields") -> DataFrame:
    """Search hits as one row of text columns: a field's first doc value where it has any, else the source's own.

    ``source`` and ``fields`` are structs; doc values are lists of text, so long numbers come through exactly.
    """
    own, exact = hits.schema[source].dataType.fieldNames(), hits.schema[fields].dataType.fieldNames()
    at = lambda n: F.try_element_at(F.col(f"{fields}.{n}"), F.lit(1)).cast("string")
    plain = lambda n: F.col(f"{source}.{n}").cast("string")
    both = [(F.coalesce(at(n), plain(n)) if n in exact else plain(n)).alias(n) for n in own]
    return hits.select(*both, *[at(n).alias(n) for n in exact if n not in own])


def file_list(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size) of the files of a folder; their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def week_of_name(name: Column) -> Column:
    """(year, week) that a file's name holds as ``<year>_<week>`` or ``<year>-<week>``; null if it has none."""
    at = lambda i: F.regexp_extract(name, r"(\d{4})[_-](\d{1,2})(?!\d)", i)
    return F.when(at(1) != "", F.struct(at(1).cast("int").alias("year"), at(2).cast("int").alias("week")))


def paired_weeks(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, dropped) of two file lists: one file of each per week (the first by name), and the weeks of ``left``
    that ``right`` has no file for. Files without a week in their name belong to neither."""
    per = lambda f, n: f.withColumn("_w", week_of_name(F.col("name"))).where("_w is not null").groupBy("_w.year", "_w.week").agg(F.min_by("path", "name").alias(n))
    a, b = per(left, "left_path"), per(right, "right_path")
    return a.join(b, ["year", "week"]), a.join(b, ["year", "week"], "left_anti").select("year", "week")


def padded_date(name: Column) -> Column:
    """A file's name with month and day of its date in two digits."""
    wide = F.regexp_replace(name, r"(?<!\d)(\d{4})-(\d)-(?=\d)", "$1-0$2-")
    return F.regexp_replace(wide, r"(?<!\d)(\d{4}-\d{2})-(\d)(?!\d)", "$1-0$2")


def filtered_copy(spark: SparkSession, folder: str, word: str, keep: Column, out: str) -> DataFrame:
    """Files of a folder whose name holds ``word``, filtered and written again under their own name, (name, rows).

    One job for all files; a file of which no row is left isn't written.
    """
    names = [r["path"] for r in file_list(spark, folder).where(F.contains("name", F.lit(word))).select("path").toLocalIterator()]
    if not names:
        return spark.createDataFrame([], "name string, rows bigint")
    base = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.parquet$", "")
    rows = scan(spark, *names).withColumn("name", base).where(keep)
    publish(rows, out, ["name"])
    return spark.read.parquet(out).groupBy("name").agg(F.count("*").alias("rows"))


def compact_months(spark: SparkSession, folder: str, day: str, out: str, rows_per_file: int = 5_000_000) -> None:
    """Daily parts as one partition per month of ``day`` (a date column, or one from the path): large files instead of many.

    A month is spread over tasks by the day, so no single task writes it.
    """
    daily = spark.read.parquet(folder).withColumn("month", F.date_format(day, "yyyy-MM"))
    daily.repartition("month", day).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy("month").parquet(out)


def to_json_document(rows: DataFrame, most: int = 100_000) -> str:
    """A small table as one JSON text, rows in the order of their own JSON; more than ``most`` rows are an error."""
    lines = [r[0] for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} rows: write them with write_json")
    return "[" + ",".join(sorted(lines)) + "]"


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_gzip(df: DataFrame, path: str) -> None:
    """Parquet with gzip pages, for readers that know no other codec."""
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)


def from_array(spark: SparkSession, values, name: str = "v") -> DataFrame:
    """A numpy matrix as (row, name): one array per row, in row order."""
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(values)], f"row bigint, {name} array<double>")


def to_array(rows: DataFrame, order: str, name: str, most: int = 1_000_000):
    """A small table's column of equal-length arrays as a numpy matrix; more than ``most`` rows are an error."""
    import numpy as np

    found = rows.select(order, name).limit(most + 1).toPandas().sort_values(order)
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    return np.array(found[name].tolist(), float)


def latex_table(rows: DataFrame, columns: Sequence[str], most: int = 1000) -> str:
    """A small sorted table as LaTeX rows with escaped text; more than ``most`` rows are an error."""
    found = rows.select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    escape = lambda v: "" if v is None else "".join("\\" + c if c in "&%$#_{}" else c for c in str(v))
    lines = [" & ".join(escape(v) for v in r) + r" \\" for r in sorted(found, key=lambda r: tuple(str(v) for v in r))]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(escape(c) for c in columns) + r" \\ \hline", *lines, r"\end{tabular}"])


def page_groups(rows: DataFrame, by: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, entries): what a page of examples shows per group, as JSON in order. For samples: a group is one row."""
    entry = F.struct(*order, *[c for c in columns if c not in order])
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return listed.select(by, F.to_json(F.transform("_e", lambda e: F.struct(*[e[c].alias(c) for c in columns]))).alias("entries"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded runs, one JSON document per file, as (run, key, value): parameters and metrics, text as it stands."""
    read = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder)
    named = read.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json(?:/[^/]*)?$", 1).alias("run"), F.from_json("value", "map<string,string>").alias("_m"))
    return named.select("run", F.explode("_m").alias("key", "value"))
