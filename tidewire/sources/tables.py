"""Sources: Parquet tables, tolerant JSON lines, feeds, Markdown documents, HTML meta data and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.text import slug, unescape


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A Parquet table; times without a zone are read in the zone of the session."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    times = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(times) if times else df


def table_or_empty(spark: SparkSession, base: str, name: str, schema: T.StructType | str) -> DataFrame:
    """As ``table``, but an empty one where the path doesn't exist; columns that the file lacks are null."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}.parquet")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], kind)
    df = table(spark, base, name)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind])


def json_lines(spark: SparkSession, path: str, schema: str, latest: int | None = None, order: str | None = None) -> DataFrame:
    """Records of a log; lines that don't parse are left out, and of the rest the ``latest`` by ``order`` are kept if asked for."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.orderBy(F.desc(order)).limit(latest).orderBy(order) if latest else df


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS or Atom feeds that were put down as JSON lines, one a URL (the first published; ties by feed, title and text); items without a title are left out."""
    raw = json_lines(spark, path, "feed string, title string, link string, summary string, published string")
    rows = raw.filter(F.trim(F.coalesce("title", F.lit(""))) != "")
    url = F.nullif(F.trim("link"), F.lit(""))
    named = rows.select("feed", F.trim("title").alias("headline"), F.coalesce("summary", F.lit("")).alias("body"), url.alias("source_url"), F.try_to_timestamp(F.col("published")).alias("published_at"))
    key = F.struct(F.col("published_at").isNull(), "published_at", "feed", "headline", "body")
    one = named.filter("source_url IS NOT NULL").groupBy("source_url").agg(F.min_by(F.struct(*named.columns), key).alias("item"))
    return one.select("item.*").unionByName(named.filter("source_url IS NULL"))


class SourceChangedError(ValueError):
    """A source has other columns than it had, or too few rows."""


def guarded(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """The table, if it has exactly these columns and ``least`` rows or more."""
    if df.columns != columns:
        raise SourceChangedError(f"columns are {df.columns}, not {columns}")
    found = df.limit(least).count()
    if found < least:
        raise SourceChangedError(f"{found} rows; {least} are needed")
    return df


def snapshot(df: DataFrame, key: str, value: str, written: str, as_of: str, max_age_hours: float | None) -> DataFrame:
    """Entries of a cache that are still good: of each key the newest, and none older than ``max_age_hours`` (None: forever)."""
    at = F.lit(as_of).cast("timestamp")
    fresh = df if max_age_hours is None else df.filter(F.col(written) >= at - F.make_dt_interval(mins=F.lit(int(max_age_hours * 60))))
    return fresh.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, written).alias(value))


# ------------------------------------------------------------------ Markdown documents


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every file, a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def markdown_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each ``##`` section: its heading as a slug, its bullets, and the rest as a paragraph; the text before the
    first one is the section "" and gives the title (the ``#`` line)."""
    keep = [c for c in docs.columns if c != text]
    cut = F.split(F.concat(F.lit("\n"), F.regexp_replace(text, "\r\n?", "\n")), r"\n## ")
    rows = docs.select(*keep, F.regexp_extract(F.concat(F.lit("\n"), F.col(text)), r"\n# ([^\n]+)", 1).alias("title"), F.posexplode(cut).alias("pos", "part"))
    head = F.when(F.col("pos") == 0, F.lit("")).otherwise(slug(F.substring_index("part", "\n", 1)))
    lines = F.slice(F.split("part", "\n"), 2, 1 << 30)
    bullets = F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*[-*] ")), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*] ", "")))
    prose = F.trim(F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^\s*[-*] ") & ~x.rlike("^# ")), " "))
    return rows.select(*keep, "title", F.col("pos").alias("section_pos"), head.alias("section"), F.filter(bullets, lambda x: x != "").alias("bullets"), prose.alias("prose"))


def belief_chunks(docs: DataFrame, key: str, statement: str, invalidations: str) -> DataFrame:
    """One ``statement`` row and a row ``invalidation_i`` (from 1) for each condition; blank ones are left out."""
    numbered = F.transform(F.coalesce(F.col(invalidations), F.array().cast("array<string>")), lambda x, i: F.struct(F.concat(F.lit("invalidation_"), (i + 1).cast("string")).alias("chunk_key"), x.alias("text")))
    first = F.array(F.struct(F.lit("statement").alias("chunk_key"), F.col(statement).alias("text")))
    return docs.select(key, F.inline(F.filter(F.concat(first, numbered), lambda x: F.trim(x["text"]) != "")))


# ------------------------------------------------------------------ HTML


def meta_description(html: str = "html"):
    """The description of a page (description, og: or twitter:) from either order of attributes, entities resolved; null without one. The
    whole page is read, as descriptions may stand behind much else."""
    page = F.coalesce(F.col(html), F.lit(""))
    named, content = r"""(?:name|property)\s*=\s*["'](?:og:description|twitter:description|description)["']""", r"""content\s*=\s*["']([^"']*)["']"""
    first, second = rf"(?iu)<meta\s+{named}\s+{content}", rf"(?iu)<meta\s+{content}\s+{named}"
    found = F.when(page.rlike(first), F.regexp_extract(page, first, 1)).otherwise(F.regexp_extract(page, second, 1))
    return F.nullif(F.trim(unescape(found)), F.lit(""))


def seed(spark: SparkSession, rows: list[tuple], schema: str, keys: list[str]) -> DataFrame:
    """Rows of a static seed, the last of each key."""
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, __at int")
    best = numbered.groupBy(*keys).agg(F.max("__at").alias("__at"))
    return numbered.join(best, [*keys, "__at"], "left_semi").drop("__at")


def uncovered(used: DataFrame, symbol: str, registry: DataFrame, known: str) -> DataFrame:
    """Symbols in use that the registry lacks, with how often they are used."""
    missing = used.filter(F.col(symbol).isNotNull()).join(registry.select(F.col(known).alias(symbol)).distinct(), symbol, "left_anti")
    return missing.groupBy(symbol).agg(F.count("*").alias("uses"))
