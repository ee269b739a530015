"""Readers: delimited and JSON files with explicit schemas, optional inputs, lookups with first or last match, file names as keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTIONS = "ID string, Topic string, Question string, Translation string"
PROMPTS = "id string, English string, Translation string"
ANNOTATION = (
    "struct<question:string, en_question:string, annotations:array<struct<answers:array<string>, en_answers:array<string>, count:int>>, "
    "idks:struct<idk:int, `no-answer`:int, `not-applicable`:int>>"
)
CARD = (
    "id string, region string, subregion string, locality string, category string, topic string, evidence_type string, text_original string, "
    "language_original string, text_en string, cultural_scope string, time_scope string, source struct<type:string, title:string, "
    "publisher:string, url:string, accessed_date:string>, source_quality string, keywords array<string>, written_for array<string>, kb_version string"
)
JOB = "job_id string, country string, language string, prompt_no string, qid string, topic string, prompt string"
ANSWER = "job_id string, model string, response string, seconds double, source string"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def questions(spark: SparkSession, path: str, country: str) -> DataFrame:
    """`Question` is the local text, `Translation` the English one."""
    rows = csv(spark, path, QUESTIONS).withColumnsRenamed({"Question": "q_local", "Translation": "q_en"})
    return rows.select("ID", "Topic", "q_local", "q_en").withColumn("country", F.lit(country))


def json_map(spark: SparkSession, path: str, value: str = "variant") -> DataFrame:
    """JSON files that are one object each, of any size, to rows (file, position, key, value); `value` is the values' type.

    A file is read in pieces that end at a closing brace, by as many tasks as it has splits. Whether a piece lies in a string, and how
    deep, follows from sums over the pieces before it: first within its split, then over one row per split. An entry ends where the
    depth is back at one, so what is parsed at a time is one object and the plain values that come before it, and an entry that begins in one split
    and ends in another is put together again. A file without objects in it is one piece.

    Equal keys of a file are all returned; `position` tells which is the last. Files have to be valid JSON: an entry that can't be read
    as `value` fails the query, rather than being lost. Empty files and empty objects have no rows."""
    split, before = Window.partitionBy("file", "block").orderBy("n"), (Window.unboundedPreceding, -1)
    raw = spark.read.option("lineSep", "}").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    # What a piece opens outside of strings, if it starts outside (`out`) or inside one (`inn`). An escape never reaches over its end.
    bare = F.regexp_replace("value", r"\\.", "")
    odd = ((F.length(bare) - F.length(F.replace(bare, F.lit('"')))) % 2).alias("odd")
    string = r'"[^"]*("|$)'
    # Its closing brace counts if the piece ends outside.
    out = _opened(F.regexp_replace(bare, string, "")) - (1 - odd)
    inn = _opened(F.regexp_replace(bare, rf'^[^"]*("|$)|{string}', "")) - odd
    pieces = rows.select("file", "block", "n", "value", odd, out.alias("out"), inn.alias("inn"))
    flip = F.coalesce(F.sum("odd").over(split.rowsBetween(*before)), F.lit(0)) % 2
    pieces = pieces.withColumn("flip", flip).withColumns({"d0": F.when(F.col("flip") == 0, F.col("out")).otherwise(F.col("inn")), "d1": F.when(F.col("flip") == 0, F.col("inn")).otherwise(F.col("out"))})
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(*before)
    sums = pieces.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    starts = sums.withColumn("state", F.coalesce(F.sum("odd").over(whole), F.lit(0)) % 2)
    depth = F.sum(F.when(F.col("state") == 0, F.col("d0")).otherwise(F.col("d1"))).over(whole)
    starts = starts.select("file", "block", "state", F.coalesce(depth, F.lit(0)).alias("base"))
    known = pieces.join(starts, ["file", "block"])
    step = F.when(F.col("state") == 0, F.col("d0")).otherwise(F.col("d1"))
    after = F.col("base") + F.sum(step).over(split.rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("after", after).withColumn("outside", (F.col("state") + F.col("flip") + F.col("odd")) % 2 == 0)
    known = known.withColumn("ends", (F.col("outside") & (F.col("after") == 1)).cast("long"))
    ends = known.groupBy("file", "block").agg(F.sum("ends").alias("ends"))
    earlier = ends.select("file", "block", F.coalesce(F.sum("ends").over(whole), F.lit(0)).alias("earlier"))
    mine = F.coalesce(F.sum("ends").over(split.rowsBetween(*before)), F.lit(0))
    # The brace that closes the file's object, or that its end lacks, is left out.
    piece = F.when(F.col("outside") & (F.col("after") < 1), F.col("value")).otherwise(F.concat("value", F.lit("}")))
    cut = known.select("file", "block", "n", mine.alias("mine"), piece.alias("piece")).join(earlier, ["file", "block"])
    gathered = cut.groupBy("file", (F.col("earlier") + F.col("mine")).alias("position")).agg(F.array_sort(F.collect_list(F.struct("block", "n", "piece"))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda x: x["piece"]), "")
    head = F.when(F.col("position") == 0, F.lit(r"^[\s\x{FEFF}]*\{")).otherwise(F.lit(r"^\s*,"))
    body = gathered.select("file", "position", F.regexp_replace(text, head, F.lit("")).alias("body")).where(F.length(F.regexp_replace("body", r"\s", "")) > 0)
    entries = F.from_json(F.concat(F.lit("{"), "body", F.lit("}")), f"map<string, {value}>", {"mode": "FAILFAST"})
    return body.select("file", "position", F.explode(entries).alias("key", "value"))


def _opened(x: Column) -> Column:
    """Braces and brackets that `x` opens, less those that it closes."""
    return F.length(F.translate(x, "}]", "")) - F.length(F.translate(x, "{[", ""))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """JSON maps, one a file and of any size, to rows (qid, annotation)."""
    return json_map(spark, path, ANNOTATION).select(F.col("key").alias("qid"), F.col("value").alias("annotation"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) is not None and bool(
        len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))
    )


def where(df: DataFrame, **wanted) -> DataFrame:
    """Optional filters by column: a value, a list of values, or None for all rows."""
    for c, v in wanted.items():
        if v is not None:
            df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def with_optional(first: DataFrame, second: DataFrame | None) -> DataFrame:
    """Union with an input that may not be there; columns that one side lacks are null."""
    return first if second is None else first.unionByName(second, allowMissingColumns=True)


def cards(spark: SparkSession, path: str, extra: str | None = None) -> DataFrame:
    more = jsonl(spark, extra, CARD) if extra and exists(spark, extra) else None
    return with_optional(jsonl(spark, path, CARD), more)


def first_match(df: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """The first row of each key, by position in the file."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).where("__n = 1").drop("__n")


def last_match(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key, as a map that is filled in file order keeps it."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def from_files(spark: SparkSession, pattern: str, schema: str, key: str, extension: str = "jsonl") -> DataFrame:
    """All files of a pattern; `key` is each file's name without its extension."""
    rows = spark.read.schema(schema).json(pattern)
    return rows.withColumn(key, F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{extension}$", 1))


def settings(countries: DataFrame, local: str = "local_language") -> DataFrame:
    """(country, language): the local language, and English where that is another."""
    return countries.select("country", F.explode(F.array_distinct(F.array(F.col(local), F.lit("English")))).alias("language"))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column, as missing values arrive from delimited files."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in floats})
