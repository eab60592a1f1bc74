"""Recorded files as tables. What is absent or cannot be read gives no rows, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"
# The lines of a run's log that tell its progress, and how the end of a company begins.
TOTAL_LINE = r"\bpipeline: Executing (\d+) companies\b"
COMPANY_LINE = r"\bats\.router: (.+?) -> (\S.*?)\s*$"
DONE = r"^\d+ jobs? retrieved\b"
HINT = "entry_url string, json_endpoint string, verified_at string, jobs_last_seen long, consecutive_failures int, proven boolean, unsupported boolean, checked_at string"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def json_rows(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """Rows of JSON lines or (lines=False) of files that hold one array each; broken lines, or a broken
    file, count as nothing."""
    if not exists(spark, path):
        return _none(spark, schema)
    told = {"columnNameOfCorruptRecord": BROKEN}
    if lines:
        rows = spark.read.text(path).select(F.from_json("value", f"{schema}, {BROKEN} string", told).alias("d"))
    else:
        whole = spark.read.text(path, wholetext=True).where("try_parse_json(value) is not null and trim(value) like '[%'")
        rows = whole.select(F.explode(F.from_json("value", f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in _fields(schema))}, {BROKEN}: string>>", told)).alias("d"))
    return rows.where(f"d is not null and d.{BROKEN} is null").select("d.*").drop(BROKEN)


def _fields(schema: str) -> list[T.StructField]:
    return T.StructType.fromDDL(schema).fields


def text_table(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A CSV with a header, every cell a string as it stands ("NA" and "" are texts). columns: the ones
    wanted; those that the file lacks are empty. Without them, the file's own."""
    read = None
    if exists(spark, path):
        read = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("inferSchema", "false").csv(path)
        read = read.na.fill("")
    wanted = columns or (tuple(read.columns) if read is not None else ())
    if read is None:
        return _none(spark, ", ".join(f"`{c}` string" for c in wanted)) if wanted else spark.createDataFrame([], T.StructType([]))
    return read.select(*[(F.col(f"`{c}`") if c in read.columns else F.lit("")).alias(c) for c in wanted])


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON object each, as a row each; other content gives none."""
    if not exists(spark, path):
        return _none(spark, schema)
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"{schema}, {BROKEN} string", {"columnNameOfCorruptRecord": BROKEN})
    rows = whole.where(F.trim("value").startswith("{")).select(parsed.alias("d"))
    return rows.where(f"d is not null and d.{BROKEN} is null").select("d.*").drop(BROKEN)


def report_companies(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The companies of a report that sinks.exports.write_document() wrote, read a line at a time."""
    if not exists(spark, path):
        return _none(spark, schema)
    lines = spark.read.text(path).where(F.col("value").startswith('{"company":'))
    return lines.select(F.from_json(F.regexp_replace("value", ",$", ""), schema).alias("r")).select("r.*")


def report_head(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What stands before the companies of such a report, and listed, how many of them there are, counted a
    line at a time; a report without its end gives none."""
    if not exists(spark, path):
        return _none(spark, f"{schema}, listed long")
    lines = spark.read.text(path)
    company = F.col("value").startswith('{"company":')
    whole = lines.agg(F.max(F.when(F.endswith("value", F.lit('"companies":[')) & ~company, F.col("value"))).alias("head"), F.count_if(company).alias("listed"), F.max(F.col("value") == "]}").alias("ends"))
    return whole.where("ends and head is not null").select(F.from_json(F.concat("head", F.lit("]}")), schema).alias("r"), "listed").select("r.*", "listed")


def hints(spark: SparkSession, path: str) -> DataFrame:
    """A hint file (one object, a company a key) as rows; values that are no objects are left out."""
    if not exists(spark, path):
        return _none(spark, f"company string, {HINT}")
    whole = spark.read.text(path, wholetext=True).where("try_parse_json(value) is not null")
    pairs = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("company", "value")).where("value like '{%'")
    return pairs.select("company", F.from_json("value", HINT).alias("h")).select("company", "h.*")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (rising, with gaps), line: lines keep their order within a file however it was split."""
    if not exists(spark, path):
        return _none(spark, "file string, line_no long, line string")
    at = F.col("_metadata.file_block_start") * (1 << 20) + F.monotonically_increasing_id() % (1 << 33)
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("line_no"), F.col("value").alias("line"))


def tail(lines: DataFrame, n: int, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """The last n lines of each log. Spark keeps n lines of a log in a task before anything moves."""
    last = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("line_no")))
    return lines.withColumn("_last", last).where(F.col("_last") <= n).drop("_last")


def progress(lines: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """How far each run is, from its log: total is the last announced one, started and finished count
    companies named after it, current is the last company named and provider where it was routed."""
    total = F.regexp_extract("line", TOTAL_LINE, 1).try_cast("long")
    company = F.trim(F.regexp_extract("line", COMPANY_LINE, 1))
    detail = F.trim(F.regexp_extract("line", COMPANY_LINE, 2))
    told = lines.select(*by, "line_no", total.alias("total"), F.nullif(company, F.lit("")).alias("company"), detail.alias("detail"))
    told = told.where("total is not null or company is not null")
    mark = told.groupBy(*by).agg(F.max(F.when(F.col("total").isNotNull(), F.col("line_no"))).alias("_mark"))
    named = told.join(mark, list(by)).withColumn("_after", F.col("company").isNotNull() & (F.col("line_no") > F.coalesce("_mark", F.lit(-1))))
    done = F.col("detail").rlike(DONE)
    first = W.partitionBy(*by, "company")
    routed = F.min_by(F.col("detail"), F.when(F.col("_after") & ~done, F.col("line_no"))).over(first)
    named = named.withColumn("_routed", routed).withColumn("_provider", F.when(done, F.coalesce("_routed", F.lit(""))).otherwise(F.col("detail")))
    at = F.when(F.col("company").isNotNull(), F.col("line_no"))
    return named.groupBy(*by).agg(
        F.max_by("total", F.when(F.col("total").isNotNull(), F.col("line_no"))).alias("total"),
        F.count_distinct(F.when(F.col("_after") & ~done, F.col("company"))).alias("started"),
        F.count_distinct(F.when(F.col("_after") & done, F.col("company"))).alias("finished"),
        F.max_by("company", at).alias("current"),
        F.max_by("_provider", at).alias("provider"),
    )


def workbook_cells(raw: DataFrame, company: str, ats_url: str, live_url: str) -> DataFrame:
    """name, ats_url, live_jobs_url of a workbook's rows that name a company, blanks as empty texts, for editing."""
    cell = lambda c: _cell(F.col(c)) if c in raw.columns else F.lit("")
    return raw.select(cell(company).alias("name"), cell(ats_url).alias("ats_url"), cell(live_url).alias("live_jobs_url")).where("name != ''")


def _cell(c: Column) -> Column:
    value = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(value) == "nan", "").otherwise(value)
