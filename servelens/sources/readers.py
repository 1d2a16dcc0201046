"""Readers: text, JSON and log stores -> the engine's schemas."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import requests as R
from ..operators.drift import KINDS

SAMPLE_PATTERN = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)'
LABEL_PATTERN = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'
LINES_SCHEMA = "value STRING"


# Input bytes per core below which a scan is spread before CPU-heavy work.
SMALL_PER_CORE = 32 * 1024 * 1024


def fill_cores(df: DataFrame, key: str) -> DataFrame:
    """Spread a small input over all cores by a well-distributed key.

    A file with few row groups feeds few tasks, however costly each row is.
    When the estimated size is small enough for a shuffle to be cheap, the rows
    are hashed over the cores; a large input keeps the splits of its scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size < cores * SMALL_PER_CORE else df


def parse_exposition(lines: DataFrame, ts: Column, column: str = "value") -> DataFrame:
    """Exposition text lines -> samples; ``#`` lines and blanks are skipped."""
    text = F.col(column)
    d = lines.where(~text.startswith("#") & (F.trim(text) != "")).withColumn("_name", F.regexp_extract(text, SAMPLE_PATTERN, 1))
    body = F.regexp_extract(text, SAMPLE_PATTERN, 2)
    raw = F.lower(F.regexp_extract(text, SAMPLE_PATTERN, 3))
    inf = float("inf")
    value = F.when(raw.isin("+inf", "inf"), inf).when(raw == "-inf", -inf).when(raw == "nan", float("nan")).otherwise(raw.try_cast("double"))
    keys = F.regexp_extract_all(body, F.lit(LABEL_PATTERN), F.lit(1))
    vals = F.transform(F.regexp_extract_all(body, F.lit(LABEL_PATTERN), F.lit(2)), _unescape)
    return (d.where(F.col("_name") != "").select(F.col("_name").alias("metric"), F.map_from_arrays(keys, vals).alias("labels"),
                                                 ts.alias("ts"), value.alias("value")).where(F.col("value").isNotNull()))


def _unescape(v: Column) -> Column:
    hold = F.replace(v, F.lit("\\\\"), F.lit("\x00"))
    plain = F.replace(F.replace(hold, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.replace(plain, F.lit("\x00"), F.lit("\\"))


def read_exposition(spark: SparkSession, path: str) -> DataFrame:
    """Scraped metric pages, one file per scrape; the file time is the sample time."""
    d = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("_t"))
    return parse_exposition(d, F.col("_t"))


def read_log_lines(spark: SparkSession, path: str, tail: int | None = None, ts: Column | None = None) -> DataFrame:
    """Log files as ``(source, seq, byte_offset, ts, line)`` without blanks and carriage returns.

    ``byte_offset`` is where a line starts in its file, and ``seq`` the same number: lines are in order by it.
    It comes from the bytes of the lines before it: a split of a file sums its own, and the splits' sums, one row
    each, add up along the file; a file of any size is read by as many tasks as it has splits, twice.
    ``ts`` is an expression over ``line``, the file's time by default.  ``tail`` keeps the last N lines per file.
    Lines end with a line feed; bytes that aren't UTF-8 count as they are.
    """
    # A split is read by one task, in order; a task may read several.
    d = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_modification_time").alias("_time"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    size = F.octet_length("line").cast("bigint") + 1
    along = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("source", "_block").agg(F.sum(size).alias("_n")).select("source", "_block", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_from"))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("source", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_in", before).join(starts, ["source", "_block"]).withColumn("byte_offset", F.col("_from") + F.col("_in"))
    d = d.withColumn("line", F.regexp_replace("line", r"\r+$", "")).where("line <> ''")
    d = d.select("source", F.col("byte_offset").alias("seq"), "byte_offset", (F.col("_time") if ts is None else ts).alias("ts"), "line")
    return d if tail is None else last_lines(d, tail)


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    """Last ``n`` lines per source.

    Each slice of a source first keeps its own last ``n`` (map-side bounded),
    so the final ranking of a source sees at most ``n`` lines per slice.
    """
    salted = lines.withColumn("_s", F.pmod(F.xxhash64("seq"), F.lit(64)))
    w = Window.partitionBy("source", "_s").orderBy(F.desc("seq"))
    few = salted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    w = Window.partitionBy("source").orderBy(F.desc("seq"))
    return few.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r", "_s")


def follow_log_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of new log lines ``(source, ts, line)`` from a folder."""
    reader = spark.readStream.schema(LINES_SCHEMA).format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_modification_time").alias("ts"),
        F.regexp_replace("value", r"\r+$", "").alias("line")).where("line <> ''")


REQUEST_COLUMNS = ("request_id STRING, method STRING, path STRING, headers MAP<STRING, STRING>, body STRING, status INT, "
                   "content_type STRING, response STRING, t_arrival DOUBLE, t_send DOUBLE, t_first DOUBLE, t_done DOUBLE")


def read_requests(spark: SparkSession, path: str, default_model: str = "default", default_temperature: float = 0.0,
                  top: int = 0, sample: float = 0.0) -> DataFrame:
    """Recorded calls (JSON lines) as typed request/response rows."""
    d = spark.read.schema(REQUEST_COLUMNS).json(path)
    return R.parse_responses(R.parse_requests(d, default_model, default_temperature, top, sample))


BENCH_SCHEMA = ("label STRING, model STRING, base STRING, recorded_at STRING, runs ARRAY<STRUCT<label STRING, requests BIGINT, errors BIGINT, "
                "error_rate DOUBLE, ttft_p50 DOUBLE, ttft_p95 DOUBLE, ttft_p99 DOUBLE, total_p50 DOUBLE, total_p95 DOUBLE, tps_p50 DOUBLE, "
                "tps_p95 DOUBLE, throughput_tok_s DOUBLE, wall_s DOUBLE>>, snapshots ARRAY<STRUCT<proxy_up DOUBLE, gpu_mem DOUBLE, "
                "kv_util DOUBLE, server_state DOUBLE>>, scenario STRING, agents INT, wall_s DOUBLE, results ARRAY<STRUCT<ok BOOLEAN, "
                "error STRING, scenario STRING, turns INT, tool_calls INT, valid_tool_calls INT, done BOOLEAN, wall DOUBLE, ttft_mean DOUBLE, "
                "ttft_max DOUBLE, turn_wall_mean DOUBLE>>")


def read_bench_reports(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Report files -> ``runs``, ``snapshots`` and agent ``results``, one row each."""
    d = spark.read.schema(BENCH_SCHEMA).option("multiLine", True).json(path)
    head = [F.col("label").alias("report"), "model", "recorded_at"]
    return {
        "runs": d.select(*head, F.explode("runs").alias("r")).select("report", "model", "recorded_at", "r.*"),
        "snapshots": d.select(*head, F.posexplode("snapshots").alias("pos", "s")).select("report", "model", "recorded_at", "pos", "s.*"),
        "results": d.select(*head, F.explode("results").alias("r")).select("report", "model", "recorded_at", "r.*")}


def read_resources(spark: SparkSession, path: str, source: str, per_line: bool = False) -> DataFrame:
    """Cluster dumps -> ``(source, kind, ns, name, doc)``.

    Takes list dumps (``items``) and saved snapshots (``state``: kind -> ``ns/name`` -> document; also without
    the ``state`` around it), mixed as they come, in one scan.  A dump is a file, or with ``per_line`` a line, so that
    many dumps of a file are read by as many tasks as it has splits.  Items without a name are dropped.
    """
    whole = spark.read.text(path, wholetext=not per_line)
    meta = "get_json_object(doc, '$.metadata')"
    items = F.transform(F.from_json(F.get_json_object("value", "$.items"), "ARRAY<STRING>"), lambda d: F.struct(
        F.get_json_object(d, "$.kind").alias("kind"), F.lit(None).cast("string").alias("key"), d.alias("doc")))
    state = F.coalesce(F.get_json_object("value", "$.state"), F.col("value"))

    def saved(kind: str) -> Column:
        entries = F.map_entries(F.from_json(F.get_json_object(state, f"$.{kind}"), "MAP<STRING, STRING>"))
        return F.transform(entries, lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"), e["value"].alias("doc")))

    none = F.array().cast("array<struct<kind:string,key:string,doc:string>>")
    found = F.concat(*[F.coalesce(c, none) for c in (items, *map(saved, KINDS.values()))])
    d = whole.select(F.explode(found).alias("r")).select("r.*")
    ns = F.when(F.col("key").isNull(), F.coalesce(F.get_json_object(F.expr(meta), "$.namespace"), F.lit(""))).otherwise(F.substring_index("key", "/", 1))
    name = F.when(F.col("key").isNull(), F.get_json_object(F.expr(meta), "$.name")).otherwise(F.expr("substring(key, instr(key, '/') + 1)"))
    return d.select(F.lit(source).alias("source"), "kind", ns.alias("ns"), name.alias("name"), "doc").where("name is not null and name <> ''")


OTLP_SCHEMA = ("resourceLogs ARRAY<STRUCT<scopeLogs ARRAY<STRUCT<logRecords ARRAY<STRUCT<timeUnixNano STRING, severityText STRING, "
               "severityNumber INT, body STRUCT<stringValue STRING>, attributes ARRAY<STRUCT<key STRING, value STRUCT<stringValue STRING>>>>>>>>>")


def parse_otlp(d: DataFrame, attribute_prefix: str = "mlx.log.") -> DataFrame:
    """Nested log export -> ``(ts, severity, category, source, project, body)``."""
    r = (d.select(F.explode("resourceLogs").alias("a")).select(F.explode("a.scopeLogs").alias("b")).select(F.explode("b.logRecords").alias("r")))
    attrs = F.map_from_entries(F.transform("r.attributes", lambda x: F.struct(x["key"], x["value"]["stringValue"])))
    return (r.withColumn("_at", attrs).select(
        F.timestamp_micros(F.expr("try_cast(r.timeUnixNano AS BIGINT) div 1000")).alias("ts"), F.col("r.severityText").alias("severity"),
        *[F.col("_at")[attribute_prefix + n].alias(n) for n in ("category", "source", "project")], F.col("r.body.stringValue").alias("body")))


def read_otlp_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The durable JSON-lines log store, in batch or as a stream."""
    reader = spark.readStream if stream else spark.read
    return parse_otlp(reader.schema(OTLP_SCHEMA).json(path))
