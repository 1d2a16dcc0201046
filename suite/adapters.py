"""Driver tables -> the engine's schemas, in Spark and as SQL text.

Every Spark adapter has a SQL common table expression with the same columns, so
the oracle reads the same derived rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servelens.naming import BOUNDS
from servelens.operators.histograms import le_text
from servelens.operators.samples import Grid
from servelens.operators.slices import dealt

T0 = 1704067200          # 2024-01-01T00:00:00Z
DAY = 86400
HOURLY = Grid(T0, T0 + 30 * DAY, 3600)
SIXHOURLY = Grid(T0, T0 + 30 * DAY, 21600)
GEN_BOUNDS = BOUNDS["generation_seconds"]
TTFT_BOUNDS = BOUNDS["ttft_seconds"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def instant_of(col: str) -> Column:
    """Wall-clock column read as UTC, whatever the session time zone is."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', "
                  f"cast({col} as timestamp_ntz)))")


def micros_to_ts(c: Column) -> Column:
    return F.timestamp_micros(c)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """One row per call: labels, status, tokens and times derived from ``events``."""
    e = table(spark, sf, "events").withColumn("ts", instant_of("ts"))
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    d = e.select("event_id", "ts", F.unix_micros("ts").alias("us"), "user_id", "event_type", "value", k.alias("k"))
    err = F.col("event_type") == "error"
    return d.withColumns({
        "model": F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")),
        "node": F.concat(F.lit("n"), (F.col("user_id") % 4).cast("string")),
        "kind": F.when(F.col("k") % 4 == 0, "reasoning").otherwise("chat"),
        "streaming": F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"),
        "status": F.when(err & (F.col("k") % 2 == 0), 503).when(err, 404).otherwise(200),
        "gen": F.col("value") / 10, "ttft": F.col("value") / 8,
        "cents": F.round(F.col("value") * 100).cast("bigint"),
        "day": F.floor(F.col("us") / (DAY * 1_000_000)).cast("bigint")})


EV = """ev AS (
  SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value,
         CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k,
         'm' || (user_id % 3)::VARCHAR AS model, 'n' || (user_id % 4)::VARCHAR AS node,
         CASE WHEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 4 = 0 THEN 'reasoning' ELSE 'chat' END AS kind,
         CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS streaming,
         CASE WHEN event_type = 'error' AND CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 2 = 0 THEN 503
              WHEN event_type = 'error' THEN 404 ELSE 200 END AS status,
         value / 10 AS gen, value / 8 AS ttft, CAST(round(value * 100) AS BIGINT) AS cents,
         epoch_us(ts) // 86400000000 AS day
  FROM events)"""


def counter(spark: SparkSession, sf: str) -> DataFrame:
    """Counter with daily resets per (event_type, user): running cents of the day."""
    w = Window.partitionBy("event_type", "user_id", "day").orderBy("us", "event_id")
    d = events(spark, sf)
    return d.select("event_type", F.col("user_id").cast("string").alias("user"), "model", "kind", "ts", "us", "event_id",
                    F.sum("cents").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("value"))


CTR = EV + """, ctr AS (
  SELECT event_type, user_id::VARCHAR AS "user", model, kind, us, event_id,
         CAST(sum(cents) OVER (PARTITION BY event_type, user_id, day ORDER BY us, event_id) AS DOUBLE) AS value
  FROM ev), inc AS (
  SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END AS inc
  FROM (SELECT *, lag(value) OVER (PARTITION BY event_type, "user" ORDER BY us, event_id) AS p FROM ctr))"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Gauge samples: metric = event type, labels {user, model, job}."""
    d = events(spark, sf)
    return d.select(F.col("event_type").alias("metric"), F.create_map(
        F.lit("user"), F.col("user_id").cast("string"), F.lit("model"), F.col("model"),
        F.lit("job"), F.concat(F.lit("j"), (F.col("k") % 2).cast("string")), F.lit("instance"), F.col("node")).alias("labels"),
        "ts", "value")


def grid_cte(g: Grid, name: str = "grid") -> str:
    return f"{name} AS (SELECT unnest(range({g.start}, {g.end} + 1, {g.step})) AS t)"


def call_counter(spark: SparkSession, sf: str, labels: list[str], amount: Column | None = None,
                 where: Column | None = None) -> DataFrame:
    """Calls (or an amount) as a counter per label set that restarts every day."""
    d = events(spark, sf)
    if where is not None:
        d = d.where(where)
    w = Window.partitionBy(*labels, "day").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    v = F.sum(F.lit(1) if amount is None else amount).over(w).cast("double")
    return d.select(*labels, "ts", v.alias("value"))


def call_increments(name: str, labels: list[str], amount: str = "1", where: str = "TRUE") -> str:
    """SQL twin of :func:`call_counter` followed by its increments (needs ``ev``)."""
    lab = ", ".join(labels) + ", " if labels else ""
    part = ", ".join([*labels, "day"])
    series = f"PARTITION BY {', '.join(labels)} " if labels else ""
    return f"""{name} AS (
  SELECT {lab}us, CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END AS inc FROM (
    SELECT *, lag(v) OVER ({series}ORDER BY us, event_id) AS p FROM (
      SELECT {lab}us, event_id, CAST(sum({amount}) OVER (PARTITION BY {part} ORDER BY us, event_id) AS DOUBLE) AS v
      FROM ev WHERE {where})))"""


def window_sum(src: str, window: int, by: list[str], value: str = "sum(i.inc)", grid: str = "grid",
               shift: int = 0) -> str:
    """SQL: aggregate ``src`` rows in ``(t - window, t]`` per grid time and group."""
    lab = "".join(f"i.{b} AS {b}, " for b in by)
    grp = "".join(f", i.{b}" for b in by)
    return (f"SELECT g.t AS t, {lab}{value} AS value FROM {grid} g JOIN {src} i "
            f"ON i.us > (g.t - {shift} - {window}) * 1000000 AND i.us <= (g.t - {shift}) * 1000000 GROUP BY g.t{grp}")


def bucket_counts(d: DataFrame, col: str, bounds, labels: list[str]) -> DataFrame:
    """Running counts of the day (labels, le, ts, value) per bound: summed side by side, one row per event, and unfolded after."""
    w = Window.partitionBy(*labels, "day").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    hits = [(le_text(b), (F.col(col) <= float(b)).cast("int")) for b in bounds] + [("+Inf", F.lit(1))]
    d = d.select(*labels, "day", "us", "event_id", "ts", *[h.alias(f"_h{i}") for i, (_, h) in enumerate(hits)])
    d = dealt(d, *labels, "day").select(*labels, "ts", *[F.sum(f"_h{i}").over(w).cast("double").alias(f"_h{i}") for i in range(len(hits))])
    rows = [F.struct(F.lit(le).alias("le"), F.col(f"_h{i}").alias("value")) for i, (le, _) in enumerate(hits)]
    return d.select(*labels, "ts", F.explode(F.array(*rows)).alias("b")).select(*labels, "b.le", "ts", "b.value")


def bucket_samples(spark: SparkSession, sf: str, col: str, bounds, labels: list[str]) -> DataFrame:
    """Histogram bucket counters ``le`` (restarting daily) for an observed column."""
    return bucket_counts(events(spark, sf), col, bounds, labels)


def bucket_increments(name: str, col: str, bounds, labels: list[str]) -> str:
    """SQL twin of :func:`bucket_samples` with increments (needs ``ev``)."""
    vals = ", ".join(f"('{le_text(b)}', {float(b)!r})" for b in bounds)
    lab = ", ".join(labels) + ", " if labels else ""
    keys = ", ".join([*labels, "le"])
    return f"""{name} AS (
  SELECT {lab}le, bound, us, CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END AS inc FROM (
    SELECT *, lag(v) OVER (PARTITION BY {keys} ORDER BY us, event_id) AS p FROM (
      SELECT {lab}le, bound, us, event_id, CAST(sum(CASE WHEN {col} <= bound THEN 1 ELSE 0 END)
             OVER (PARTITION BY {keys}, day ORDER BY us, event_id) AS DOUBLE) AS v
      FROM ev CROSS JOIN (SELECT * FROM (VALUES {vals}, ('+Inf', CAST('inf' AS DOUBLE))) b(le, bound)))))"""


def quantile_sql(q: float, src: str, by: list[str]) -> str:
    """SQL bucket quantile over rows ``(t, by.., bound, value)``."""
    keys = ", ".join(["t", *by])
    return f"""SELECT {keys}, CASE WHEN total <= 0 THEN NULL WHEN bound = 'inf'::DOUBLE THEN prev_b
         WHEN value = prev_v THEN bound ELSE prev_b0 + (bound - prev_b0) * ({q} * total - prev_v) / (value - prev_v) END AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bound) AS rn FROM (
    SELECT {keys}, bound, value, max(value) OVER (PARTITION BY {keys}) AS total,
           coalesce(lag(value) OVER (PARTITION BY {keys} ORDER BY bound), 0) AS prev_v,
           lag(bound) OVER (PARTITION BY {keys} ORDER BY bound) AS prev_b,
           coalesce(lag(bound) OVER (PARTITION BY {keys} ORDER BY bound), 0) AS prev_b0
    FROM {src}) WHERE value >= {q} * total) WHERE rn = 1"""


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison; everything else as is."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])
