"""Readers: feed snapshots, station reports, forecasts, alerts, the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispatchlake.functions.text import clean_numeric, with_incident_id
from dispatchlake.sources.versioned import VersionedTable

ARCHIVE = "incident_number string, location string, cause string, reported string, assisting string, latitude double, longitude double, created_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, geocode_attempts int, geocode_confidence string, observation_count int"


def conform(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """SNK-02: df with exactly the columns of a schema: missing ones as typed nulls, text read with try_cast."""
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def parse_snapshots(df: DataFrame, payload: str = "payload", sweep_ts: str = "sweep_ts") -> DataFrame:
    """SRC-01: one row for each listing of feed snapshots ``{success, data: "<table>..."}``; batch or stream.

    Failed snapshots give nothing; the header row and rows without exactly four cells are left out.
    """
    body = F.from_json(payload, "success boolean, data string")
    rows = df.select(F.col(sweep_ts).alias("sweep_ts"), body.alias("b")).filter("b.success")
    rows = rows.select("sweep_ts", F.posexplode(F.regexp_extract_all("b.data", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("pos", "row"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"(?U)\s+", " "))
    cells = rows.select("sweep_ts", "pos", F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), clean).alias("c")).filter("size(c) = 4")
    return with_incident_id(cells.select("sweep_ts", "pos", *[F.col("c")[k].alias(n) for k, n in enumerate(("location", "cause", "reported", "assisting"))]))


def snapshot_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """SRC-10: stream of snapshots from JSON files (sweep_ts, payload)."""
    return spark.readStream.schema("sweep_ts timestamp, payload string").option("maxFilesPerTrigger", files).json(path)


def read_archive_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: archive CSV with any order and subset of the known columns; blanks are null."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).csv(path)
    known = [f.name for f in T.StructType.fromDDL(ARCHIVE)]
    text = raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns if c in known])
    out = conform(text, ARCHIVE)
    return out.withColumn("latitude", F.when(~F.isnan("latitude"), F.col("latitude"))).withColumn("longitude", F.when(~F.isnan("longitude"), F.col("longitude")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: the archive's newest version with its fixed projection."""
    return VersionedTable(spark, path, ARCHIVE, ["incident_number"], "month").read().drop("month")


def resolve_latlon(df: DataFrame) -> DataFrame:
    """SRC-04: latitude and longitude columns under their usual other names."""
    lower = {c.lower(): c for c in df.columns}
    for want, names in (("latitude", ("latitude", "lat", "y")), ("longitude", ("longitude", "lng", "lon", "long", "x"))):
        found = next((lower[n] for n in names if n in lower), None)
        if found and found != want:
            df = df.withColumnRenamed(found, want)
    return df


def parse_station_csv(df: DataFrame) -> DataFrame:
    """SRC-05: observations from text columns valid, tmpf, p01i, vsby, sknt, wxcodes: M is null, T a trace, knots to mph."""
    num = lambda c: clean_numeric(F.when(F.col(c) == "T", "0.001").when(F.col(c) != "M", F.col(c)))
    at = F.col("valid").try_cast("timestamp_ntz")
    wx = F.when(F.col("wxcodes") != "M", F.trim("wxcodes"))
    return df.select(at.alias("obs_ts"), F.date_trunc("HOUR", at).alias("hour"), num("tmpf").alias("temp_f"), num("p01i").alias("precip_in"), num("vsby").alias("visibility_mi"), F.round(num("sknt") * 1.150779, 1).alias("wind_mph"), F.coalesce(wx, F.lit("")).alias("wx")).filter("obs_ts IS NOT NULL")


_VALUE = "struct<value:double>"


def parse_station_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """SRC-06: observations of a station's JSON features in US units; no rain amount and no wet code means none fell."""
    kind = f"features array<struct<properties:struct<timestamp:string,temperature:{_VALUE},precipitationLastHour:{_VALUE},visibility:{_VALUE},windSpeed:{_VALUE},rawMessage:string>>>"
    p = df.select(F.explode(F.from_json(payload, kind)["features"]).alias("f")).select("f.properties.*")
    wx = F.coalesce(F.col("rawMessage"), F.lit(""))
    rain = F.coalesce(F.col("precipitationLastHour.value") / 25.4, F.when(~wx.rlike(r"\b[-+]?(?:RA|DZ|TSRA|SN|PL|GR|UP)\b"), F.lit(0.0)))
    return p.select(F.col("timestamp").try_cast("timestamp").alias("obs_ts"), F.round(F.col("temperature.value") * 9 / 5 + 32, 1).alias("temp_f"), F.round(rain, 3).alias("precip_in"), F.round(F.col("visibility.value") / 1609.344, 2).alias("visibility_mi"), F.round(F.col("windSpeed.value") / 1.609344, 1).alias("wind_mph")).filter("obs_ts IS NOT NULL")


def explode_forecast(df: DataFrame, payload: str = "payload") -> DataFrame:
    """SRC-07: forecast grid JSON as rows (variable, start, end, value, uom); validTime is start/PnDTnH."""
    grid = F.from_json(F.get_json_object(payload, "$.properties"), "map<string,string>")
    cells = df.select(F.explode(grid).alias("variable", "body")).withColumn("v", F.from_json("body", "uom string, values array<struct<validTime:string,value:double>>")).filter("v.values IS NOT NULL")
    rows = cells.select("variable", F.col("v.uom").alias("uom"), F.explode("v.values").alias("x"))
    span = F.split("x.validTime", "/")
    part = lambda p: F.coalesce(F.nullif(F.regexp_extract(span[1], p, 1), F.lit("")).try_cast("int"), F.lit(0))
    start = span[0].try_cast("timestamp")
    return rows.select("variable", "uom", start.alias("start"), (start + F.make_interval(days=part(r"P(\d+)D"), hours=part(r"T(?:\D*)(\d+)H"))).alias("end"), F.col("x.value").alias("value"))


def summarise_alerts(df: DataFrame, payload: str = "payload") -> DataFrame:
    """SRC-08: for each fetch the three alert flags and the number of active alerts."""
    events = F.transform(F.from_json(payload, "features array<struct<properties:struct<event:string>>>")["features"], lambda f: F.upper(F.coalesce(f["properties"]["event"], F.lit(""))))
    has = lambda w: F.exists(F.coalesce("e", F.array().cast("array<string>")), lambda x: x.contains(w))
    return df.withColumn("e", events).withColumn("nws_flash_flood_warning", has("FLASH FLOOD WARNING")).withColumn("nws_severe_thunderstorm_warning", has("SEVERE THUNDERSTORM WARNING")).withColumn("nws_tornado_watch", has("TORNADO")).withColumn("nws_active_alert_count", F.greatest(F.size("e"), F.lit(0))).drop("e", payload)
