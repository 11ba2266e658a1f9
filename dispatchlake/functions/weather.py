"""Weather bands and condition codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WET = "RA|DZ|TS|SN|PL|GR|FZ|UP"


def condition_code(precip: Column, visibility: Column, wx: Column) -> Column:
    """PRJ-25: h heavy rain, r rain, f fog, d dry, - unknown."""
    codes = F.coalesce(wx, F.lit(""))
    return F.when(precip >= 0.30, "h").when((precip >= 0.01) | codes.rlike(WET), "r").when((visibility < 1.0) | codes.rlike("FG"), "f").when(precip.isNull() & visibility.isNull(), "-").otherwise("d")


#: Bands as (name, low, low included, high, high included); fixed values.
BANDS = {
    "temp": ("weather_temp_f", [("cold", None, False, 50, True), ("mild", 50, False, 70, False), ("warm", 70, True, 85, False), ("hot", 85, True, None, False)]),
    "precip_prob": ("weather_precip_prob", [("low", None, False, 20, False), ("med", 20, True, 60, False), ("high", 60, True, None, False)]),
    "precip": ("weather_precip_in", [("none", None, False, 0.01, True), ("light", 0.01, False, 0.10, True), ("moderate", 0.10, False, 0.50, False), ("heavy", 0.50, True, None, False)]),
    "wind": ("weather_wind_mph", [("calm", None, False, 10, False), ("breezy", 10, True, 20, False), ("windy", 20, True, None, False)]),
    "visibility": ("weather_visibility_mi", [("low", None, False, 3, False), ("hazy", 3, True, 10, False), ("clear", 10, True, None, False)]),
    "cloud": ("weather_cloud_pct", [("clear", None, False, 25, False), ("partly", 25, True, 70, False), ("overcast", 70, True, None, False)]),
}


def band(kind: str) -> Column:
    column, ranges = BANDS[kind]
    c, out = F.col(column), []
    for name, lo, lo_in, hi, hi_in in ranges:
        test = c.isNotNull()
        if lo is not None:
            test &= (c >= lo) if lo_in else (c > lo)
        if hi is not None:
            test &= (c <= hi) if hi_in else (c < hi)
        out.append(F.when(test, F.lit(name)))
    return F.coalesce(*out)


def with_weather_bands(df: DataFrame) -> DataFrame:
    """PRJ-24: the band of each weather value; null where the value is."""
    return df.withColumns({f"{k}_band": band(k) for k in BANDS})


def with_condition_code(df: DataFrame) -> DataFrame:
    return df.withColumn("code", condition_code(F.col("precip_in"), F.col("visibility_mi"), F.col("wx")))


def with_rain_flag(df: DataFrame) -> DataFrame:
    """PRJ-33: is_rain and any_alert."""
    alerts = [F.coalesce(F.col(c), F.lit(False)) for c in ("nws_flash_flood_warning", "nws_severe_thunderstorm_warning", "nws_tornado_watch")]
    rain = F.coalesce(F.col("weather_precip_prob") >= 20, F.lit(False)) | F.coalesce(F.col("weather_precip_in") > 0.005, F.lit(False))
    return df.withColumn("is_rain", rain).withColumn("any_alert", alerts[0] | alerts[1] | alerts[2])


def convert_units(value: Column, uom: Column, kind: str) -> Column:
    """PRJ-26: to Fahrenheit, inches, miles or miles an hour by unit code; unknown units stay as they are."""
    u = F.lower(F.coalesce(uom, F.lit("")))
    if kind == "temp":
        return F.when(F.endswith(u, F.lit("degc")), value * 9 / 5 + 32).otherwise(value)
    if kind == "length":
        return F.when(F.endswith(u, F.lit(":mm")), value / 25.4).when(F.endswith(u, F.lit(":m")), value / 0.0254).otherwise(value)
    if kind == "distance":
        return F.when(F.endswith(u, F.lit(":km")), value / 1.609344).when(F.endswith(u, F.lit(":m")), value / 1609.344).otherwise(value)
    return F.when(u.contains("km_h"), value / 1.609344).when(u.contains("m_s"), value * 2.236936).otherwise(value)
