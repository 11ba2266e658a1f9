"""Cleaning of text and numbers: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that stand for a missing value; fixed values.
MISSING = ["", "nan", "none", "null", "undefined", "<na>"]


def folded(c: Column) -> Column:
    """Upper case, with every run of white space (also the non-breaking kind) as one blank; null as ''."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def with_content_key(df: DataFrame) -> DataFrame:
    """PRJ-01: content_key of location, cause and reported."""
    return df.withColumn("content_key", F.concat_ws("|", *[folded(F.col(c)) for c in ("location", "cause", "reported")]))


def with_incident_id(df: DataFrame) -> DataFrame:
    """PRJ-02: incident number made of the listing's three fields."""
    part = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    return df.withColumn("incident_number", F.concat(part("location"), F.lit("\n" + "_" * 24 + "LAF_PARISH,_LA_"), part("cause"), F.lit("_"), part("reported")))


def with_location_key(df: DataFrame) -> DataFrame:
    """PRJ-03: location_key, the folded location."""
    return df.withColumn("location_key", folded(F.col("location")))


def clean_text(c: Column) -> Column:
    """PRJ-04: text without surrounding blanks; words for a missing value become null."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(MISSING), t)


def clean_numeric(c: Column) -> Column:
    """PRJ-04: number or null, never NaN."""
    x = clean_text(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def title_case_road(c: Column) -> Column:
    """PRJ-20: title case; abbreviations of two letters and highway numbers stay in capitals."""
    word = lambda w: F.when(F.upper(w).rlike(r"^(?:[NS][EW]?|[EW]|US|LA|I-?\d+.*)$"), F.upper(w)).otherwise(F.initcap(F.lower(w)))
    return F.array_join(F.transform(F.split(c, " "), word), " ")


def with_place_parts(df: DataFrame) -> DataFrame:
    """PRJ-19: block, cross_street and town of a location; ``Parish`` for places outside the towns."""
    s = F.trim(F.regexp_replace(F.coalesce(F.col("location"), F.lit("")), r"(?U)\s+", " "))
    pattern = r"^(.*?)[\s,]+(LAF PARISH|[A-Z]+),\s*LA$"
    town = F.regexp_extract(s, pattern, 2)
    rest = F.when(town != "", F.trim(F.regexp_extract(s, pattern, 1))).otherwise(s)
    out = df.withColumn("town", F.when(town == "LAF PARISH", "Parish").otherwise(F.initcap(F.lower(town))))
    return out.withColumn("block", F.trim(F.substring_index(rest, "/", 1))).withColumn("cross_street", F.when(F.instr(rest, "/") > 0, F.trim(F.regexp_replace(rest, "^[^/]*/", ""))).otherwise(""))
