"""Causes, severity and responding agencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keyword tables of the three category rule sets; fixed values. In ``digest`` and ``map`` the first match wins,
#: in ``filter`` a cause belongs to every group it matches.
DIGEST = {
    "Accidents": ["ACCIDENT", "TRAFF ACC", "CRASH", "COLLISION", "WRECK", "MVA", "MVC", "HIT AND RUN", "HIT & RUN", "HIT/RUN"],
    "Fire": ["FIRE", "SMOKE"],
    "Hazards": ["HAZARD", "SPILL", "DEBRIS", "OBSTRUCT", "FLOOD", "TREE", "POWER LINE", "LINE DOWN", "ANIMAL"],
    "Signals": ["SIGNAL", "TRAFFIC CONTROL", "TRAFFIC LIGHT", "MALFUNCTION"],
    "Stalled": ["STALL", "DISABLED", "STUCK", "ABANDONED"],
    "Medical / rescue": ["MEDICAL", "RESCUE", "INJURY", "AMBULANCE", "OVERDOSE"],
}
MAP = {
    "accident": ["ACCIDENT", "TRAFF ACC", "CRASH", "COLLISION", "WRECK", "MVA", "MVC", "HIT AND RUN", "HIT & RUN", "HIT/RUN"],
    "fire": ["FIRE", "SMOKE"],
    "hazard": ["HAZARD", "DEBRIS", "SPILL", "FLOOD", "WATER", "TREE", "OBSTRUCT", "DOWN", "ANIMAL", "ICE ON", "ICY"],
    "control": ["TRAFFIC CONTROL", "SIGNAL", "TRAFFIC LIGHT", "LIGHT OUT", "MALFUNCTION"],
    "vehicle": ["STALL", "DISABLED", "ABANDON"],
    "medical": ["MEDICAL", "INJURY", "PEDESTRIAN"],
}
FILTER = {
    "accident": ["ACCIDENT", "CRASH", "COLLISION", "WRECK", "MVA", "MVC"],
    "fire": ["FIRE", "SMOKE"],
    "hazard": ["HAZARD", "SPILL", "DEBRIS", "OBSTRUCT", "FLOOD", "TREE", "POWER LINE", "LINE DOWN", "ANIMAL"],
    "signal": ["SIGNAL", "TRAFFIC CONTROL", "TRAFFIC LIGHT", "MALFUNCTION"],
    "stalled": ["STALL", "DISABLED", "STUCK", "ABANDONED"],
    "medical": ["MEDICAL", "RESCUE", "INJURY", "AMBULANCE", "OVERDOSE"],
}
#: Patterns of the agencies, in the order of their bits; fixed values.
AGENCIES = {"police": r"POLICE|\bLPD\b", "sheriff": r"SHERIFF|\bLPSO\b", "fire": r"FIRE|\bLFD\b", "ems": r"\bEMS\b|AMBULANCE|ACADIAN|\bMEDIC"}


def _has(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def category(cause: Column, ruleset: str = "map") -> Column:
    """PRJ-13: first category of the rule set ``digest`` or ``map`` that the cause matches."""
    c = F.upper(F.coalesce(cause, F.lit("")))
    table, other = (DIGEST, "Other") if ruleset == "digest" else (MAP, "other")
    pairs = list(table.items())
    out = F.when(_has(c, pairs[0][1]), pairs[0][0])
    for name, words in pairs[1:]:
        out = out.when(_has(c, words), name)
    return out.otherwise(other)


def cause_groups(cause: Column) -> Column:
    """PRJ-13, rule set ``filter``: all groups of a cause; ``other`` if it is in none."""
    c = F.upper(F.trim(F.coalesce(cause, F.lit(""))))
    found = F.array_compact(F.array(*[F.when(_has(c, words), name) for name, words in FILTER.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit("other"))).otherwise(found)


def with_category(df: DataFrame, ruleset: str = "map") -> DataFrame:
    if ruleset == "filter":
        return df.withColumn("cause_groups", cause_groups(F.col("cause")))
    return df.withColumn("category", category(F.col("cause"), ruleset))


#: Severity ranks, in the order in which causes are told. Fixed values.
RANKS = {"fatal": 100, "injuries": 90, "hit and run": 80, "major": 70, "injuries unknown": 60, "minor": 50, "crash": 45, "rescue": 20, "stalled": 15, "other": 30}


def severity(cause: Column) -> Column:
    """PRJ-14: rank of a cause, higher is worse; ordered rules, 30 where none holds."""
    c = F.upper(F.coalesce(cause, F.lit("")))
    has = lambda w: F.contains(c, F.lit(w))
    ranks = [(has("FATAL"), "fatal"), (c.rlike(r"W/\s*INJ|WITH\s+INJ"), "injuries"), (has("HIT") & (has("RUN") | has("&")), "hit and run"), (has("MAJOR"), "major"), (has("UNK") & has("INJ"), "injuries unknown"), (has("MINOR"), "minor"), (has("ACCIDENT") | has("CRASH") | has("COLLISION"), "crash"), (has("RESCUE"), "rescue"), (has("STALL") | has("DISABLED"), "stalled")]
    return F.coalesce(*[F.when(test, F.lit(RANKS[what])) for test, what in ranks], F.lit(RANKS["other"]))


def severe(cause: Column) -> Column:
    c = F.upper(F.coalesce(cause, F.lit("")))
    return c.rlike(r"FATAL|W/\s*INJ|INJURIE|RESCUE|MAJOR") & ~F.contains(c, F.lit("NO INJ"))


def with_severity(df: DataFrame, ts: str = "reported_ts") -> DataFrame:
    """PRJ-14: severity, and for crashes is_severe, is_hit_and_run; is_night from 21 to 5."""
    crash = category(F.col("cause")) == "accident"
    hour = F.hour(ts)
    return df.withColumn("severity", severity(F.col("cause"))).withColumn("is_severe", crash & severe(F.col("cause"))).withColumn("is_hit_and_run", crash & F.contains(F.upper("cause"), F.lit("HIT"))).withColumn("is_night", (hour >= 21) | (hour < 5))


def with_agencies(df: DataFrame) -> DataFrame:
    """PRJ-15: agency_mask (bit 16: none listed) and agencies."""
    c = F.upper(F.coalesce(F.col("assisting"), F.lit("")))
    mask = F.lit(0)
    for i, pattern in enumerate(AGENCIES.values()):
        mask = mask.bitwiseOR(F.when(c.rlike(pattern), F.lit(1 << i)).otherwise(F.lit(0)))
    names = F.array_compact(F.array(*[F.when(c.rlike(p), n) for n, p in AGENCIES.items()]))
    return df.withColumn("agency_mask", F.when(mask == 0, F.lit(16)).otherwise(mask)).withColumn("agencies", names)


def with_upgrade_flag(episodes: DataFrame) -> DataFrame:
    """PRJ-35: a severe crash with an earlier, milder listing in its episode."""
    return episodes.withColumn("is_upgraded", severe(F.col("cause")) & F.exists("extras", lambda x: (x["severity"] < F.col("severity")) & (x["reported_ts"] < F.col("reported_ts"))))
