"""FLT-27 for many typed names at once: an index of the words of all distinct locations, joined back to the rows.

``filters.fuzzy_road`` measures an edit distance for each row and typed word. Here each distinct location is looked at once:
its words are posted under every string that one or two missing letters make of them, and a typed word meets them under its
own such strings, since two words within k edits have a string in common that lacks at most k letters of either. Parts of
locations are found by their first three characters. What meets is then verified, so the rows are the same.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.sources.scratch import stored

#: Words of more letters have too many strings with two letters missing; they meet typed words of a like length instead.
LONG = 32


class RoadIndex(NamedTuple):
    """Tables of an index. ``location`` is a row's text as it is, null as ''."""

    grams: DataFrame  # gram, location: parts of one to three characters
    words: DataFrame  # word, location
    variants: DataFrame  # variant, word: for words up to LONG letters
    long_words: DataFrame  # word, n: the others and their length


def _fewer(words: Column) -> Column:
    """Every string that one missing letter makes of one of the strings."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), cut)))


def variants(word: Column, edits: int) -> Column:
    """The word and every string that up to so many missing letters make of it."""
    out, last = F.array(word), F.array(word)
    for _ in range(edits):
        last = _fewer(last)
        out = F.array_union(out, last)
    return out


def build(rows: DataFrame) -> RoadIndex:
    """The index of the distinct locations of some rows, written to the shared folder.

    Locations are lines of some hundred characters; a text of n characters takes 3 n postings. Nulls are met as ''.
    """
    places = stored(rows.select(F.coalesce("location", F.lit("")).alias("location")).distinct(), "places")
    text = F.upper("location")
    at = F.filter(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(3))), lambda g: g != "")
    grams = F.array_distinct(F.flatten(F.transform(at, lambda g: F.array(F.substr(g, F.lit(1), F.lit(1)), F.substr(g, F.lit(1), F.lit(2)), g))))
    posted = stored(places.filter("location <> ''").select(F.explode(grams).alias("gram"), "location"), "grams")
    words = stored(places.select(F.explode(F.array_distinct(F.filter(F.split(text, r"[^A-Z0-9]+"), lambda w: w != ""))).alias("word"), "location"), "words")
    each = stored(words.select("word").distinct(), "distinct_words")
    short = F.length("word") <= LONG
    posted_words = stored(each.filter(short).select(F.explode(variants(F.col("word"), 2)).alias("variant"), "word"), "variants")
    return RoadIndex(posted, words, posted_words, each.filter(~short).select("word", F.length("word").alias("n")))


def search(index: RoadIndex, typed: DataFrame) -> DataFrame:
    """(typed, location): the locations that ``fuzzy_road`` keeps for each distinct typed name (typed).

    A typed name without words, or null, would keep every row and is left out.
    """
    split = F.array_distinct(F.filter(F.split(F.upper("typed"), r"\s+"), lambda w: w != ""))
    terms = stored(typed.select("typed").distinct().select("typed", F.explode(split).alias("term")), "terms")
    one = terms.select("term").distinct()
    parts = one.withColumn("gram", F.substr("term", F.lit(1), F.lit(3))).join(index.grams, "gram").filter(F.contains(F.upper("location"), F.col("term"))).select("term", "location")

    n = F.length("term")
    near = lambda word: F.when(n <= 4, F.levenshtein(word, F.col("term"), 1)).otherwise(F.levenshtein(word, F.col("term"), 2)) >= 0
    open_ = one.filter(n > 2)  # shorter words must be parts
    strings = F.when(n <= 4, variants(F.col("term"), 1)).otherwise(variants(F.col("term"), 2))
    by_string = open_.filter(n <= LONG + 2).select("term", F.explode(strings).alias("variant")).join(index.variants, "variant").select("term", "word").distinct()
    by_length = open_.filter(n > LONG - 2).select("term", F.explode(F.sequence(n - 2, n + 2)).alias("n")).join(index.long_words, "n").select("term", "word")
    words = by_string.unionByName(by_length).filter(near(F.col("word")))
    hits = parts.unionByName(words.join(index.words, "word").select("term", "location")).distinct()

    need = terms.groupBy("typed").agg(F.count(F.lit(1)).alias("need"))
    found = terms.join(hits, "term").groupBy("typed", "location").agg(F.count(F.lit(1)).alias("n"))
    return found.join(need, "typed").filter("n = need").select("typed", "location")


def search_rows(rows: DataFrame, index: RoadIndex, typed: DataFrame) -> DataFrame:
    """The rows that each typed name keeps, with it as column ``typed``."""
    hits = search(index, typed).withColumnRenamed("location", "__place")
    return rows.join(hits, F.coalesce(rows["location"], F.lit("")) == F.col("__place")).drop("__place")
