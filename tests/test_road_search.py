"""The word index keeps the rows that the edit distance of each row and word keeps."""

from pyspark.sql import functions as F

from dispatchlake.operators import filters, road_search

NAMES = ["KALISTE", "JOHNSTON", "PINHOOK", "CONGRESS", "DUHON", "BENDEL", "CURRAN", "MAIN", "OAK", "BROUSSARD"]
LOCATIONS = [f"{100 + k} {n} ST, LAFAYETTE, LA" for k, n in enumerate(NAMES)] + ["i-10 e", "AMBASSADOR CAFFERY PKWY/CURRAN LN", "  kaliste saloom ", "A&B", "", None, "É RUE", "X" * 40, "Y" * 31 + " MAIN", "ST" * 300]


def edits(word):
    """Every word within one edit, with letters A, Z and missing ones."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in "AZ":
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)} | {word[:i] + c + word[i + 1 :] for i in range(len(word))}
    return out


def both(spark, locations, typed):
    """Rows (typed, location) of the index, and of the column in a plain nested loop."""
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(locations)], "id int, location string")
    t = spark.createDataFrame([(x,) for x in typed], "typed string")
    found = road_search.search_rows(rows, road_search.build(rows), t)
    got = {(r.typed, r.id) for r in found.collect()}
    words = F.filter(F.split(F.upper("typed"), r"\s+"), lambda w: w != "")
    text = F.upper(F.coalesce("location", F.lit("")))
    tokens = F.split(text, r"[^A-Z0-9]+")
    near = lambda w: (F.length(w) > 2) & F.exists(tokens, lambda x: F.levenshtein(x, w) <= F.when(F.length(w) <= 4, 1).otherwise(2))
    want = rows.crossJoin(t).filter((F.size(words) > 0) & F.forall(words, lambda w: F.contains(text, w) | near(w)))
    return got, {(r.typed, r.id) for r in want.collect()}, rows


def test_all_two_edit_variants_of_ten_names(spark):  # over the letters A and Z
    typed = {v for n in NAMES for e in edits(n) for v in edits(e)} - {""}
    got, want, _ = both(spark, LOCATIONS, sorted(typed))
    assert len(typed) > 5000 and got == want
    assert all((n, k) in got for k, n in enumerate(NAMES))


def test_parts_short_long_and_empty_words(spark):
    typed = ["i-10", "& ", "A", "ST", "la main", "kalist salom", "", "  ", None, "X" * 39, "X" * 38, "X" * 37, "Y" * 33, "Y" * 32 + "Z", "ST" * 299, "salome kaliste kaliste", "é", "nothing here"]
    got, want, rows = both(spark, LOCATIONS, typed)
    assert got == want
    for t in ["i-10", "kalist salom", "X" * 39, "ST" * 299]:
        one = {r.id for r in rows.filter(filters.fuzzy_road(F.col("location"), t)).collect()}
        assert one == {k for x, k in got if x == t} and one


def test_repeated_rows_and_empty_tables(spark):
    got, want, rows = both(spark, ["MAIN ST", "MAIN ST", None], ["main", "main"])
    assert got == want == {("main", 0), ("main", 1)}
    assert road_search.search(road_search.build(rows.limit(0)), spark.createDataFrame([("main",)], "typed string")).count() == 0
    assert road_search.search(road_search.build(rows), spark.createDataFrame([], "typed string")).count() == 0
