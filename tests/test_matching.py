"""Nearest-year choice, ambiguity routing and title search."""

import random

import pytest

from starfold.operators import matching

SCHEMA = "request int, year int, src_rank int, pos int, id int, release_date string"


def pick(spark, dates, year, tolerance=1):
    rows = [(0, year, 0, pos, pos + 1, date) for pos, date in enumerate(dates)]
    pool = matching.candidate_pool(spark.createDataFrame(rows, SCHEMA), ["request"])
    best = matching.pick_nearest_year(pool, ["request"], tolerance=tolerance).collect()
    return best[0]["id"] if best else None


@pytest.mark.parametrize("dates, year, expected", [
    ([], 2015, None),
    (["2015-01-01", "2024-01-01"], None, 1),
    (["2024-01-16", "2004-04-30"], 2004, 2),
    (["2019-01-01"], 2015, None),
    (["2015-09-01"], 2014, 1),
    (["2015-01-01", "2015-06-01"], 2015, 1),
    (["", "2015-01-01"], 2015, 2),
])
def test_nearest_year(spark, dates, year, expected):
    assert pick(spark, dates, year) == expected


def test_catalog_search_agrees_with_the_rule(spark):
    random.seed(1)
    films = [(i, f"t{i % 4}", f"T{i % 4}", random.choice(
        ["", f"{random.randint(1990, 2005)}-01-01"]), random.randint(0, 9)) for i in range(60)]
    catalog = spark.createDataFrame(
        films, "id long, title string, original_title string, release_date string, rnk int")
    wanted = [(f"t{t}", y) for t in range(5) for y in (None, *range(1988, 2008))]
    requests = spark.createDataFrame(wanted, "title string, year int")
    got = {(r.title, r.year): r.id
           for r in matching.nearest_year_matches(requests, catalog).collect()}
    for title, year in wanted:
        ranked = sorted((f for f in films if f[1] == title), key=lambda f: (f[4], f[0]))
        best = None
        if year is None:
            best = ranked[0][0] if ranked else None
        else:
            dated = [(abs(int(f[3][:4]) - year), n, f[0]) for n, f in enumerate(ranked) if f[3]]
            if dated and min(dated)[0] <= 1:
                best = min(dated)[2]
        assert got.get((title, year)) == best, (title, year)


def test_single_title(spark):
    catalog = spark.createDataFrame(
        [(1, "Dune", "Dune", "1984-12-14", 0), (2, "Dune", "Dune", "2021-09-15", 1)],
        "id long, title string, original_title string, release_date string, rnk int")
    assert matching.search_title(catalog, "dune", 2021)["id"] == 2
    assert matching.search_title(catalog, "Dune")["id"] == 1
    assert matching.search_title(catalog, "Dune", 2005) is None


def test_ambiguous_ids_go_to_unmatched(spark):
    resolved = spark.createDataFrame(
        [(1, "a", 10), (1, "b", 20), (1, "c", 30), (1, "d", 30), (1, "e", 40), (2, "c", 30)],
        "userId long, query_title string, tmdb_id long")
    links = spark.createDataFrame(
        [(100, 10), (200, 20), (201, 20), (300, 30), (500, None)], "movieId long, tmdbId long")
    rows = matching.classify_matches(resolved, links, ["userId"])
    kept = {(r.userId, r.query_title): r.movieId for r in rows.where("kind = 'matched'").collect()}
    assert kept == {(1, "a"): 100, (2, "c"): 300}
    lost = sorted(r.query_title for r in rows.where("kind = 'unmatched'").collect())
    assert lost == ["b", "b", "c", "d", "e"]
    distinct = matching.classify_matches(resolved, links, ["userId"], dedup_unmatched=True)
    assert sorted(r.query_title for r in distinct.where("kind = 'unmatched'").collect()) == [
        "b", "c", "d", "e"]


def test_title_search_equals_brute_force(spark):
    random.seed(2)
    words = ["ring", "red", "Dune", "a", "of", "Éa", "x(y"]
    items = [(i, " ".join(random.choices(words, k=random.randint(1, 3)))
              + random.choice(["", " (1999)", " (2000)", " (1999) (2000)"]), "G") for i in range(80)]
    queries = [(q, y) for q in ("ring", "RED", "a", "", "d", "g r", "(y", "zzz", "é") for y in (
        1999, 2000)]
    hits = matching.title_search(spark.createDataFrame(queries, "title string, year int"),
                                 spark.createDataFrame(items, "movieId long, title string, genres string"))
    got = {(r.title, r.year, r.movieId) for r in hits.collect()}
    assert got == {(q, y, i) for q, y in queries for i, t, _ in items
                   if q.lower() in t.lower() and t.rstrip().endswith(f"({y})")}


def test_trailing_year_of_doubled_suffix(spark):
    items = spark.createDataFrame([(1, "Dune (2021) (2021)", ""), (2, "Dune", "")],
                                  "movieId long, title string, genres string")
    found = matching.title_search(spark.createDataFrame([("dune", 2021)], "title string, year int"), items)
    assert [r.movieId for r in found.collect()] == [1]
