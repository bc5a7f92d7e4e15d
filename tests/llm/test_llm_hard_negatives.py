"""Hard negatives against brute force, and what the bounds save."""

import math
import random

import numpy as np
import pytest

from starfold.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, pivot string, q string, rank int"


def brute(rows, every=100, positives=5, negatives=10):
    kept = set()
    for number, vector, label, *_ in rows:
        if number is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.add((number, (label + 1) % 10 if number % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = []
    for number, label, vector in kept:
        if number % every:
            continue
        others = [(-sum(a * b for a, b in zip(vector, v)), n, l) for n, l, v in kept if n != number and len(v) == len(vector)]
        for score, positive, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fit = sorted(x for x in others if x[2] != label and 30 * -score <= 100 * -x[0] <= 90 * -score)[:negatives]
            out += [(number, positive, rank, n, -score, -s) for rank, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def rows_of(seed, n, dim, centers=None):
    rng = random.Random(seed)
    mids = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centers)] if centers else None
    out = []
    for i in range(n):
        mid = rng.choice(mids) if mids else [0.0] * dim
        out.append((i, [m + rng.gauss(0, 0.08 if mids else 0.6) for m in mid], rng.randrange(10), "d", "p", "q", 7))
    return out


@pytest.fixture(scope="module")
def table_rows():
    rows = rows_of(1, 900, 6) + [(1_000 + i, *rows_of(2, 1, 5)[0][1:]) for i in range(30)]  # equal rows of another dimension
    hot = rows[100][1]
    rows += [(2_000 + i, hot, rows[100][2], "d", "p", "q", 7) for i in range(300)]  # one vector, two labels, many ids
    rows += [(3_000 + i, hot, (rows[100][2] + 1) % 10, "d", "p", "q", 7) for i in range(120)]
    rows += [rows[0], rows[0], rows[101]]  # the same rows again
    rows += [(n, v, l, "d", "p", "q", 7) for n, v, l in (
        (4_000, None, 1), (4_100, [0.5] * 6, None), (None, [0.5] * 6, 1), (4_200, [0.0] * 6, 3), (4_300, [], 3), (4_301, [], 4), (4_302, [], 3),
        (4_400, [0.1, None, 0.2, 0.1, 0.1, 0.1], 1), (4_500, [float("nan")] * 6, 1), (4_600, [float("inf")] + [0.0] * 5, 1),
        (4_700, [1e14] * 6, 2), (4_701, [2e14] * 6, 2), (4_702, [1.2e14] * 6, 5), (4_800, [2.0] * 6, 1), (4_900, [0.3], 1), (4_901, [0.4], 1), (4_902, [0.2], 2))]
    return rows


def test_all_windows_are_those_of_brute_force(spark, table_rows):
    rows = [r for r in table_rows if r[0] not in (4_700, 4_701, 4_702)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    assert len({r[0] for r in want}) > 15
    for shard_rows, query_rows in ((100, 3), (10_000, 2_048)):  # pivots with several pieces and blocks; one piece
        found = H.mine(df, shard_rows=shard_rows, query_rows=query_rows)
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, found.collect())) == want


def test_scores_beyond_a_double_or_a_long(table_rows):
    ids, labels = np.arange(4), np.array([1, 2, 2, 2])
    q = np.array([[1, 1], [1 << 53, 1], [1 << 53, 2], [1 << 62, 1 << 62]])
    search = H.Search(H.Cells(ids, labels, q))
    found = search.walk(9, 1, np.array([1 << 4, 1]), False, [H.LEAST], [H.MOST], 3)
    assert list(zip(found.ids.tolist(), found.scores.tolist())) == [(3, H.MOST), (2, (1 << 57) + 2), (1, (1 << 57) + 1)]


def test_no_rows_and_no_usable_rows(spark):
    assert H.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.mine(spark.createDataFrame([(100, None, 1, "d", "p", "q", 7), (200, [1.0], None, "d", "p", "q", 7)], SCHEMA)).count() == 0
    assert H.mine(spark.createDataFrame([(100, [1.0], 1, "d", "p", "q", 7)], SCHEMA)).count() == 0


def test_cells_come_by_falling_bound_and_walks_stop_early():
    rows = rows_of(3, 4_000, 16, centers=40)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    q = np.array([[math.floor(256 * x) for x in r[1]] for r in rows])
    cells = H.Cells(ids, labels, q)
    search = H.Search(H.Cells.from_bytes(cells.to_bytes()))
    seen = []
    for row in range(0, 4_000, 100):
        found = search.walk(row, labels[row], q[row], False, [H.LEAST], [H.MOST], 10)
        score = q @ q[row]
        order = [i for i in np.lexsort((ids, -score)) if i != row and labels[i] != labels[row]][:10]
        assert found.ids.tolist() == ids[order].tolist() and found.scores.tolist() == score[order].tolist()
        seen.append(found.seen)
    assert np.mean(seen) < 0.5 * 4_000  # of clustered rows most are never scored


def test_only_pieces_that_can_help_are_asked(spark):
    rows = rows_of(4, 3_000, 8, centers=12)
    df = spark.createDataFrame(rows, SCHEMA)
    cells, pivots = H.index(H.candidates(H.whole_vectors(df), 11), shard_rows=150)
    assert len(pivots.pieces) > 10 and cells.count() == sum(pivots.pieces.values())
    anchors = H.whole_vectors(df).where("vec_id % 100 = 0").selectExpr("vec_id as anchor_key", "vec_id as anchor_id", "label", "dim", "q",
                                                                      f"array({H.LEAST}L + 1) as low", f"array({H.MOST}L) as high")
    found = H.find(anchors, cells, pivots, True, 5).collect()
    assert len(found) == 5 * 30
    first = H.asked(H.routed(anchors.withColumn("need", anchors["low"]), pivots, True), cells, True, 5).groupBy("anchor_key").agg({"score": "min"})
    need = anchors.join(first, "anchor_key").selectExpr("*", "array(`min(score)`) as need").drop("min(score)")
    pairs = H.routed(need, pivots, False).select("anchor_key", "pivot").distinct().count()
    assert pairs < 0.6 * 30 * (len(pivots.pieces) - 1)
