"""Mixing against targets worked out in plain Python, and the tree against its law."""

from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from starfold.llm import mixing

from conftest import words_of


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Fills sources up one after the other until none is above twice its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, rest = {}, share * sum(sizes.values())
    while True:
        left = [s for s in order if s not in full]
        targets = {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        over = [s for s in left if targets[s] > 2 * sizes[s]]
        if not over:
            return full | targets
        for s in over:
            full[s] = 2 * sizes[s]
            rest -= full[s]


def check(rows, found):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words_of(text))
    targets = plain_targets(sizes)
    pairs = Counter((i, len(words_of(t)), sizes[s], round(targets[s], 6)) for i, t, s in rows)
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in found) == pairs
    assert all(0 <= r.taken <= 2 * r["size"] for r in found)
    taken, by_target = Counter(), Counter()
    for r in found:
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s, t in targets.items():
        by_target[sizes[s], round(t, 6)] += round(t)
    assert all(abs(taken[k] - by_target[k]) <= 2 for k in by_target)
    cut = [r for r in found if r["size"] and r.taken % r["size"]]
    assert len(cut) <= len(sizes)  # one cut document a source


@pytest.mark.parametrize("block_words", [50, 16_384])
def test_words_taken_add_up_to_the_targets(spark, odd, odd_rows, block_words):
    found = mixing.mix(odd, shards=5, block_words=block_words)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken", "shards"]
    check([(r[0], r[1], r[3]) for r in odd_rows], found.collect())


def test_many_sources_and_a_hot_one(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 31}") for i in range(900)] + [(2_000 + i, "hot words here " * 9, "s5") for i in range(500)]
    rows += [(7, "equal rows", "s6")] * 300 + [(None, None, "nothing")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(rows, mixing.mix(df, shards=7, block_words=60).collect())


def test_reruns_agree_in_any_partitioning(spark, odd):
    first, second = (sorted(map(str, mixing.mix(df, shards=4, block_words=80).collect())) for df in (odd, odd.repartition(11, "text")))
    assert first == second
    assert first != sorted(map(str, mixing.mix(odd, shards=4, block_words=80, seed=1).collect()))


def test_the_mix_holds_the_texts(spark, odd, tmp_path):
    rows = mixing.mix(odd, shards=3, block_words=200)
    texts = mixing.mixed_texts(odd, shards=3, block_words=200)
    mixing.write_mix(texts, str(tmp_path / "mix"))
    stored = spark.read.parquet(str(tmp_path / "mix"))
    assert {r.shard for r in stored.select("shard").distinct().collect()} == {0, 1, 2}
    got = stored.collect()
    assert all(len(words_of(r.text)) == r.words for r in got)
    assert sum(r.words for r in got) == rows.agg(F.sum("taken")).first()[0]
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((r.doc_id, s) for r in rows.collect() if r["size"] and r.taken for s in r.shards)


def test_no_rows_and_no_words(spark, empty):
    assert mixing.mix(empty).count() == 0
    found = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in found) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_shares_follow_the_hypergeometric_law(spark):
    number = lambda x: F.lit(x).cast("long")
    n = 20_000
    x = mixing.hypergeometric(number(50), number(20), number(10), mixing.unit(F.lit(3), "id"))
    seen = dict(map(tuple, spark.range(n).select(x.alias("x")).groupBy("x").count().collect()))
    want = {k: n * comb(20, k) * comb(30, 10 - k) / comb(50, 10) for k in range(11)}
    assert set(seen) <= set(want)
    assert sum((seen.get(k, 0) - w) ** 2 / w for k, w in want.items() if w > 5) < 30  # nine degrees of freedom
    wide = mixing.hypergeometric(number(10 ** 12), number(10 ** 11), number(10 ** 10), mixing.unit(F.lit(4), "id"))
    mean, deviation = spark.range(300).select(wide.alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    law = (10 ** 10 * 0.1 * 0.9 * 0.99) ** 0.5
    assert abs(mean - 10 ** 9) < 4 * law / 300 ** 0.5 and 0.8 < deviation / law < 1.2
    for total, marked, draws in ((0, 0, 0), (5, 5, 3), (5, 0, 3), (5, 2, 5), (5, 2, 0), (1, 1, 1)):
        x = spark.range(3).select(mixing.hypergeometric(number(total), number(marked), number(draws), mixing.unit("id")).alias("x")).first().x
        assert max(0, draws - total + marked) <= x <= min(marked, draws)


def test_the_tree_spends_every_quota_and_fills_every_shard(spark):
    quotas = {s: (s * 37) % 23 + (200 if s == 3 else 0) for s in range(30)}
    draws = spark.createDataFrame([(s, r) for s, q in quotas.items() for r in range(q)], "s long, rank long")
    stops = {r.s: r.stops for r in mixing.allotted(draws, 7, members=4).collect()}  # three levels of groups
    assert {s: x[-1] for s, x in stops.items()} == {s: q for s, q in quotas.items() if q}
    counts = {s: [b - a for a, b in zip([0, *x], x)] for s, x in stops.items()}
    assert all(n >= 0 for c in counts.values() for n in c)
    total = sum(quotas.values())
    assert [sum(c[r] for c in counts.values()) for r in range(7)] == [total // 7 + (r < total % 7) for r in range(7)]


def test_main_path_has_no_python(spark, odd):
    plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
