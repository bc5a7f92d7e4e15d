"""Rules, classifiers and scores: exact where they can be, else by held-out accuracy."""

import math
import os
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from conftest import words_of
from pyspark.sql import functions as F
from test_llm_words import brute_counts

from starfold.llm import cotraining, masked_lm, quality_rules, toxicity

FOLDER = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def auc(label, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    label = np.asarray(label)
    return (rank[label == 1].mean() - (label.sum() - 1) / 2) / (len(label) - label.sum())


# ---------------------------------------------------------------- quality rules

def brute_quality(rows, group_min):
    def bucket(x):
        shift = max(0, x.bit_length() - 5)
        return x >> shift << shift

    measured = []
    for row in rows:
        c = brute_counts(row[1])
        m = {"symbol_rate": c["n_symbols"] * 1000 // c["word_chars"] if c["word_chars"] else 0, "dup_line_rate": c["n_dup_lines"] * 1000 // c["n_lines"] if c["n_lines"] else 0,
             "repeat_rate": c["n_repeat_words"] * 1000 // c["n_words"] if c["n_words"] else 0, "word_length": c["word_chars"] * 100 // c["n_words"] if c["n_words"] else 0}
        measured.append((row, c, m, c["n_words"] < 50 or 2 * c["n_repeat_words"] > c["n_words"]))

    def quantiles(values):
        values = sorted(values)
        return [values[-(-len(values) * q // 100) - 1] for q in (25, 50, 75, 95)]

    result = []
    for row, c, m, failed in measured:
        kept = not failed
        for rule in quality_rules.MEASURES if kept else []:
            levels = [[bucket(o[2][rule]) for o in measured if not o[3] and same(o[0])]
                      for same in (lambda r: (r[2], r[3]) == (row[2], row[3]), lambda r: r[2] == row[2], lambda r: True)]
            wide = quantiles(levels[1] if len(levels[1]) >= group_min else levels[2])
            own = quantiles(levels[0]) if len(levels[0]) >= group_min else wide
            if rule in quality_rules.TAILS:
                kept = kept and m[rule] <= min(own[3], wide[3]) + quality_rules.TAILS[rule]
            else:
                reach = quality_rules.SPREADS * max(min(own[2] - own[0], wide[2] - wide[0]), quality_rules.FLOORS[rule])
                kept = kept and own[1] - reach <= m[rule] <= own[1] + reach
        result.append((row[0], *(c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, kept))
    return result


@pytest.mark.parametrize("group_min", [1, 12, 1000])
def test_quality_rules(odd, odd_rows, group_min):
    want = brute_quality(odd_rows, group_min)
    found = quality_rules.judge(odd, group_min=group_min).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    kept = quality_rules.keep(odd, group_min=group_min)
    assert kept.columns == odd.columns
    assert Counter(map(tuple, kept.collect())) == Counter(r for r, w in zip(odd_rows, want) if w[-1])


def fresh_words(n, start, length=5):
    return [("".join(chr(97 + (i // 26 ** k) % 26) for k in range(4)) + "n" * length)[:length] for i in range(start, start + n)]


def planted_rows():
    """Sixty plain documents of one group, and one for every rule that only this rule rejects."""
    plain = [(i, "\n".join(" ".join(fresh_words(20, 1000 * i + 20 * k)) for k in range(6))) for i in range(60)]
    symbols = " ".join(w + "#$%" * (k % 2) for k, w in enumerate(fresh_words(100, 70_000)))
    lines = "\n".join(" ".join(fresh_words(20, 80_000 + 20 * k)) + "\nsame line" for k in range(6))
    passage = fresh_words(45, 90_000)
    repeats = " ".join(passage + fresh_words(55, 91_000) + passage + fresh_words(55, 92_000))
    return plain, {100: ("symbol_rate", symbols), 101: ("dup_line_rate", lines), 102: ("repeat_rate", repeats), 103: ("word_length", " ".join(fresh_words(100, 95_000, 12)))}


def test_every_rule_rejects_its_planted_document(spark):
    plain, planted = planted_rows()
    rows = [(i, t, "en", "web", len(t)) for i, t in plain + [(i, t) for i, (_, t) in planted.items()]]
    found = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert {i: r["failed"] for i, r in found.items() if not r["kept"]} == {i: rule for i, (rule, _) in planted.items()}


def test_a_noisy_group_does_not_switch_its_rules_off(spark):
    """Half of one source repeats a good part of its lines; its language as a whole does not."""
    plain, planted = planted_rows()
    rows = [(10 * i + k, t, "en", f"s{k}", len(t)) for i, t in plain for k in range(4)]
    rows += [(10_000 + i, planted[101][1].replace("same", f"same{i}"), "en", "noisy", 1) for i in range(5)] + [(20_000 + i, t, "en", "noisy", len(t)) for i, t in plain[:5]]
    found = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), group_min=10)
    assert {r["doc_id"] for r in found.where("not kept").collect()} == {10_000 + i for i in range(5)}


def test_no_rows_to_judge(empty):
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.keep(empty).count() == 0


def test_sketches_merge(odd):
    rows = quality_rules.measure(odd).withColumns(quality_rules.rates())
    whole = quality_rules.sketch(rows)
    halves = quality_rules.sketch(rows.where("n_words % 2 = 0")).unionByName(quality_rules.sketch(rows.where("n_words % 2 = 1")))
    both = quality_rules.merged(halves, ["lang", "source"])
    assert Counter(map(tuple, both.select(whole.columns).collect())) == Counter(map(tuple, whole.collect()))


# ---------------------------------------------------------------- toxicity

def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 64, 65, 9, 0, 300]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    emission, moves = rng.normal(size=len(doc)) * 2, rng.normal(size=(2, 2))
    found = toxicity.marginals(emission, doc, len(sizes), moves)
    for d in (1, 2, 5):
        e = emission[doc == d]
        weight = {}
        for path in product((0, 1), repeat=len(e)):
            weight[path] = math.exp(sum(moves[a, b] for a, b in zip((0, *path), path)) + sum(x for x, y in zip(e, path) if y))
        total = sum(weight.values())
        want = [sum(w for p, w in weight.items() if p[t]) / total for t in range(len(e))]
        assert np.allclose(found[doc == d], want)
    e, want = emission[doc == 7], found[doc == 7]  # a long one, message by message
    forward = np.zeros((len(e), 2))
    now = np.array([1.0, 0.0])
    for t, x in enumerate(e):
        now = now @ np.exp(moves) * [1, math.exp(x)]
        now /= now.sum()
        forward[t] = now
    back = np.ones(2)
    for t in range(len(e) - 1, -1, -1):
        both = forward[t] * back
        assert np.isclose(want[t], both[1] / both.sum())
        back = np.exp(moves) @ (back * [1, math.exp(e[t])])
        back /= back.sum()


def test_a_field_learns_runs():
    rng = np.random.default_rng(3)
    label = (rng.random((200, 20)) < 0.2).astype(np.int64)
    where = np.stack([np.where(label == 1, 5, rng.integers(10, 60, label.shape)), rng.integers(100, 900, label.shape)], axis=2)
    field = toxicity.fit_field(where.astype(np.int32), label, np.ones(label.shape, bool))
    assert field.weights[5] > 1 and field.weights[10:60].mean() < 0


def test_all_tokens_of_the_training_texts_have_slopes(odd, odd_rows, spark):
    """Windows cover every word once, and slopes summed by Spark are those of all windows together, and of the likelihood."""
    rows = odd.select("doc_id", "text", F.coalesce((F.col("doc_id") % 2).cast("int"), F.lit(0)).alias("label"))
    raw = np.frombuffer(b"the", np.uint8)
    chosen = np.unique(toxicity._beginnings(toxicity.token_features(raw, toxicity.W.split(raw, np.array([0, 3])))))
    windows = toxicity.training_windows(rows, chosen)
    table = windows.toArrow()
    where, label, mask, before = toxicity._padded(table)
    assert mask.sum() == sum(len(words_of(r[1])) for r in odd_rows)
    held = {r[0]: r for r in odd_rows if "the " in (r[1] or "") and r[0] is not None}
    assert label.sum() == sum(90 * (i % 2) for i in held) and ((before == 1) == ((label[:, 0] == 1) & (before == 1))).all()
    rng = np.random.default_rng(8)
    field = toxicity.Field(rng.normal(0, 0.1, 1 << toxicity.FEATURE_BITS), np.array([[0.3, -0.5], [0.2, 0.1]]))
    up, turns = toxicity.slopes_of_all(windows, field)
    want = toxicity.summed_slopes(where, label, mask, before, field.weights, field.moves)
    assert np.allclose(up, want[0]) and np.allclose(turns, want[1])

    def likelihood(moves, weights):
        total = 0.0
        for f, y, m, b in zip(where[:9], label[:9], mask[:9], before[:9]):
            path, free, last = 0.0, np.where(np.arange(2) == b, 0.0, -np.inf), b
            for t in np.flatnonzero(m):
                e = np.array([0.0, weights[f[t]].sum()])
                path += moves[last, y[t]] + e[y[t]]
                free = np.array([np.logaddexp(*(free + moves[:, j])) for j in (0, 1)]) + e
                last = y[t]
            total += path - np.logaddexp(*free)
        return total

    up, turns = toxicity.summed_slopes(where[:9], label[:9], mask[:9], before[:9], field.weights, field.moves)
    step = np.zeros((2, 2))
    step[1, 0] = step[0, 1] = 1e-5
    assert np.isclose((likelihood(field.moves + step, field.weights) - likelihood(field.moves - step, field.weights)) / 2e-5, turns[1, 0] + turns[0, 1], atol=1e-4)
    slot = np.argmax(np.abs(up))
    bump = np.zeros_like(field.weights)
    bump[slot] = 1e-5
    assert np.isclose((likelihood(field.moves, field.weights + bump) - likelihood(field.moves, field.weights - bump)) / 2e-5, up[slot], atol=1e-4)


@pytest.fixture(scope="module")
def toxic_labels(spark, odd_rows):
    rows = [(r[0], int("the " in (r[1] or ""))) for r in odd_rows if r[0] is not None] + [(10, None), (None, 1), (77777, 1)]
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_slopes_reach_the_driver_packed(spark, monkeypatch):
    """A row a partition, and not one for every slot."""
    windows = spark.createDataFrame([(np.arange(8 * i, 8 * i + 8, dtype=np.int32).tobytes(), b"\x01", 0) for i in range(200)],
                                    "features binary, labels binary, before int").repartition(4)
    kind, counts = type(windows), []
    collect = kind.collect

    def counted(df):
        rows = collect(df)
        counts.append(len(rows))
        return rows

    monkeypatch.setattr(kind, "collect", counted)
    monkeypatch.setattr(kind, "toPandas", lambda df: pytest.fail("rows become objects in the driver"))
    up, turns = toxicity.slopes_of_all(windows, toxicity.Field(np.zeros(1 << toxicity.FEATURE_BITS, np.float32), np.zeros((2, 2))))
    assert np.allclose(up[:1600], 0.5) and not up[1600:].any() and turns.shape == (2, 2)
    assert counts and max(counts) <= 8
    numbers = toxicity.numbers_of(spark.createDataFrame([(i, i / 3) for i in range(5000)], "a int, b double").repartition(3))
    assert sorted(zip(numbers[0].tolist(), numbers[1].tolist())) == [(i, i / 3) for i in range(5000)]


def test_toxicity_of_odd_rows(odd, empty, odd_rows, toxic_labels, spark):
    found = toxicity.judge(odd, toxic_labels).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert toxicity.judge(empty, toxic_labels).count() == 0
    assert {r["score"] for r in toxicity.judge(odd, toxic_labels.limit(0)).collect()} == {toxicity.Model(None, np.array([-30.0, 0, 0])).score(np.zeros((1, 2)))[0]}
    model = toxicity.train(odd, toxic_labels)
    kept = toxicity.keep(odd, model)
    assert kept.columns == odd.columns
    clean = Counter(r["doc_id"] for r in found if r["score"] < 0.5)
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == clean


def test_spans_are_character_places(spark):
    raw = np.frombuffer("bäd".encode(), np.uint8)
    weights = np.zeros(1 << toxicity.FEATURE_BITS, np.float32)
    weights[toxicity.slots(toxicity.token_features(raw, toxicity.W.split(raw, np.array([0, 4]))))] = 3
    model = toxicity.Model(toxicity.Field(weights, np.array([[1.0, -1.0], [1.0, -1.0]])), np.array([-1.0, 1.0, 1.0]))
    docs = spark.createDataFrame([(1, "É so  bäd bäd  ok\nbäd"), (2, None), (3, ""), (4, "so ok")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert [tuple(s) for s in found[1]["spans"]] == [(6, 13), (18, 21)]
    assert found[2]["spans"] == found[3]["spans"] == found[4]["spans"] == []
    assert found[1]["score"] > 0.5 > found[4]["score"] and found[2]["score"] == found[3]["score"]


@needs_tables
def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = toxicity.judge(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "score", "spans").collect()
    assert auc([r[0] for r in rows], [r[1] for r in rows]) > 0.9
    clean = [r for r in rows if r[0] == 0]
    assert sum(r[1] >= 0.5 for r in clean) <= 0.02 * len(clean)


# ---------------------------------------------------------------- co-training

def two_views(spark, n=1200, width=30):
    """Texts of four words and a language and source, each of a class of its own; nothing else tells the classes apart."""
    rng = np.random.default_rng(6)
    truth = rng.integers(0, 2, n)
    rows = []
    for i, c in enumerate(truth.tolist()):
        words = " ".join(f"{'pq'[c]}{chr(97 + w % 26)}{chr(97 + w // 26)}x" for w in rng.choice(width, 4, replace=False))
        rows.append((i, words, f"l{c}{rng.integers(0, width)}", f"s{c}{rng.integers(0, width)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    return docs, spark.createDataFrame([(i, int(truth[i])) for i in range(30)], "doc_id long, quality int"), truth


def test_views_teach_each_other(spark):
    """The labelled rows show each view few of its features; only the documents without labels tie the rest together."""
    docs, labels, truth = two_views(spark)

    def right(rounds):
        model = cotraining.train(docs, labels, rounds=rounds)
        return np.mean([r["predicted"] == truth[r["doc_id"]] for r in cotraining.score(docs, model).collect()])

    alone, taught = right(1), right(5)
    assert taught >= alone and taught > 0.95


def test_surest_of_each_group(spark):
    docs, _, _ = two_views(spark)
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise("s")).withColumn("lang", F.lit(None).cast("string"))
    rng = np.random.default_rng(1)
    views = tuple(cotraining.View(rng.normal(size=(1 << cotraining.BITS) + 1), np.ones((1 << cotraining.BITS) + 1)) for _ in (0, 1))
    found = {r["of_source"]: r for r in cotraining.limits(cotraining.featured(docs), views, 0.1).collect()}
    rows = docs.toArrow()
    odds = [cotraining.decide(cotraining.content(rows["text"]), views[0].weights), cotraining.decide(cotraining.page(rows["text"], rows["lang"], rows["source"]), views[1].weights)]
    assert set(found) == {None, "s"}
    for source, row in found.items():
        mine = np.array([s == source for s in rows["source"].to_pylist()])
        for v in (0, 1):
            bucket = cotraining.buckets(odds[v][mine])
            values = np.unique(bucket)
            low = [b for b in values if (bucket <= b).sum() <= 0.1 * len(bucket)]
            high = [b for b in values if (bucket >= b).sum() <= 0.1 * len(bucket)]
            assert row[f"low{v}"] == (max(low) if low else values[0]) and row[f"high{v}"] == (min(high) if high else values[-1])


def test_all_documents_are_named(spark):
    """Every sure document beyond its group's limits teaches the other view, labelled ones excepted; the number grows with the table."""
    docs, _, _ = two_views(spark)
    docs = docs.withColumn("lang", F.lit("l")).withColumn("source", F.lit("s"))
    rng = np.random.default_rng(2)
    views = tuple(cotraining.View(8 * rng.normal(size=(1 << cotraining.BITS) + 1), np.ones((1 << cotraining.BITS) + 1)) for _ in (0, 1))
    counts = []
    for copies in (1, 3):
        many = docs.withColumn("doc_id", F.explode(F.array(*(F.col("doc_id") + 10_000 * i for i in range(copies)))))
        many = cotraining.featured(many)
        taught = cotraining.name(many, views, cotraining.limits(many, views, 0.1), np.arange(50))
        counts.append({r["label1"]: r["count"] for r in taught.groupBy("label1").count().collect()})
    rows = docs.toArrow()
    odds = cotraining.decide(cotraining.content(rows["text"]), views[0].weights)
    bucket = cotraining.buckets(odds)
    high = min(b for b in np.unique(bucket) if (bucket >= b).sum() <= 0.1 * len(bucket))
    beyond = (bucket >= high) & (odds > cotraining.SURE)
    assert counts[0][1] == (beyond & (rows["doc_id"].to_numpy() >= 50)).sum()
    assert counts[1][1] == 3 * beyond.sum() - (beyond & (rows["doc_id"].to_numpy() < 50)).sum()


def test_summed_slopes_are_those_of_one_table(spark):
    docs, labels, truth = two_views(spark)
    rows = docs.where("doc_id < 400").toArrow().sort_by("doc_id")
    stored = [cotraining.content(rows["text"]), cotraining.page(rows["text"], rows["lang"], rows["source"])]
    columns = dict(zip(("f0", "n0", "f1"), cotraining._stored(cotraining.content_counts(rows["text"]), stored[1])))
    label = truth[:400].astype(np.int32)
    taught_label = np.where(np.arange(300) % 3 == 0, -1, label[100:]).astype(np.int32)
    sample = spark.createDataFrame(pa.table({"label": label[:100], **{k: a.slice(0, 100) for k, a in columns.items()}})).repartition(2)
    taught = spark.createDataFrame(pa.table({"label0": taught_label, "label1": label[100:], **{k: a.slice(100) for k, a in columns.items()}})).repartition(5)
    found = cotraining.teach(sample, taught, (cotraining.untaught(), cotraining.untaught()), steps=2)
    for v, given in ((0, np.concatenate([label[:100], taught_label])), (1, label)):
        share = np.zeros(400)
        for part in (slice(0, 100), slice(100, 400)):
            for c in (0, 1):
                hit = np.flatnonzero(given[part] == c) + part.start
                share[hit] = 0.25 / len(hit)
        view = cotraining.untaught()
        for _ in range(2):
            view = cotraining.stepped(view, cotraining.slopes(stored[v], given, share, view.weights))
        assert np.allclose(view.weights, found[v].weights, atol=1e-3)


def test_quality_of_odd_rows(odd, empty, odd_rows, spark):
    labels = spark.createDataFrame([(r[0], int("#" not in (r[1] or ""))) for r in odd_rows if r[0] is not None] + [(10, None), (None, 1)], "doc_id long, quality int")
    found = cotraining.judge(odd, labels).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert cotraining.judge(empty, labels).count() == 0
    assert {r["score"] for r in cotraining.judge(odd, labels.limit(0)).collect()} == {0.5}


@needs_tables
def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = cotraining.judge(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("quality", "score").collect()
    assert auc([r[0] for r in rows], [r[1] for r in rows]) > 0.97
    good = [r for r in rows if r[0] == 1]
    assert sum(r[1] >= 0.5 for r in good) >= 0.98 * len(good)


# ---------------------------------------------------------------- language model

def test_neighbourhood():
    around = masked_lm.neighbourhood(np.array([1, 2, 3, 4]), np.array([0, 0, 0, 1]))
    end = masked_lm.VOCABULARY
    assert around.tolist() == [[end, end, 2, 3], [end, 1, 3, end], [1, 2, end, end], [end] * 4]


def test_probabilities_add_up():
    network = masked_lm.Network()
    network.class_bias += np.linspace(-1, 1, masked_lm.CLASSES).astype(np.float32)
    around = np.tile([[3, 9, 4, masked_lm.VOCABULARY]], (masked_lm.VOCABULARY, 1))
    total = np.exp(network.log_probability(around, np.arange(masked_lm.VOCABULARY))).sum()
    assert abs(total - 1) < 1e-5


def test_gradient_steps_learn_both_sides():
    rng = np.random.default_rng(8)
    left = rng.integers(0, 40, 20_000)
    token = np.where(rng.random(20_000) < 0.5, left, 700)  # the left neighbour, or one that is always the same
    around = np.stack([rng.integers(0, 40, 20_000), left, rng.integers(0, 40, 20_000), np.full(20_000, masked_lm.VOCABULARY)], axis=1)
    network = masked_lm.Network()
    before = network.log_probability(around, token).mean()
    for _ in range(3):
        network.learn(around, token)
    after = network.log_probability(around, token).mean()
    assert before < -6 and after > -1.6  # the best possible is about -0.7, without context about -2.5


def test_every_word_is_predicted_once(odd, odd_rows, monkeypatch):
    hashed, doc, _ = masked_lm.word_hashes(pa.array([r[1] for r in odd_rows]))
    places = [masked_lm.masked(hashed, doc, r, masked_lm.MASK_ONE_OF) for r in range(masked_lm.ROUNDS)]
    assert np.array_equal(np.sort(np.concatenate(places)), np.arange(len(hashed)))
    whole, trained = masked_lm._averaged, []

    def counted(found):
        trained.append(found.agg(F.sum("n")).first()[0])
        return whole(found)

    monkeypatch.setattr(masked_lm, "_averaged", counted)
    masked_lm.train(odd)
    assert sum(trained) == sum(len(words_of(r[1])) for r in odd_rows)


def test_scores_of_odd_rows(odd, empty, odd_rows):
    found = masked_lm.score_all(odd).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in found) == Counter((r[0], len(words_of(r[1]))) for r in odd_rows)
    for r in found:
        assert (r["per_token"] is None) == (r["n_tokens"] == 0)
        assert r["n_tokens"] == 0 and r["log_likelihood"] == 0 or abs(r["per_token"] * r["n_tokens"] - r["log_likelihood"]) < 1e-6
    assert masked_lm.score_all(empty).count() == 0


def test_scores_are_those_of_a_plain_loop(spark, monkeypatch):
    """Every word has a probability of its own: with few own tokens, nearly all words are in buckets."""
    monkeypatch.setattr(masked_lm, "BATCH_DOCS", 7)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(3_000)]
    texts = [" ".join(words[int(3_000 * x ** 2)] for x in rng.random(rng.integers(0, 90))) for _ in range(120)] + [None, "", " \t", "w1 " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string").repartition(3)
    network, known = masked_lm.train(docs)
    got = sorted((r.doc_id, r.n_tokens, r.log_likelihood) for r in masked_lm.score(docs, network, known, part_bytes=1 << 10).collect())
    counts = Counter(w for t in [*texts, texts[3]] for w in words_of(t))
    hashes = {w: int(masked_lm.word_hashes(pa.array([w]))[0][0]) for w in counts}
    own = dict(zip(known.own.tolist(), known.numbers.tolist()))
    assert len(own) == masked_lm.OWN
    bucket = Counter()
    for w, n in counts.items():
        if hashes[w] not in own:
            bucket[hashes[w] % masked_lm.BUCKETS] += n
    assert len([w for w in counts if hashes[w] not in own]) > 100
    for number, n_tokens, likelihood in got:
        mine = words_of(texts[number])
        token = [own.get(hashes[w], masked_lm.OWN + hashes[w] % masked_lm.BUCKETS) for w in mine]
        total = 0.0
        for place, w in enumerate(mine):
            around = [token[place + side] if 0 <= place + side < len(mine) else masked_lm.VOCABULARY for side in masked_lm.SIDES]
            total += float(network.log_probability(np.array([around]), np.array([token[place]]))[0])
            if hashes[w] not in own:
                total += np.log(counts[w] / bucket[hashes[w] % masked_lm.BUCKETS])
        assert n_tokens == len(mine) and likelihood == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_an_invented_word_is_less_likely_than_one_of_its_bucket(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 2_000, 400))) for i in range(60)], "doc_id long, text string")
    network, known = masked_lm.train(docs)
    shared = [w for w in (f"w{i}" for i in range(2_000)) if int(masked_lm.word_hashes(pa.array([w]))[0][0]) not in known.own.tolist()]
    place = {int(masked_lm.word_hashes(pa.array([w]))[0][0]) % masked_lm.BUCKETS: w for w in shared}
    invented = next(w for w in (f"zz{i}" for i in range(10_000)) if int(masked_lm.word_hashes(pa.array([w]))[0][0]) % masked_lm.BUCKETS in place)
    usual = place[int(masked_lm.word_hashes(pa.array([invented]))[0][0]) % masked_lm.BUCKETS]
    rows = spark.createDataFrame([(1, usual), (2, invented)], "doc_id long, text string")
    score = {r.doc_id: r.log_likelihood for r in masked_lm.score(rows, network, known).collect()}
    assert score[2] < score[1] - 0.5


@needs_tables
def test_context_beats_counts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    network, words = masked_lm.train(docs.where("doc_id % 5 != 0"))
    test = docs.where("doc_id % 5 = 0").select("text").toPandas()["text"]
    hashed, doc, _ = masked_lm.word_hashes(pa.array(test))
    token = words.tokens(hashed)
    share = (np.bincount(token, minlength=masked_lm.VOCABULARY) + 1) / (len(token) + masked_lm.VOCABULARY)
    assert network.log_probability(masked_lm.neighbourhood(token, doc), token).mean() > np.log(share)[token].mean()
    # the same words in another order are less likely
    shuffled = np.random.default_rng(1).permutation(token)
    assert network.log_probability(masked_lm.neighbourhood(token, doc), token).mean() > network.log_probability(masked_lm.neighbourhood(shuffled, doc), shuffled).mean()
