"""Similarity join, repeats and components against brute force."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import words_of

from starfold.llm import components, ngram_join, repeats


def brute_join(rows, k, percent):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for row in rows:
        words = words_of((row[1] or "").translate(lower))
        sets.append(frozenset(tuple(words[i: i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(row[0], least.get(root(i), row[0]))
    return [(row[0], len(s), least.get(root(i)) if s else row[0]) for i, (row, s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("k, percent, few, cell", [(3, 90, 128, 1 << 23), (5, 80, 2, 4000), (2, 60, 4, 20_000), (1, 100, 1, 1000)])
def test_join(odd, odd_rows, k, percent, few, cell):
    found = ngram_join.join(odd, k, percent, few=few, cell_bytes=cell).collect()
    assert sorted((tuple(r)[:3] for r in found), key=str) == sorted(brute_join(odd_rows, k, percent), key=str)


def test_one_row_of_each_component_stays(odd, odd_rows):
    left = ngram_join.unique(odd, 5, 80)
    assert left.columns == odd.columns
    want = {(c, n > 0) for i, n, c in brute_join(odd_rows, 5, 80)}
    found = ngram_join.join(odd, 5, 80).where("is_first").select("component_id", "n_shingles").collect()
    assert {(r[0], r[1] > 0) for r in found} == want
    kept = [r["doc_id"] for r in left.collect()]
    assert {c for i, n, c in brute_join(odd_rows, 5, 80) if n} <= set(kept)


def test_repeated_rows_stay_once(spark, odd, odd_rows):
    """Counts of rows, not sets of ids: repeated rows, copies without an id, and rows without words."""
    first, second = "one text that many rows hold, each of them without an id", "another text of a row that comes again and again"
    rows = ([(None, first, "x")] * 40 + [(7, second, "x")] * 30 + [(7, second, "y")] * 3 + [(8, second, "x"), (None, second, "x"), (9, None, "x"), (9, None, "x"), (9, "", "x")]
            + [(None, None, "x")] * 5 + [(7, "a text of its own under an id that others have", "x")] * 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    left = ngram_join.unique(docs, 5, 80)
    assert left.columns == docs.columns
    want = [(None, first), (7, second), (9, None), (9, ""), (None, None), (7, "a text of its own under an id that others have")]
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(want)
    found = ngram_join.join(odd, 5, 80).where("is_first").select("doc_id", "text_hash").distinct().count()
    kept = ngram_join.unique(odd, 5, 80).collect()
    assert len(kept) == found and set(map(tuple, kept)) <= set(odd_rows)


def test_join_nothing(empty):
    assert ngram_join.join(empty).count() == 0
    assert ngram_join.unique(empty).count() == 0


def test_order_of_shingles_changes_no_result(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "SAMPLE_ONE_OF", 1)
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", 2)
    found = ngram_join.join(odd, 3, 70).collect()
    assert sorted((tuple(r)[:3] for r in found), key=str) == sorted(brute_join(odd_rows, 3, 70), key=str)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2080)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {(x, root(x)) for x in parent if root(x) != x}
    assert {tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_remove(rows, length):
    places = {}
    low = -(1 << 63)
    all_words = [(low if r[0] is None else r[0], words_of(r[1])) for r in rows]
    for doc, words in all_words:
        for i in range(len(words) - length + 1):
            key = tuple(words[i: i + length])
            places[key] = min(places.get(key, (doc, i)), (doc, i))
    result = []
    for row, (doc, words) in zip(rows, all_words):
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if places[tuple(words[i: i + length])] < (doc, i):
                gone[i: i + length] = [True] * length
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        result.append((row[0], len(words), sum(gone), kept))
    return result


@pytest.mark.parametrize("length, part_bytes, split", [(20, 8 << 20, False), (20, 2000, True), (7, 5000, False), (5, 3000, True)])
def test_remove(odd, odd_rows, length, part_bytes, split, monkeypatch):
    if split:
        monkeypatch.setattr(repeats, "SAMPLE_ONE_OF", 1)
        monkeypatch.setattr(repeats, "SPLIT_FROM", 2)
    want = brute_remove(odd_rows, length)
    found = repeats.remove(odd, length, digest=True, part_bytes=part_bytes).collect()
    assert sorted(map(tuple, found), key=str) == sorted(((i, n, r, hashlib.sha256(t.encode()).hexdigest()) for i, n, r, t in want), key=str)
    cut = repeats.remove(odd, length, part_bytes=part_bytes)
    assert cut.columns == odd.columns + ["n_words", "n_removed"]
    expected = [(row[0], row[1] if r == 0 else t, row[2], n, r) for row, (_, n, r, t) in zip(odd_rows, want)]
    assert sorted(map(tuple, cut.select("doc_id", "text", "lang", "n_words", "n_removed").collect()), key=str) == sorted(expected, key=str)


def test_remove_nothing(empty, odd):
    assert repeats.remove(empty).count() == 0
    assert repeats.remove(empty, digest=True).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    with pytest.raises(ValueError):
        repeats.remove(odd.withColumnRenamed("key", "n_words"))


def test_tree_marks_all_but_the_earliest():
    import numpy as np

    words = np.arange(30, dtype=np.uint64) + np.uint64(7)
    rows = pa.table({"doc_id": [5, 3, 9], "start": [0, 4, 2], "words": [words[:22].tobytes(), words[2:24].tobytes(), words[20:].tobytes() + words[:10].tobytes()]})
    assert repeats.marked(rows, 20).tolist() == [0b100, 0, 0]


def test_frequent_shingles_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", 30)
    rows = [(i, f"common words here own{i} more{i} last{i}" if i < 30 else f"a{i} b{i} c{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    value, count = ngram_join.frequent_shingles(ngram_join._keyed(docs, "doc_id", "text"), 3)
    assert count.tolist() == [30]


def test_counters_keep_what_is_frequent():
    rng = np.random.default_rng(0)
    held = ngram_join.Counters(100)
    rows = np.concatenate([np.repeat(np.arange(5, dtype=np.uint64), 400), rng.integers(1_000, 1 << 60, 8_000).astype(np.uint64)])
    for part in np.array_split(rng.permutation(rows), 50):
        held.add(part)
    counts = dict(zip(held.value.tolist(), held.count.tolist()))
    assert len(counts) <= 200
    assert all(400 - len(rows) / 100 <= counts.get(v, 0) <= 400 for v in range(5))


def test_a_part_is_looked_at_in_pieces_of_256_kb():
    rows = pa.table({"doc_id": list(range(200)), "text": ["word " * 2_000] * 198 + [None, "long " * 100_000]})
    pieces = list(repeats._pieces(rows))
    assert [i for piece in pieces for i in piece.column("doc_id").to_pylist()] == list(range(200))
    assert all(piece.num_rows == 1 or sum(len(t or "") for t in piece.column("text").to_pylist()) <= 256 << 10 for piece in pieces)


def test_prefixes_do_not_stay_on_disk(spark):
    import os

    from starfold.session import new_folder

    new_folder(spark, "any")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "something else that is short"), (4, None), (4, text)], "doc_id long, text string")
    out = ngram_join.join(docs)
    made = set(os.listdir(shared)) - before
    assert any(f.startswith("narrowed-") for f in made) and not any(f.startswith(("sets-", "groups-")) for f in made)
    assert sorted((r.doc_id, r.component_id, r.is_first) for r in out.collect()) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 1, False), (4, 4, True)]
