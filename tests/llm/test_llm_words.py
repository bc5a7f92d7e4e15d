"""Words, hashes and counts of texts against plain Python."""

from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import words_of
from hypothesis import given, settings
from hypothesis import strategies as st

from starfold.llm import words as W
from starfold.llm.quality_rules import COUNTS, SYMBOLS, count_texts

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abé漢 \t\n#|\x1c\x85", max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    data, borders = W.text_bytes(pa.array(texts, pa.string()))
    words = W.split(data, borders)
    raw = data.tobytes()
    found = [[raw[words.begin[i]: words.end[i]].decode() for i in range(words.first[d], words.first[d + 1])] for d in range(len(texts))]
    assert found == [words_of(t) for t in texts]
    hashed = W.hashes(data, words.begin, words.end)
    flat = [w for f in found for w in f]
    assert len(set(flat)) == len(set(hashed.tolist()))
    assert len({(w, h) for w, h in zip(flat, hashed.tolist())}) == len(set(flat))


def brute_counts(text):
    words = words_of(text)
    triples = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {p for i, t in enumerate(triples) if often[t] > 1 for p in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if words_of(line)]
    return dict(zip(COUNTS, (len(words), sum(map(len, words)), sum((text or "").count(s) for s in SYMBOLS), len(lines), len(lines) - len(set(lines)), len(covered))))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_counts(texts):
    counts = count_texts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert {c: int(counts[c][i]) for c in COUNTS} == brute_counts(text)


def test_chunks_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 50, 3, 3)] + [None])], ["text"])
    parts = list(W.chunks(batch, size=8))
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert list(W.chunks(batch.slice(0, 0))) == []


def test_windows_stay_in_their_document():
    found, at = W.windows(np.arange(6, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 2]), 2)
    assert at.tolist() == [0, 1, 3] and len(set(found.tolist())) == 3
