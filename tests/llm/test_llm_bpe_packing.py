"""Tokens against the tokenizers library, and packing against its rules."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starfold.llm import bpe, packing

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", "   ", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ", "don't I'LL we've 'something 'S", "été", "x\x1cy\x1dz", "½²Ⅻ ①a1b2", "漢字 日本語", "👍🏽 👨‍👩‍👧", "\x00\x01 a​b",
        "ẞßſ  \n\n x", "a" * 300, "﻿hi", "ǅ ﬁ Å", "<|endoftext|>", "a \x85 b\xa0c  d", " ʰʱ x", " \n", "\n ", " \n a\n  \t b  ", "×÷ a×b", "ɏ ǅx", "thethethe" * 20]


def noise(n):
    rng = random.Random(1)
    for alphabet in ("abcdefgh'éàü0123 .,-_日ж\n\t  ", "ab é1 .\n\t  ×", "thean ing"):
        yield from ("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n))


def test_backtracking_equals_the_library():
    texts = HARD + list(noise(1500))
    library, codec = Tokenizer.from_file(WORD_FILE), bpe.text_codec(WORD_FILE)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert codec.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_every_token_of_the_vocabulary():
    library, codec = Tokenizer.from_file(WORD_FILE), bpe.text_codec(WORD_FILE)
    texts = [t.removesuffix("</w>") for t in codec.codec.vocab]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == want.ids


def test_round_trip_query(odd, empty, odd_rows):
    library = Tokenizer.from_file(WORD_FILE)
    want = []
    for row in odd_rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(odd, WORD_FILE).collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trip(empty, WORD_FILE).count() == 0
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd.where("doc_id < 30"), WORD_FILE), WORD_FILE).collect()}
    assert decoded == {r[0]: library.decode(library.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in odd_rows if r[0] is not None and r[0] < 30}


def test_words_of_plain_texts_equal_the_library():
    texts = HARD + list(noise(1500))
    library, tokens = Tokenizer.from_file(BYTE_FILE), packing.tokens_of(BYTE_FILE)
    found = tokens.encode_all(pa.array(texts))
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("capacity, block_pieces", [(64, 40), (2048, 8192)])
def test_packing(odd, odd_rows, capacity, block_pieces):
    library = Tokenizer.from_file(BYTE_FILE)
    want = []
    for row in odd_rows:
        ids = np.array(library.encode(row[1] or "", add_special_tokens=False).ids + [0], "<u4")
        first = (len(ids) - 1) % capacity + 1
        for number, part in enumerate(np.split(ids, range(first, len(ids), capacity))):
            start = 0 if number == 0 else first + (number - 1) * capacity
            want.append((row[0], number, start, len(part), zlib.crc32(part.tobytes())))
    found = packing.pack(odd, BYTE_FILE, capacity, block_pieces, islands=3, epochs=3).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        place = 0
        for offset, length in sorted(pieces):
            assert offset == place
            place += length
        assert place <= capacity
    total = sum(w[3] for w in want)
    blocks = -(-sum(w[3] < capacity for w in want) // block_pieces)
    assert len(bins) <= total / capacity * 1.12 + blocks


def test_packing_nothing(empty):
    assert packing.pack(empty, BYTE_FILE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, BYTE_FILE, capacity=0)


def test_genetic_operators():
    rng = np.random.default_rng(4)
    lengths = sorted(rng.integers(1, 100, 300).tolist(), reverse=True)
    a, b = packing.seeds(lengths, 100, 2, rng)
    for bins in (a, packing.crossover(a, b, lengths, 100, rng), packing.mutate(b, lengths, 100, rng)):
        assert sorted(i for x in bins for i in x) == list(range(300))
        assert max(sum(lengths[i] for i in x) for x in bins) <= 100
    best = packing.evolve([b], lengths, 100, 6, 4, rng)[0]
    assert len(best) <= len(b)
    assert packing.from_bytes(packing.to_bytes(a, 300)) == [sorted(x) for x in a]
    # four items fill each bin exactly: found although best fit alone may not
    assert len(packing.evolve(packing.seeds([60, 60, 40, 40, 30, 30, 20, 20], 100, 3, rng), [60, 60, 40, 40, 30, 30, 20, 20], 100, 20, 4, rng)[0]) == 3


def test_a_table_of_full_pieces_needs_no_block(spark, odd_rows):
    library = Tokenizer.from_file(BYTE_FILE)
    texts = [t for t in (r[1] for r in odd_rows) if len(library.encode(t or "", add_special_tokens=False).ids) % 8 == 7]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "doc_id long, text string").repartition(8)
    found = packing.pack(docs, BYTE_FILE, 8)
    rows = found.collect()
    assert len(rows) == len({r["sequence_id"] for r in rows}) and {(r["length"], r["offset"]) for r in rows} == {(8, 0)}
    # each row is placed where it lies: all tasks have some
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 0.5 * len(rows)


def test_a_hard_block_ends_below_best_fit():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(300, 900, 800).tolist(), reverse=True)
    best_fit = packing.packed(np.arange(800), lengths, 2048)
    start = packing.seeds(lengths, 2048, packing.POPULATION, np.random.default_rng(2))
    found = packing.evolve(start, lengths, 2048, packing.GENERATIONS * packing.EPOCHS, packing.POPULATION, np.random.default_rng(2))[0]
    assert sorted(i for b in found for i in b) == list(range(800))
    assert len(found) < len(best_fit)
