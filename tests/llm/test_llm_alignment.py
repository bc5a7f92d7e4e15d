"""Alignment of two tokenizers against a plain loop over single texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from starfold.llm import alignment
from starfold.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["a  b's\n", "  x", "x ▁y", "<|endoftext|> </s>", " ", "ﬁ Å\ttab\r\n  end  ", "naïve café’s 123,456 日本語 😀", "<0x41><unk>", "a\u0000b", "\n\n  \n a"]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def ends(tokens):
    place, out = 0, []
    for token in tokens:
        place += len(token)
        out.append(place)
    return out


def groups_of(text, tokenizers):
    """Lists of A ids and of B ids between common borders."""
    first, second = tokenizers
    letters = byte_letters()
    if not text:
        return []
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    end_a, end_b = ends(bytes_a), ends(bytes_b)
    out, i, j = [], 0, 0
    for cut in sorted(set(end_a) & set(end_b)):
        k, l = end_a.index(cut) + 1, end_b.index(cut) + 1
        out.append((a[i:k], b[j:l]))
        i, j = k, l
    return out


def expected(rows, tokenizers):
    docs = [(i, groups_of(text, tokenizers)) for i, text in rows]
    counts = Counter((b[-1], a[-1]) for _, groups in docs for a, b in groups)
    highest = {}
    for (b, _), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for i, groups in docs:
        links = [(b[-1], a[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[x] == highest[x[0]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_alignment_is_that_of_a_plain_loop(spark, odd, odd_rows, tokenizers):
    rows = [(r[0], r[1]) for r in odd_rows] + [(1_000 + i, t) for i, t in enumerate(HARD)]
    docs = odd.select("doc_id", "text", "part", "key").unionByName(spark.createDataFrame(list(enumerate(HARD, 1_000)), "doc_id long, text string"), allowMissingColumns=True)
    # small batches and parts, so that every radix has several runs in several parts
    found = alignment.align(docs, A, B, radixes=3, batch_bytes=1 << 12, part_bytes=1 << 12)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected(rows, tokenizers), key=key)


def test_no_rows_and_only_texts_without_tokens(spark, empty):
    assert alignment.align(empty, A, B).count() == 0
    found = alignment.align(spark.createDataFrame([(1, None), (1, None), (None, ""), (3, "▁")], "doc_id long, text string"), A, B).collect()
    assert sorted((r.doc_id or 0, *r[1:]) for r in found) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (0, 1, 1, 3)]


def test_merge_counts_each_pair_once_in_order():
    rng = np.random.default_rng(5)
    records = [(int(b), int(a), int(d)) for b, a, d in zip(rng.integers(0, 9, 4_000), rng.integers(0, 7, 4_000), rng.integers(0, 50, 4_000))]
    runs = []
    for begin in range(0, len(records), 700):
        keys = np.array([(b << alignment.A_BITS | a) << alignment.DOC_BITS | d for b, a, d in records[begin: begin + 700]])
        runs += [directory for radix, directory, _ in alignment.spilled(keys, 2) if radix == 1]
    b, a, n = alignment.merged(runs)
    counted = Counter((x, y) for x, y, _ in records if x % 2 == 1)
    assert list(zip(b.tolist(), a.tolist(), n.tolist())) == [(*pair, counted[pair]) for pair in sorted(counted)]


def test_a_hot_radix_has_more_parts(spark):
    runs = spark.createDataFrame([(i, 0 if i % 3 else 1, 1_000) for i in range(300)], "batch long, radix int, bytes long")
    shares, parts = alignment.dealt(runs, 4, 10_000)
    assert parts == [20, 10, 1, 1]
    assert shares.groupBy("radix", "part").count().agg({"count": "max"}).first()[0] < 30
