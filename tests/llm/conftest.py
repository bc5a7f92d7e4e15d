"""Tables for the operators' tests: odd rows, copies, near copies, shared passages, and no rows at all."""

import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, key string, block string, label string, c0 string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def make_rows(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(k):
        return " ".join(rng.choice(vocabulary) for _ in range(k))

    passage = prose(55)
    texts = [prose(rng.randint(1, 160)) for _ in range(n)]
    texts += [texts[3]] * 4 + [texts[5].upper()]  # copies
    base = prose(140).split()
    for _ in range(25):  # near copies
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [f"{prose(rng.randint(5, 40))} {passage} {prose(rng.randint(0, 40))}" for _ in range(12)]  # a passage that many share
    texts += ["the " * 90, "a b " * 60, "", " \t\n ", "x", "Two words", None, None, "\n".join([prose(12)] * 8), "## $$ " * 40 + prose(60)]
    texts.append(prose(6_000))  # long
    ids = list(range(10, 10 + len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in zip(ids, texts)]
    rows += [rows[4], rows[4]]  # the same row again
    rows += [(None, texts[7], "en", "a", 1), (None, "no id here", None, None, None)]
    # an id that several texts have, with passages in the same places
    rows += [(500, f"{passage} {prose(30)}", "en", "a", 1), (500, f"{passage} {prose(30)}", "en", "b", 1), (None, f"{passage} {prose(9)}", "fr", "a", 2)]
    return [r + ("p", "k", "b", "l", "c", "r") for r in rows]


@pytest.fixture(scope="session")
def odd_rows():
    return make_rows()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
