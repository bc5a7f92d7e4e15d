"""Scores documents by masked pseudo-likelihood.

A small network predicts each word from the two words on either side: the context words' vectors, one
table per place, add up to a hidden layer, and a two-level softmax gives the word's class and the word
in its class. It is written in numpy. The network's tokens come from counts over all documents: the most
frequent words are tokens of their own, all others share buckets by hash. Those words still have a probability of
their own each, at any size of the corpus: that of the bucket, times the word's share of all its bucket's words. The
shares come from the counts of every word, which grow with the corpus and are never held whole: tasks spill the
words of their documents as zstd runs by word, each part of the runs meets the counts of its words, and sums per
document go back.

Training reads all documents in rounds. In each round every partition starts from the common network
and learns from its own masked words, one of ``MASK_ONE_OF``, other ones each round, so that after all rounds every word of
every document has been predicted; the networks are then averaged, weighted
by their words, in groups until one is left. A document's score is the sum of the log-probabilities of
all its words.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .alignment import PART_BYTES, dealt, packed, unpacked
from .common import id_and_text, none_of, written

CLASSES = 32
MEMBERS = 32
VOCABULARY = CLASSES * MEMBERS
OWN = 768
#: Buckets of all other words, a power of two.
BUCKETS = VOCABULARY - OWN
WIDTH = 24
SIDES = (-2, -1, 1, 2)
MASK_ONE_OF = 2
ROUNDS = 2
BATCH = 2_048
#: Steps of the training over documents are taken over more words; they cost less a word.
TRAINED_AT_ONCE = 8_192
#: Texts that go through the network together; the work per class is worth more of them.
CHUNK_BYTES = 2 << 20
RATE = 0.15
AVERAGED_AT_ONCE = 32
#: Runs of words by the top bits of their hash, from so much text or so many documents at a time.
RADIX_BITS = 6
BATCH_BYTES = 8 << 20
BATCH_DOCS = 1 << 14

SPILLED = ("batch long, radix int, bytes long, words binary, postings binary, doc int, doc_id long, n_tokens long, log_likelihood double")
RESULT = "doc_id long, n_tokens long, log_likelihood double, per_token double"


class Network:
    """Tables of context vectors, classes and members, in single precision."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.context = (rng.normal(size=(len(SIDES), VOCABULARY + 1, WIDTH)) * 0.1).astype(np.float32)
        self.classes = (rng.normal(size=(WIDTH, CLASSES)) * 0.1).astype(np.float32)
        self.members = (rng.normal(size=(CLASSES, WIDTH, MEMBERS)) * 0.1).astype(np.float32)
        self.class_bias = np.zeros(CLASSES, np.float32)
        self.member_bias = np.zeros((CLASSES, MEMBERS), np.float32)

    NAMES = ("context", "classes", "members", "class_bias", "member_bias")

    def to_bytes(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, **{n: getattr(self, n) for n in self.NAMES})
        return file.getvalue()

    @classmethod
    def from_bytes(cls, stored: bytes) -> Network:
        network, held = cls.__new__(cls), np.load(io.BytesIO(stored))
        for name in cls.NAMES:
            setattr(network, name, held[name])
        return network

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.context[0][around[:, 0]]
        for p in range(1, len(SIDES)):
            total = total + self.context[p][around[:, p]]
        return np.tanh(total)

    def log_probability(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token given the four around it."""
        result = np.empty(len(token))
        order = np.argsort(token // MEMBERS, kind="stable")
        ends = np.searchsorted((token // MEMBERS)[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            for begin in range(ends[c], ends[c + 1], 65_536):
                rows = order[begin: min(begin + 65_536, ends[c + 1])]
                h = self.hidden(around[rows])
                first = h @ self.classes + self.class_bias
                second = h @ self.members[c] + self.member_bias[c]
                result[rows] = first[:, c] - _log_sum(first) + second[np.arange(len(rows)), token[rows] % MEMBERS] - _log_sum(second)
        return result

    def learn(self, around: np.ndarray, token: np.ndarray, batch: int = BATCH) -> None:
        """Steps of gradient descent over the given words, each weight with its own step size."""
        squares = {n: np.full_like(getattr(self, n), 1e-6) for n in self.NAMES}

        def step(name: str, slope: np.ndarray, where=slice(None)) -> None:
            squares[name][where] += slope ** 2
            getattr(self, name)[where] -= RATE * slope / np.sqrt(squares[name][where])

        for begin in range(0, len(token), batch):
            goal = token[begin: begin + batch]
            by_class = np.argsort((goal // MEMBERS).astype(np.uint16), kind="stable")  # short numbers are sorted by their digits
            some, goal = around[begin: begin + batch][by_class], goal[by_class]
            n, c, m = len(goal), goal // MEMBERS, goal % MEMBERS
            h = self.hidden(some)
            first = _softmax(h @ self.classes + self.class_bias)
            first[np.arange(n), c] -= 1
            first /= n
            back = first @ self.classes.T
            step("classes", h.T @ first)
            step("class_bias", first.sum(axis=0))
            held, opens = np.unique(c, return_index=True)
            for of, a, b in zip(held, opens, [*opens[1:], n]):
                second = _softmax(h[a:b] @ self.members[of] + self.member_bias[of])
                second[np.arange(b - a), m[a:b]] -= 1
                second /= n
                back[a:b] += second @ self.members[of].T
                step("members", h[a:b].T @ second, of)
                step("member_bias", second.sum(axis=0), of)
            back *= 1 - h ** 2
            for p in range(len(SIDES)):
                order = np.argsort(some[:, p].astype(np.uint16), kind="stable")
                of = some[order, p]
                opens = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                held = of[opens]
                step("context", np.add.reduceat(back[order], opens, axis=0), (p, held))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    data, borders = W.text_bytes(column)
    data = W.lower_ascii(data)
    words = W.split(data, borders)
    return W.hashes(data, words.begin, words.end), words.doc, len(borders) - 1


def masked(hashed: np.ndarray, doc: np.ndarray, number: int, one_of: int) -> np.ndarray:
    """Places of the words to predict in round ``number``; ``one_of`` rounds in a row have each word once, however texts are cut into batches."""
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return np.flatnonzero(W.mix(hashed + place.astype(np.uint64)) % np.uint64(one_of) == np.uint64(number % one_of))


def tokens(hashed: np.ndarray, vocabulary: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Token of each word: its own number, or that of its bucket."""
    bucket = OWN + (hashed % np.uint64(BUCKETS)).astype(np.int64)
    if not len(vocabulary):
        return bucket
    at = np.minimum(np.searchsorted(vocabulary, hashed), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashed, numbers[at], bucket)


def neighbourhood(token: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The tokens around each token; beyond the ends of a text there is a mark of its own."""
    n = len(token)
    around = np.full((n, len(SIDES)), VOCABULARY, np.int64)
    for p, side in enumerate(SIDES):
        a, b = max(0, -side), min(n, n - side)
        if b > a:
            here = np.arange(a, b)
            same = doc[here] == doc[here + side]
            around[here[same], p] = token[here[same] + side]
    return around


class Words(NamedTuple):
    """What is known of the corpus' words: those with tokens of their own (sorted hashes and numbers), how many
    words each bucket holds, and a table ``word, n`` of all words."""

    own: np.ndarray
    numbers: np.ndarray
    held: np.ndarray
    counts: DataFrame

    def tokens(self, hashed: np.ndarray) -> np.ndarray:
        return tokens(hashed, self.own, self.numbers)


def vocabulary(rows: DataFrame) -> Words:
    """Counts of every word of all documents; the ``OWN`` most frequent are numbered by falling frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.unique(word_hashes(part.column(1))[0], return_counts=True) for part in W.chunks(batch, size=CHUNK_BYTES)]
            if every:
                value, inverse = np.unique(np.concatenate([v for v, _ in every]), return_inverse=True)
                count = np.bincount(inverse, np.concatenate([c for _, c in every])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], ["word", "n"])

    counts = written(rows.sparkSession, rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    best = counts.orderBy(F.desc("n"), "word").limit(OWN).collect()
    top = np.array([r["word"] for r in best], np.int64).view(np.uint64)
    held = np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy(F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        held[r["bucket"]] = r["n"]
    np.subtract.at(held, (top % np.uint64(BUCKETS)).astype(np.int64), [r["n"] for r in best])
    order = np.argsort(top)
    return Words(top[order], order.astype(np.int64), held, counts)


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS, mask_one_of: int = MASK_ONE_OF) -> tuple[Network, Words]:
    """A network trained on masked words of all documents, every word once if ``rounds`` is ``mask_one_of``, and the vocabulary.

    Repeated rows are trained on as often as they occur, and count as often in the vocabulary.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_column, text_column)
    words = vocabulary(rows)
    own_words, numbers, network = words.own, words.numbers, Network()
    for number in range(rounds):
        now = network.to_bytes()

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Network.from_bytes(now), 0
            for batch in batches:
                for part in W.chunks(batch, size=CHUNK_BYTES):
                    hashed, doc, _ = word_hashes(part.column(1))
                    token = tokens(hashed, own_words, numbers)
                    places = masked(hashed, doc, number, mask_one_of)
                    own.learn(neighbourhood(token, doc)[places], token[places], TRAINED_AT_ONCE)
                    seen += len(places)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([own.to_bytes()], pa.binary())], ["n", "network"])

        found = written(spark, rows.mapInArrow(learn, "n long, network binary"), "networks")
        network = _averaged(found) or network
    return network, words


def _averaged(found: DataFrame) -> Network | None:
    """The mean of all networks, some at a time, until one is left."""

    def mean(rows: pa.Table) -> pa.Table:
        total, whole = sum(rows["n"].to_pylist()), Network()
        for name in Network.NAMES:
            setattr(whole, name, np.zeros(getattr(whole, name).shape))
        for n, stored in zip(rows["n"], rows["network"]):
            one = Network.from_bytes(stored.as_py())
            for name in Network.NAMES:
                setattr(whole, name, getattr(whole, name) + getattr(one, name) * (n.as_py() / total))
        for name in Network.NAMES:
            setattr(whole, name, getattr(whole, name).astype(np.float32))
        return pa.table({"n": pa.array([total], pa.int64()), "network": pa.array([whole.to_bytes()], pa.binary())})

    left = found.count()
    while left > 1:
        groups = -(-left // AVERAGED_AT_ONCE)
        placed = found.withColumn("group", F.pmod(F.xxhash64("network"), F.lit(groups)))
        found = written(found.sparkSession, placed.groupBy("group").applyInArrow(mean, "n long, network binary"), "networks")
        left = found.count()
    return Network.from_bytes(found.first()["network"]) if left else None


def spilled(hashed: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """``radix, words, postings`` of words and their documents: the words of a run ascend, with the documents of each and how often they have it."""
    order = np.lexsort((doc, hashed))
    hashed, doc = hashed[order], doc[order]
    opens = np.flatnonzero(np.append(True, (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1]))) if len(hashed) else np.zeros(0, np.int64)
    times = np.diff(opens, append=len(hashed))
    hashed, doc = hashed[opens], doc[opens]
    limits = np.searchsorted(hashed >> np.uint64(64 - RADIX_BITS), np.arange((1 << RADIX_BITS) + 1, dtype=np.uint64))
    for radix in np.flatnonzero(np.diff(limits)).tolist():
        some = slice(limits[radix], limits[radix + 1])
        first = np.flatnonzero(np.append(True, hashed[some][1:] != hashed[some][:-1]))
        docs = np.diff(first, append=limits[radix + 1] - limits[radix])
        body = hashed[some][first].astype("<u8").tobytes() + docs.astype("<u8").tobytes()
        yield radix, zstandard.ZstdCompressor(level=3).compress(body), packed(doc[some], times[some])


def shares(words: bytes, postings: bytes, known: np.ndarray, counts: np.ndarray, held: np.ndarray) -> bytes:
    """``document, sum`` of the log shares of a run's words in their buckets. A word that was never counted stands for one more."""
    word, docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(words), "<u8").reshape(2, -1)
    doc, times = unpacked(postings, 2)
    total = held[(word % np.uint64(BUCKETS)).astype(np.int64)]
    n = np.zeros(len(word), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, word), len(known) - 1)
        n = np.where(known[at] == word, counts[at], 0)
    share = np.where(n > 0, np.log(np.maximum(n, 1) / np.maximum(total, 1)), -np.log(total + 1.0))
    whole = np.bincount(doc, np.repeat(share, docs.astype(np.int64)) * times)
    at = np.unique(doc)
    return zstandard.ZstdCompressor(level=3).compress(at.astype("<f8").tobytes() + whole[at].astype("<f8").tobytes())


def score(docs: DataFrame, network: Network, words: Words, id_column: str = "doc_id", text_column: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, per_token`` of every row, over all words of its text.

    The probability of a word is that of its token, and for words that share a bucket times its share of the
    bucket's words in the corpus. A null or empty text has no tokens, the likelihood 0 and a null mean. Rows are scored one by
    one, repeated ones alike.
    """
    stored, own_words, numbers, held = network.to_bytes(), words.own, words.numbers, words.held
    spark, schema = docs.sparkSession, none_of(SPILLED).schema

    def rows(**columns) -> pa.RecordBatch:
        length = len(columns["batch"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(length, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, seen, size, kept = Network.from_bytes(stored), TaskContext.get().partitionId() << 33, 0, 0, []

        def runs() -> Iterator[pa.RecordBatch]:
            for radix, directory, postings in spilled(*(np.concatenate(c) for c in zip(*kept))) if kept else ():
                yield rows(batch=[number], radix=[radix], bytes=[len(directory) + len(postings)], words=[directory], postings=[postings])

        for batch in batches:
            for part in W.chunks(batch, size=CHUNK_BYTES):
                if size >= BATCH_BYTES or seen + part.num_rows > BATCH_DOCS:
                    yield from runs()
                    number, seen, size, kept = number + 1, 0, 0, []
                hashed, doc, n_docs = word_hashes(part.column(1))
                token = tokens(hashed, own_words, numbers)
                total = np.bincount(doc, own.log_probability(neighbourhood(token, doc), token), n_docs)
                shared = token >= OWN
                kept.append((hashed[shared], doc[shared] + seen))
                yield rows(batch=np.full(n_docs, number), doc=np.arange(seen, seen + n_docs), doc_id=part.column(0),
                           n_tokens=np.bincount(doc, minlength=n_docs), log_likelihood=total)
                seen += n_docs
                size += len(W.text_bytes(part.column(1))[0])
        yield from runs()

    table = written(spark, id_and_text(docs, id_column, text_column).mapInArrow(run, SPILLED), "scored")
    radixes = 1 << RADIX_BITS
    spills, parts = dealt(table.where(F.col("radix").isNotNull()), radixes, part_bytes)
    radix = F.shiftrightunsigned("word", 64 - RADIX_BITS).cast("int")
    counts = (words.counts.withColumn("radix", radix)
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.get(F.lit(parts), F.col("radix")) - 1))))
    keys, nothing = ["radix", "part"], none_of("batch long, shares binary")

    def hand_back(mine: pa.Table, sums: pa.Table) -> pa.Table:
        if mine.num_rows == 0:
            return nothing
        known, n = np.asarray(sums["word"]).view(np.uint64), np.asarray(sums["n"])
        order = np.argsort(known)
        known, n = known[order], n[order]
        blocks = [shares(mine["words"][i].as_py(), mine["postings"][i].as_py(), known, n, held) for i in range(mine.num_rows)]
        return pa.table({"batch": mine["batch"], "shares": pa.array(blocks, pa.binary())})

    given = (spills.select(*keys, "batch", "words", "postings").groupBy(*keys)
             .cogroup(counts.groupBy(*keys)).applyInArrow(hand_back, "batch long, shares binary"))
    result = none_of(RESULT).schema

    def finish(mine: pa.Table, gifts: pa.Table) -> pa.Table:
        if mine.num_rows == 0:
            return result.empty_table()
        doc, n = np.asarray(mine["doc"]), np.asarray(mine["n_tokens"])
        more = np.zeros(doc.max() + 1)
        for block in gifts["shares"].to_pylist():
            at, whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), "<f8").reshape(2, -1)
            more[at.astype(np.int64)] += whole
        total = np.asarray(mine["log_likelihood"]) + more[doc]
        mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
        return pa.table([mine["doc_id"], mine["n_tokens"], pa.array(total), mean], schema=result)

    scored = table.where(F.col("radix").isNull()).select("batch", "doc", "doc_id", "n_tokens", "log_likelihood")
    return scored.groupBy("batch").cogroup(given.groupBy("batch")).applyInArrow(finish, RESULT)


def score_all(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Trains on all rows and scores them."""
    return score(docs, *train(docs, id_column, text_column), id_column, text_column)
