"""Toxic spans by a linear-chain conditional random field.

Labels are per document, so token labels are made first: beginnings of words that are far more common
in toxic training documents than in others are candidates, and the fewest of them that explain the
toxic documents are kept; their tokens are the toxic ones. The field has features of a word and its
beginnings and a 2 x 2 transition, and is fitted by gradient ascent with exact forward-backward sums:
first on a pilot of windows in one task, then on every token of the training texts, whose slopes each
partition sums. Marginals of every token of a whole text are added up to a document's score, calibrated on training
documents, and runs of likely tokens are the offending spans.

Training uses a bounded sample of labelled rows (``toxic_rows``, ``clean_rows``); scoring uses all texts.
"""

from __future__ import annotations

import io
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import id_and_text, written

TOXIC_ROWS = 4_000
CLEAN_ROWS = 8_000
FEATURE_BITS = 18
#: Bytes of a word's beginning that are features, besides the word itself and its end.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
END_BYTES = 3
WINDOW = 32
BLOCK = 64
#: Steps on the pilot, and then over all tokens of the training texts.
STEPS = 40
ROUNDS = 6
SLICE = 2_048

_SALT = W.mix(np.arange(1, 16, dtype=np.uint64))


def token_features(data: np.ndarray, words: W.Words) -> np.ndarray:
    """One row of feature hashes per word: the word, its beginnings, its end. Case of A-Z does not count."""
    of = W.hasher(W.lower_ascii(data))
    begin, end = words.begin, words.end
    columns = [of(begin, end), *(of(begin, np.minimum(begin + k, end)) for k in BEGINNINGS), of(np.maximum(end - END_BYTES, begin), end)]
    return np.stack([W.mix(c ^ _SALT[i]) for i, c in enumerate(columns)], axis=1) if len(begin) else np.zeros((0, len(BEGINNINGS) + 2), np.uint64)


def slots(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


# ---------------------------------------------------------------- chain

class Field(NamedTuple):
    """Weight of each feature for a toxic token, and log weights of the transitions clean/toxic -> clean/toxic."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, where: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[where].sum(axis=-1), -25.0, 25.0)


def _sweep(odds: np.ndarray, mask: np.ndarray, moves: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of rows of tokens, scaled; masked places pass them on."""
    n, width = odds.shape
    forward, backward = np.empty((n, width, 2)), np.empty((n, width, 2))
    now = start
    for t in range(width):
        step = now @ moves
        step[:, 1] *= odds[:, t]
        step /= step.sum(axis=1, keepdims=True)
        now = np.where(mask[:, t, None], step, now)
        forward[:, t] = now
    now = stop
    for t in range(width - 1, -1, -1):
        backward[:, t] = now
        step = now.copy()
        step[:, 1] *= odds[:, t]
        step = step @ moves.T
        step /= step.sum(axis=1, keepdims=True)
        now = np.where(mask[:, t, None], step, now)
    return forward, backward


def marginals(emission: np.ndarray, doc: np.ndarray, n_docs: int, moves: np.ndarray) -> np.ndarray:
    """Exact probability that each token is toxic, given its whole text.

    Texts are cut into blocks of ``BLOCK`` tokens. Each block's product of transitions is found for
    all blocks at once, messages are passed from block to block, then along the tokens inside.
    """
    n = len(emission)
    if n == 0:
        return np.zeros(0)
    exp = np.exp(moves)
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    blocks = -(-count // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    place = np.arange(n) - first[doc]
    row, column = first_block[doc] + place // BLOCK, place % BLOCK
    total = int(blocks.sum())
    odds, mask = np.ones((total, BLOCK)), np.zeros((total, BLOCK), bool)
    odds[row, column] = np.exp(emission)
    mask[row, column] = True
    product = np.broadcast_to(np.eye(2), (total, 2, 2)).copy()
    for t in range(BLOCK):
        step = product @ exp
        step[:, :, 1] *= odds[:, t, None]
        step /= step.sum(axis=(1, 2), keepdims=True)
        product = np.where(mask[:, t, None, None], step, product)
    start, stop = np.zeros((total, 2)), np.ones((total, 2))
    start[:, 0] = 1.0  # before a text all is clean
    by_length = np.argsort(-blocks, kind="stable")
    lengths = blocks[by_length]
    for k in range(1, int(blocks.max())):
        here = first_block[by_length[: np.searchsorted(-lengths, -k)]] + k
        message = np.einsum("ij,ijk->ik", start[here - 1], product[here - 1])
        start[here] = message / message.sum(axis=1, keepdims=True)
    for k in range(int(blocks.max()) - 2, -1, -1):
        here = first_block[by_length[: np.searchsorted(-lengths, -(k + 1))]] + k
        message = np.einsum("ikj,ij->ik", product[here + 1], stop[here + 1])
        stop[here] = message / message.sum(axis=1, keepdims=True)
    forward, backward = _sweep(odds, mask, exp, start, stop)
    both = forward * backward
    return (both[:, :, 1] / both.sum(axis=2))[row, column]


class Ascent(NamedTuple):
    """State of the ascent: weights and transitions, and the sums of squares that set their step sizes."""

    weights: np.ndarray
    moves: np.ndarray
    weight_sum: np.ndarray
    move_sum: np.ndarray

    def step(self, up: np.ndarray, move_up: np.ndarray, tokens: int, decay: float = 1e-4) -> Ascent:
        up, move_up = up / tokens * 100 - decay * self.weights, move_up / tokens
        weight_sum, move_sum = self.weight_sum + up ** 2, self.move_sum + move_up ** 2
        return Ascent(self.weights + 0.5 * up / np.sqrt(weight_sum), self.moves + 0.2 * move_up / np.sqrt(move_sum), weight_sum, move_sum)

    def field(self) -> Field:
        return Field(self.weights.astype(np.float32), self.moves)


def summed_slopes(where: np.ndarray, label: np.ndarray, mask: np.ndarray, before: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope of every weight and transition, summed over windows, some at a time for the memory."""
    up, move_up = np.zeros(len(weights)), np.zeros((2, 2))
    for begin in range(0, len(label), SLICE):
        part = slice(begin, begin + SLICE)
        feature = where[part][mask[part]]
        miss, turns = _slopes(feature, label[part], mask[part], before[part], weights, moves)
        up += np.bincount(feature.reshape(-1), np.repeat(miss, where.shape[2]), len(weights))
        move_up += turns
    return up, move_up


def ascend(where: np.ndarray, label: np.ndarray, mask: np.ndarray, before: np.ndarray | None = None, steps: int = STEPS) -> Ascent:
    """Gradient ascent on the likelihood of labelled windows, with step sizes per weight."""
    before = np.zeros(len(label), np.int64) if before is None else before
    size = 1 << FEATURE_BITS
    state = Ascent(np.zeros(size), np.zeros((2, 2)), np.full(size, 1e-3), np.full((2, 2), 1e-3))
    for _ in range(steps):
        state = state.step(*summed_slopes(where, label, mask, before, state.weights, state.moves), int(mask.sum()))
    return state


def fit_field(where: np.ndarray, label: np.ndarray, mask: np.ndarray, steps: int = STEPS) -> Field:
    return ascend(where, label, mask, None, steps).field()


def _slopes(feature: np.ndarray, label: np.ndarray, mask: np.ndarray, opens: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label minus marginal of each token, and seen minus expected transitions, of some windows.

    ``feature`` has a row for each place of ``mask``; ``opens`` is the label before each window.
    """
    begin = np.eye(2)[opens]
    emission = np.zeros(label.shape)
    emission[mask] = np.clip(weights[feature].sum(axis=1), -25, 25)
    odds, exp = np.exp(emission), np.exp(moves)
    forward, backward = _sweep(odds, mask, exp, begin, np.ones(begin.shape))
    last = np.concatenate([begin[:, None], forward[:, :-1]], axis=1)[mask]
    ahead = backward[mask]
    ahead[:, 1] *= odds[mask]
    both = (last @ exp) * ahead
    whole = both.sum(axis=1)
    before = np.concatenate([opens[:, None], label[:, :-1]], axis=1)
    now = label[mask]
    seen = np.bincount(2 * before[mask] + now, minlength=4).reshape(2, 2)
    return now - both[:, 1] / whole, seen - exp * ((last / whole[:, None]).T @ ahead)


# ---------------------------------------------------------------- training

def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, toxic_rows: int, clean_rows: int) -> DataFrame:
    """``doc_id, text, label`` of a sample of labelled rows that are not held out; of each class about so many at most."""
    known = (labels.select(F.col(id_column).cast("long").alias("of"), F.col(label_column).cast("int").alias("label")).where("of is not null and label is not null")
             .groupBy("of").agg(F.max("label").alias("label")).where(~held_out(F.col("of"))))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = {c: min(1.0, rows / n[c]) if n.get(c) else 0.0 for c, rows in ((1, toxic_rows), (0, clean_rows))}
    draw = F.pmod(F.xxhash64("of", F.lit("sample")), F.lit(1_000_000))
    some = known.where(((F.col("label") == 1) & (draw < int(share[1] * 1e6))) | ((F.col("label") == 0) & (draw < int(share[0] * 1e6))))
    # bounded by the two parameters
    return id_and_text(docs, id_column, text_column).join(F.broadcast(some), F.col("doc_id") == F.col("of")).select("doc_id", F.col("text"), "label").dropDuplicates(["text"])


def _beginnings(features: np.ndarray) -> np.ndarray:
    return features[:, : 1 + len(BEGINNINGS)]


def candidates(rows: DataFrame, toxic: int, clean: int) -> np.ndarray:
    """Word beginnings that are at least twenty times as frequent in toxic as in clean training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in W.chunks(batch)):
            data, borders = W.text_bytes(part.column(1))
            words = W.split(data, borders)
            features = _beginnings(token_features(data, words))
            doc = np.repeat(words.doc, features.shape[1])
            key = features.reshape(-1)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, toxic = key[fresh], part.column(2).to_numpy()[doc[fresh]] == 1
            value, opens = np.unique(key, return_index=True)
            if len(value):
                held = np.add.reduceat(toxic.astype(np.int64), opens)
                size = np.diff(np.append(opens, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(size - held), pa.array(held)], ["feature", "clean", "toxic"])

    found = rows.mapInArrow(run, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odd = (F.col("toxic") >= 4) & (F.col("toxic") * clean >= 20 * (F.col("clean") + 0.25) * toxic)
    return np.sort(np.array([r["feature"] for r in found.where(odd).select("feature").collect()], np.int64).view(np.uint64))


def _is_in(features: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    if not len(chosen):
        return np.zeros(features.shape, bool)
    at = np.minimum(np.searchsorted(chosen, features), len(chosen) - 1)
    return chosen[at] == features


def explain(rows: DataFrame, odd: np.ndarray, least: int = 3) -> np.ndarray:
    """The fewest of the candidates, found greedily, that occur in the toxic training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                data, borders = W.text_bytes(part.column(1))
                words = W.split(data, borders)
                features = _beginnings(token_features(data, words))
                hit = _is_in(features, odd)
                doc = np.repeat(words.doc, features.shape[1])[hit.reshape(-1)]
                key = features.reshape(-1)[hit.reshape(-1)]
                for d in range(len(borders) - 1):
                    if part.column(2)[d].as_py() == 1:
                        yield pa.RecordBatch.from_arrays([pa.array([np.unique(key[doc == d]).view(np.int64).tolist()], pa.list_(pa.int64()))], ["features"])

    holders: dict[int, set[int]] = defaultdict(set)
    for number, row in enumerate(rows.where("label = 1").mapInArrow(run, "features array<long>").collect()):  # one row a toxic training document
        for feature in row[0]:
            holders[feature].add(number)
    chosen, open_docs = [], set().union(*holders.values()) if holders else set()
    while open_docs:
        best = max(holders, key=lambda f: (len(holders[f] & open_docs), f))
        if len(holders[best] & open_docs) < least:
            break
        chosen.append(best)
        open_docs -= holders.pop(best)
    return np.sort(np.array(chosen, np.int64).view(np.uint64))


def training_windows(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """All tokens of the training texts in windows of up to ``WINDOW``, with the label before each window.

    ``pilot`` marks those that the first fit uses: with toxic tokens, and two of every clean text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                data, borders = W.text_bytes(part.column(1))
                words = W.split(data, borders)
                if not len(words.begin):
                    continue
                features = token_features(data, words)
                where = slots(features)
                clean = part.column(2).to_numpy() != 1
                toxic = (_is_in(_beginnings(features), chosen).any(axis=1) & ~clean[words.doc]).astype(np.uint8)
                place = np.arange(len(toxic)) - words.first[words.doc]
                opens = np.flatnonzero(place % WINDOW == 0)
                closes = np.append(opens[1:], len(toxic))
                doc = words.doc[opens]
                before = np.where(place[opens] == 0, 0, toxic[opens - 1])
                n = -(-np.diff(words.first)[doc] // WINDOW)
                pilot = (np.add.reduceat(toxic.astype(np.int64), opens) > 0) | (clean[doc] & ((place[opens] // WINDOW == n // 4) | (place[opens] // WINDOW == 3 * n // 4)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([where[a:b].tobytes() for a, b in zip(opens, closes)], pa.binary()), pa.array([toxic[a:b].tobytes() for a, b in zip(opens, closes)], pa.binary()),
                     pa.array(before.astype(np.int32)), pa.array(pilot)], ["features", "labels", "before", "pilot"])

    return rows.mapInArrow(run, "features binary, labels binary, before int, pilot boolean")


def _padded(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    width, n = len(BEGINNINGS) + 2, table.num_rows
    where, label, mask = np.zeros((n, WINDOW, width), np.int32), np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
    for i, (f, y) in enumerate(zip(table["features"].to_pylist(), table["labels"].to_pylist())):
        where[i, : len(y)] = np.frombuffer(f, np.int32).reshape(-1, width)
        label[i, : len(y)] = np.frombuffer(y, np.uint8)
        mask[i, : len(y)] = True
    return where, label, mask, table["before"].to_numpy().astype(np.int64)


def numbers_of(df: DataFrame) -> list[np.ndarray]:
    """Columns of numbers as arrays. They come packed, one row a partition, and not as objects for every row."""
    types = [np.dtype({"int": "<i4", "double": "<f8"}[field.dataType.simpleString()]) for field in df.schema]
    names = df.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(b.column(i).to_numpy().astype(t).tobytes() for b in held)], pa.binary()) for i, t in enumerate(types)], names)

    rows = df.mapInArrow(pack, ", ".join(f"`{name}` binary" for name in names)).collect()
    return [np.frombuffer(b"".join(row[i] for row in rows), t) for i, t in enumerate(types)]


def slopes_of_all(windows: DataFrame, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of weights and transitions over all windows: each partition sums its own, equal slots are added in Spark.

    What comes to the driver is one number a slot, at most ``2 ** FEATURE_BITS`` and four, packed by partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, turns = np.zeros(len(field.weights)), np.zeros((2, 2))
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                a, b = summed_slopes(*_padded(batch.slice(begin, SLICE)), field.weights, field.moves)
                up += a
                turns += b
        slot = np.flatnonzero(up)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([slot, -1 - np.arange(4)]).astype(np.int32)), pa.array(np.concatenate([up[slot], turns.reshape(-1)]))], ["slot", "slope"])

    summed = windows.select("features", "labels", "before").mapInArrow(run, "slot int, slope double").groupBy("slot").agg(F.sum("slope").alias("slope"))
    slot, slope = numbers_of(summed)
    up, turns = np.zeros(len(field.weights)), np.zeros(4)
    up[slot[slot >= 0]] = slope[slot >= 0]
    turns[-1 - slot[slot < 0]] = slope[slot < 0]
    return up, turns.reshape(2, 2)


class Model(NamedTuple):
    field: Field
    calibration: np.ndarray

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_calibration_inputs(summary) @ self.calibration, -30, 30)))


def _calibration_inputs(summary: np.ndarray) -> np.ndarray:
    top = np.clip(summary[:, 0], 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(summary)), np.log(top / (1 - top)) / 5, np.log1p(summary[:, 1])], axis=1)


def fit_calibration(summary: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a light ridge."""
    x, beta = _calibration_inputs(summary), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (label - p)) - 0.1 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def tag(column: pa.Array, field: Field) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """Words of the texts, each one's probability of being toxic, and per text the greatest of them and the sum of those above a tenth."""
    data, borders = W.text_bytes(column)
    words = W.split(data, borders)
    n_docs = len(borders) - 1
    toxic = marginals(field.emissions(slots(token_features(data, words))), words.doc, n_docs, field.moves)
    summary = np.zeros((n_docs, 2))
    np.maximum.at(summary[:, 0], words.doc, toxic)
    summary[:, 1] = np.bincount(words.doc, np.where(toxic > 0.1, toxic, 0.0), n_docs)
    return words, toxic, summary


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
          toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, rounds: int = ROUNDS) -> Model:
    """Fits the field and its calibration. Without labelled rows of both classes every score is the share of toxic labels, or 0."""
    spark = docs.sparkSession
    rows = written(spark, training_rows(docs, labels, id_column, text_column, label_column, toxic_rows, clean_rows), "toxic-training")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return Model(Field(np.zeros(1 << FEATURE_BITS, np.float32), np.zeros((2, 2))), np.array([30.0 if toxic else -30.0, 0, 0]))
    chosen = explain(rows, candidates(rows, toxic, clean))

    windows = written(spark, training_windows(rows, chosen), "toxic-windows")

    def fit(pilot: pa.Table) -> pa.Table:
        padded = _padded(pilot)
        file = io.BytesIO()
        np.savez(file, tokens=padded[2].sum(), **ascend(*padded)._asdict())
        return pa.table({"model": pa.array([file.getvalue()], pa.binary())})

    stored = windows.where("pilot").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fit, "model binary").collect()  # a bounded sample
    if not stored:  # no text holds a word
        return Model(Field(np.zeros(1 << FEATURE_BITS, np.float32), np.zeros((2, 2))), np.array([30.0 if toxic else -30.0, 0, 0]))
    held = np.load(io.BytesIO(stored[0][0]))
    state = Ascent(*(held[name] for name in Ascent._fields))
    for _ in range(rounds):
        state = state.step(*slopes_of_all(windows, state.field()), int(held["tokens"]))
    field = state.field()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                summary = tag(part.column(1), field)[2]
                yield pa.RecordBatch.from_arrays([pa.array(summary[:, 0]), pa.array(summary[:, 1]), part.column(2)], ["top", "total", "label"])

    sums = np.column_stack(numbers_of(rows.mapInArrow(summarise, "top double, total double, label int")))
    every = {r["label"]: r["n"] for r in labels.where(~held_out(F.col(id_column))).groupBy(F.col(label_column).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.where(sums[:, 2] == 1, every.get(1, toxic) / toxic, every.get(0, clean) / clean)
    return Model(field, fit_calibration(sums[:, :2], sums[:, 2], weight / weight.mean()))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, predicted, spans`` of every row; ``spans`` are ``begin, end`` in characters.

    A null or empty text has no tokens and the score of a text without toxic tokens. Rows are
    judged one by one: repeated rows alike, null ids stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                words, toxic, summary = tag(part.column(1), model.field)
                value = model.score(summary)
                hit = np.flatnonzero(toxic >= threshold)
                fresh = np.ones(len(hit), bool)
                fresh[1:] = (np.diff(hit) > 1) | (words.doc[hit][1:] != words.doc[hit][:-1])
                opens = np.flatnonzero(fresh)
                first, last = hit[opens], hit[np.append(opens[1:], len(hit)) - 1] if len(hit) else hit
                letters = np.concatenate([[0], np.cumsum(words.data & 0xC0 != 0x80)])
                _, borders = W.text_bytes(part.column(1))
                base = letters[borders[:-1]][words.doc[first]]
                spans = pa.StructArray.from_arrays([pa.array((letters[words.begin[first]] - base).astype(np.int32)), pa.array((letters[words.end[last]] - base).astype(np.int32))],
                                                   ["begin", "end"])
                rows = np.searchsorted(words.doc[first], np.arange(len(value) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.ListArray.from_arrays(pa.array(rows), spans)],
                                                 ["doc_id", "score", "predicted", "spans"])

    return id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<begin:int,end:int>>")


def keep(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not found toxic, with all their columns; every row is judged by itself."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, text=names[at]):
                fine = model.score(tag(part.column(at), model.field)[2]) < 0.5
                yield part.filter(pa.array(fine))

    plain = docs.toDF(*names)  # the names do not matter inside
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """Trains on the labels that are not held out and scores all rows, with ``held_out``. Rows without an id are not held out."""
    scored = score(docs, train(docs, labels, id_column, text_column, label_column), id_column, text_column)
    return scored.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
