"""Quality by co-training of two views.

One classifier sees the words of a text, the other what is known about the page: language, source,
length and layout. Both start from the labelled rows. In each round each scores all documents and names
those it is surest of within every language and source, and the other learns from them. At the end both
are calibrated on labelled rows that they were not trained on, their log-odds are added with fitted
weights, and all documents are scored.

Only the labelled rows are a bounded sample, ``labelled_rows`` of each class. Who is surest is read off
counts of log-odds per language and source. Features of all documents are written once, which all rounds
and the scores read; those of the named documents are written each round, and a step sums the slopes of
all of them. Named documents count for as much as the labelled ones of their class,
however many there are.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import same, written
from .quality_rules import count_texts
from .toxicity import held_out

LABELLED_ROWS = 2_000
ROUNDS = 4
#: Documents of each class that a view names in a round, as a share of each language and source.
NAMED = 0.04
#: Least log-odds of a named document.
SURE = 2
BITS = 16
#: Steps on the labelled rows alone, and steps of a round.
STEPS = 40
ROUND_STEPS = 8
#: Log-odds up to ``MOST`` are counted in buckets of one in ``PER_UNIT``.
PER_UNIT, MOST = 64, 30
#: Slopes are summed as whole numbers of this unit, so that the order of rows does not matter.
UNIT = 2.0 ** -40


class Rows(NamedTuple):
    """Sparse rows: features and values, ``first[i] : first[i + 1]`` of row ``i``."""

    feature: np.ndarray
    value: np.ndarray
    first: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.first)[rows]
        ends = np.cumsum(size)
        at = np.arange(size.sum()) + np.repeat(self.first[:-1][rows] - ends + size, size)
        return Rows(self.feature[at], self.value[at], np.concatenate([[0], ends]))

    def times(self, weights: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return np.bincount(row, weights[self.feature] * self.value, len(self.first) - 1)


def content(column: pa.Array) -> Rows:
    """Words, their ends and their shapes, each hashed; counts damped and scaled to length one."""
    return damped(content_counts(column))


def damped(counts: Rows) -> Rows:
    n_docs = len(counts.first) - 1
    row, value = np.repeat(np.arange(n_docs), np.diff(counts.first)), np.log1p(counts.value)
    norm = np.sqrt(np.bincount(row, value ** 2, n_docs))
    return Rows(counts.feature, (value / norm[row]).astype(np.float32), counts.first)


def content_counts(column: pa.Array) -> Rows:
    data, borders = W.text_bytes(column)
    words = W.split(data, borders)
    n_docs = len(borders) - 1
    of = W.hasher(W.lower_ascii(data))
    shape = W.hasher(_shape(data))
    begin, end = words.begin, words.end
    key = np.concatenate([W.mix(of(begin, end) + np.uint64(1)), W.mix(of(np.maximum(end - 3, begin), end) + np.uint64(2)),
                          W.mix(shape(begin, np.minimum(begin + 12, end)) + np.uint64(3))]) >> np.uint64(64 - BITS)
    wide = np.uint32 if n_docs <= 1 << (32 - BITS) else np.uint64
    cell, count = np.unique((np.tile(words.doc, 3).astype(wide) << wide(BITS)) | key.astype(wide), return_counts=True)
    return Rows((cell & wide((1 << BITS) - 1)).astype(np.int32), count.astype(np.int32), np.searchsorted((cell >> wide(BITS)).astype(np.int64), np.arange(n_docs + 1)))


def _shape(data: np.ndarray) -> np.ndarray:
    kind = np.full(256, 4, np.uint8)
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A], kind[0x80:] = 1, 2, 3, 2
    return kind[data]


def page(text: pa.Array, lang: pa.Array, source: pa.Array) -> Rows:
    """Language, source, and steps of length and layout; each feature has the value one."""
    counts = count_texts(text)
    data, borders = W.text_bytes(text)
    letters = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    size = letters[borders[1:]] - letters[borders[:-1]]

    def steps(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.minimum(40 * part // np.maximum(whole, 1), 40)

    def doubling(x: np.ndarray) -> np.ndarray:
        return np.floor(2 * np.log2(np.maximum(x, 1))).astype(np.int64)

    named = [np.array([hash_name(v) for v in c.to_pylist()], np.uint64) for c in (lang, source)]
    columns = [*named, doubling(size), doubling(counts["n_lines"]), doubling(size // np.maximum(counts["n_lines"], 1)),
               steps(counts["n_symbols"], counts["word_chars"]), steps(counts["n_dup_lines"], counts["n_lines"]), steps(counts["n_repeat_words"], counts["n_words"]),
               doubling(10 * counts["word_chars"] // np.maximum(counts["n_words"], 1))]
    key = np.stack([W.mix(np.asarray(c).astype(np.uint64) * np.uint64(64) + np.uint64(i)) for i, c in enumerate(columns)], axis=1) >> np.uint64(64 - BITS)
    return Rows(key.reshape(-1).astype(np.int32), np.ones(key.size, np.float32), np.arange(len(size) + 1) * len(columns))


def hash_name(name: str | None) -> int:
    """A number for a language or source; none is a value like others."""
    raw = np.frombuffer((name or "").encode() + (b"" if name is None else b"."), np.uint8)
    return int(W.hashes(raw, np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 0


class View(NamedTuple):
    """A view's weights, the intercept last, and the squared slopes so far, which set the size of its steps."""

    weights: np.ndarray
    squares: np.ndarray


def untaught() -> View:
    return View(np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-10))


def slopes(rows: Rows, label: np.ndarray, share: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slope of the logistic loss in each weight, each row taken with its share."""
    miss = share * (_sigmoid(decide(rows, weights)) - label)
    row = np.repeat(np.arange(len(label)), np.diff(rows.first))
    return np.append(np.bincount(rows.feature, rows.value * miss[row], 1 << BITS), miss.sum())


def stepped(view: View, slope: np.ndarray) -> View:
    weights, squares = view.weights.copy(), view.squares.copy()
    used = np.flatnonzero(slope)
    slope = slope[used] + 1e-6 * weights[used]
    squares[used] += slope ** 2
    weights[used] -= 0.5 * slope / np.sqrt(squares[used])
    return View(weights, squares)


def fit(rows: Rows, label: np.ndarray, steps: int = STEPS) -> View:
    """Logistic regression with balanced classes."""
    view = untaught()
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    for _ in range(steps):
        view = stepped(view, slopes(rows, label, share, view.weights))
    return view


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def decide(rows: Rows, weights: np.ndarray) -> np.ndarray:
    """Log-odds of good quality."""
    return rows.times(weights) + weights[-1]


class Model(NamedTuple):
    content: np.ndarray
    page: np.ndarray
    combined: np.ndarray

    def score(self, text: pa.Array, lang: pa.Array, source: pa.Array) -> np.ndarray:
        return self.score_views(content(text), page(text, lang, source))

    def score_views(self, words: Rows, layout: Rows) -> np.ndarray:
        odds = np.stack([np.ones(len(words.first) - 1), decide(words, self.content), decide(layout, self.page)], axis=1)
        return _sigmoid(odds @ self.combined)


def calibrate(odds: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Intercept and weights of the two views' log-odds, by Newton steps with a light ridge."""
    inputs, combined = np.column_stack([np.ones(len(odds)), odds]), np.zeros(3)
    for _ in range(40):
        p = _sigmoid(inputs @ combined)
        slope = inputs.T @ (label - p) - 0.05 * combined
        curve = (inputs * (p * (1 - p))[:, None]).T @ inputs + 0.05 * np.eye(3)
        combined += np.clip(np.linalg.solve(curve, slope), -2, 2)
    return combined


def buckets(odds: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(odds, -MOST, MOST) * PER_UNIT).astype(np.int32)


FEATURES = "f0 array<int>, n0 array<int>, f1 array<int>"
#: Documents whose features are looked at together.
SLICE = 64


def _stored(words: Rows, layout: Rows) -> list[pa.Array]:
    """Features of the content with their counts, and features of the page."""

    def lists(first: np.ndarray, held: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(held.astype(np.int32)))

    return [lists(words.first, words.feature), lists(words.first, words.value), lists(layout.first, layout.feature)]


def _raw(rows: pa.Table | pa.RecordBatch, view: int) -> Rows:
    lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows[name] for name in (("f0", "n0"), ("f1",))[view])]
    held = [c.flatten().to_numpy() for c in lists]
    return Rows(held[0], held[1] if view == 0 else np.ones(len(held[0]), np.float32), np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())]))


def _loaded(rows: pa.Table | pa.RecordBatch, view: int) -> Rows:
    return damped(_raw(rows, view)) if view == 0 else _raw(rows, view)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            yield batch.slice(begin, SLICE)


def featured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """``doc_id, lang, source`` and both views' features of every row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                text, lang, source = part.column(1), part.column(2), part.column(3)
                yield pa.RecordBatch.from_arrays([part.column(0), lang, source, *_stored(content_counts(text), page(text, lang, source))], ["doc_id", "lang", "source", "f0", "n0", "f1"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"),
                       F.col(source_column).cast("string").alias("source"))
    return written(docs.sparkSession, rows.mapInArrow(run, f"doc_id long, lang string, source string, {FEATURES}"), "quality-features")


def limits(rows: DataFrame, views: tuple[View, View], named: float = NAMED) -> DataFrame:
    """``low0, high0, low1, high1`` per ``of_lang, of_source``: the buckets of log-odds that hold the surest ``named`` of its rows on either side.

    A bucket that goes beyond the share stays outside, unless it is the outermost.
    """
    weights = [v.weights for v in views]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part["lang"], part["source"], *(pa.array(buckets(decide(_loaded(part, v), weights[v]))) for v in (0, 1))], ["of_lang", "of_source", "b0", "b1"])

    cells = rows.mapInArrow(run, "of_lang string, of_source string, b0 int, b1 int").select("of_lang", "of_source", F.expr("stack(2, 0, b0, 1, b1) as (view, bucket)"))
    counted = cells.groupBy("of_lang", "of_source", "view", "bucket").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("of_lang", "of_source", "view")  # a bounded number of buckets
    reached = counted.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("most", named * F.sum("n").over(group)).withColumn("down", F.sum("n").over(group.orderBy(F.desc("bucket"))))

    def end(view: int, outer, inner, reach: str):
        mine = F.col("view") == view
        return F.coalesce(inner(F.when(mine & (F.col(reach) <= F.col("most")), F.col("bucket"))), outer(F.when(mine, F.col("bucket"))))

    return reached.groupBy("of_lang", "of_source").agg(*(c for v in (0, 1) for c in (end(v, F.min, F.max, "upto").alias(f"low{v}"), end(v, F.max, F.min, "down").alias(f"high{v}"))))


def name(rows: DataFrame, views: tuple[View, View], ends: DataFrame, learned: np.ndarray) -> DataFrame:
    """``label0, label1`` and features of the documents that a view is taught: ``label0`` comes from the page, ``label1`` from the content, -1 is none.

    ``learned`` are the ids of the labelled sample, which are not named.
    """
    weights = [v.weights for v in views]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            free = ~np.isin(part["doc_id"].fill_null(0).to_numpy(), learned) | part["doc_id"].is_null().to_numpy(zero_copy_only=False)
            label = [np.full(part.num_rows, -1, np.int32) for _ in weights]
            for v in (0, 1):
                odds = decide(_loaded(part, v), weights[v])
                bucket, low, high = buckets(odds), part[f"low{v}"].to_numpy(), part[f"high{v}"].to_numpy()
                label[1 - v][free & (odds < -SURE) & (bucket <= low)] = 0
                label[1 - v][free & (odds > SURE) & (bucket >= high)] = 1
            hit = np.flatnonzero((label[0] >= 0) | (label[1] >= 0))
            if len(hit):
                held = _stored(*(_emptied(_raw(part, v).take(hit), label[v][hit] < 0) for v in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(label[0][hit]), pa.array(label[1][hit]), *held], ["label0", "label1", "f0", "n0", "f1"])

    found = rows.join(ends, same(F.col("lang"), F.col("of_lang")) & same(F.col("source"), F.col("of_source")))
    return found.select("doc_id", "low0", "high0", "low1", "high1", "f0", "n0", "f1").mapInArrow(run, f"label0 int, label1 int, {FEATURES}")


def _emptied(rows: Rows, which: np.ndarray) -> Rows:
    """``rows`` without the features of some, which stay as empty rows."""
    size = np.where(which, 0, np.diff(rows.first))
    kept = rows.take(np.flatnonzero(~which))
    return Rows(kept.feature, kept.value, np.concatenate([[0], np.cumsum(size)]))


def teach(sample: DataFrame, taught: DataFrame, views: tuple[View, View], steps: int = ROUND_STEPS) -> tuple[View, View]:
    """The views after some steps on the labelled sample and the named documents; the driver sees one slope a feature."""
    counted = taught.agg(*(F.count_if(F.col(f"label{v}") == c).alias(f"n{v}{c}") for v in (0, 1) for c in (0, 1))).first()
    known = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    # half of a class's weight is that of its labelled rows
    share = np.array([[[0.25 / max(1, n) for n in (known.get(c, 0), counted[f"n{v}{c}"])] for c in (0, 1)] for v in (0, 1)])
    rows = (sample.select(F.lit(0).alias("given"), F.col("label").alias("label0"), F.col("label").alias("label1"), "f0", "n0", "f1")
            .unionByName(taught.withColumn("given", F.lit(1))))
    for _ in range(steps):
        weights = [v.weights for v in views]

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, (1 << BITS) + 1))
            for batch in _slices(batches):
                given = batch["given"].to_numpy()
                for v in (0, 1):
                    label = batch[f"label{v}"].to_numpy()
                    part = np.where(label >= 0, share[v][np.maximum(label, 0), given], 0.0)
                    total[v] += slopes(_loaded(batch, v), label, part, weights[v])
            whole = np.rint(total.reshape(-1) / UNIT).astype(np.int64)
            at = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(whole[at])], ["at", "slope"])

        summed = rows.mapInArrow(run, "at int, slope long").groupBy("at").agg(F.sum("slope").alias("slope")).toArrow()  # one row a feature and view at most
        slope = np.zeros(2 * ((1 << BITS) + 1))
        slope[summed["at"].to_numpy()] = summed["slope"].to_numpy() * UNIT
        views = tuple(stepped(view, part) for view, part in zip(views, slope.reshape(2, -1)))
    return views


def _on_sample(sample: DataFrame, work) -> list[np.ndarray] | None:
    """What ``work`` makes of the whole sample, which is bounded, in one task; nothing for no rows."""

    def run(rows: pa.Table) -> pa.Table:
        file = io.BytesIO()
        np.savez(file, *work(rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])))
        return pa.table({"arrays": pa.array([file.getvalue()], pa.binary())})

    stored = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "arrays binary").first()
    if stored is None:
        return None
    held = np.load(io.BytesIO(stored["arrays"]))
    return [held[f"arr_{i}"] for i in range(len(held.files))]


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
          label_column: str = "quality", labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS, named: float = NAMED) -> Model:
    """A model from labelled rows that are not held out, and from all documents; see ``train_featured``."""
    return train_featured(featured(docs, id_column, text_column, lang_column, source_column), labels, id_column, label_column, labelled_rows, rounds, named)


def train_featured(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality", labelled_rows: int = LABELLED_ROWS,
                   rounds: int = ROUNDS, named: float = NAMED) -> Model:
    """A model from documents as ``featured`` writes them.

    With one class or none among the labels, every score is that class, or a half. One labelled row
    in four is kept for the calibration, if both parts then have both classes. Repeated rows and rows
    without an id are named and learned from like others, each by itself.
    """
    spark = docs.sparkSession
    known = (labels.select(F.col(id_column).cast("long").alias("of"), F.col(label_column).cast("int").alias("label")).where("of is not null and label is not null")
             .groupBy("of").agg(F.max("label").alias("label")).where(~held_out(F.col("of"))))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}

    def constant(odds: float) -> Model:
        return Model(np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1), np.array([odds, 0, 0]))

    if not n.get(0) or not n.get(1):
        return constant(0.0 if not n else 30.0 if n.get(1) else -30.0)
    some = known.where(" or ".join(["false"] + [f"(label = {c} and pmod(xxhash64(of, 'quality'), 1000000) < {int(1e6 * min(1.0, labelled_rows / n[c]))})" for c in (0, 1)]))
    # bounded by the parameter
    labelled = docs.join(F.broadcast(some), F.col("doc_id") == F.col("of")).select("doc_id", "label", "f0", "n0", "f1").distinct()
    sample = written(spark, labelled, "quality-training")
    apart = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(4)) == 0
    sides = {(r["apart"], r["label"]) for r in sample.groupBy(apart.alias("apart"), "label").count().collect()}
    learned, aside = (sample.where(~apart), sample.where(apart)) if len(sides) == 4 else (sample, sample)

    def first_fit(rows: pa.Table) -> list[np.ndarray]:
        return [a for v in (0, 1) for a in fit(_loaded(rows, v), rows["label"].to_numpy())]

    begun = _on_sample(learned, first_fit)
    if begun is None:  # labels of other documents
        return constant(0.0)
    views = View(*begun[:2]), View(*begun[2:])
    ids = np.array([r[0] for r in some.select("of").collect()], np.int64)  # bounded by the parameter
    for _ in range(rounds - 1):
        ends = written(spark, limits(docs, views, named), "quality-limits")
        taught = written(spark, name(docs, views, ends, ids), "quality-named")
        views = teach(learned, taught, views)

    def last_fit(rows: pa.Table) -> list[np.ndarray]:
        return [calibrate(np.column_stack([decide(_loaded(rows, v), views[v].weights) for v in (0, 1)]), rows["label"].to_numpy())]

    return Model(views[0].weights, views[1].weights, _on_sample(aside, last_fit)[0])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """``doc_id, score, predicted`` of every row: how likely its quality is good, and 1 from a half on.

    A null text counts as empty and is judged by its page alone; null languages and sources are
    values of their own. Rows are scored one by one.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"),
                       F.col(source_column).cast("string").alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                value = model.score(part.column(1), part.column(2), part.column(3))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def score_featured(docs: DataFrame, model: Model) -> DataFrame:
    """``score`` for documents as ``featured`` writes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            value = model.score_views(_loaded(part, 0), _loaded(part, 1))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "f0", "n0", "f1").mapInArrow(run, "doc_id long, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains and scores all rows, with ``held_out``; rows without an id are not held out."""
    rows = featured(docs)
    return score_featured(rows, train_featured(rows, labels)).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
