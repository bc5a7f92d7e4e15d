"""Quality rules with thresholds that adapt to each language and source.

Every rule looks at one whole-number measure of a document. Its values are put into buckets of
bounded relative width, and counts per bucket are the sketch: sketches of parts of the data merge by
adding counts, and any quantile is read off with that width as its error. The limits of a group are
its median plus and minus a multiple of its spread; measures that are 0 for most documents (``TAILS``)
have no spread to speak of, and their limit is an upper quantile plus a margin. Groups that are too
small for that use the merged sketch of their language, then that of all documents. A group that is
noisy itself does not widen its own limits beyond those its language's spread or tail would give. The
limits are joined back to filter the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import words as W
from .common import same, written

SYMBOLS = "#*$%&|<>"
MEASURES = ["symbol_rate", "dup_line_rate", "repeat_rate", "word_length"]
#: Rule by spread: least spread that is taken for a group, in the measure's unit.
FLOORS = {"symbol_rate": 8, "word_length": 25}
#: Rule by tail: what a document may have above the 95 % quantile of its group, in the measure's unit.
TAILS = {"dup_line_rate": 340, "repeat_rate": 300}
SPREADS = 6
GROUP_MIN = 50

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _distinct_of(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (document, value), a key and how often the key occurs."""
    key = W.mix(value + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return inverse, count


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a column; a null text has none."""
    data, borders = W.text_bytes(column)
    n_docs = len(borders) - 1
    words = W.split(data, borders)
    if len(words.begin) == 0:
        symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
        return {c: np.zeros(n_docs, np.int64) for c in COUNTS} | {"n_symbols": symbols[borders[1:]] - symbols[borders[:-1]]}
    n_words = np.diff(words.first)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0 != 0x80) & ~W._BLANK[data])])
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])
    hashed = W.hashes(data, words.begin, words.end)

    # lines end before each \n and at the end of each text; a line counts if it holds a word
    new_line = np.flatnonzero(data == 0x0A)
    edges = np.unique(np.concatenate([borders[:-1], new_line + 1]))
    edges = edges[edges < len(data)]
    stops = np.append(edges[1:], len(data))
    line_doc = np.searchsorted(borders, edges, "right") - 1
    ends_in_break = (stops > edges) & (data[stops - 1] == 0x0A)
    body_end = stops - ends_in_break
    solid = np.concatenate([[0], np.cumsum(~W._BLANK[data])])
    full = solid[body_end] > solid[edges]
    edges, body_end, line_doc = edges[full], body_end[full], line_doc[full]
    n_lines = np.bincount(line_doc, minlength=n_docs)
    inverse, count = _distinct_of(line_doc, W.hashes(data, edges, body_end))
    first_seen = np.zeros(len(count), np.int64)
    first_seen[inverse[::-1]] = line_doc[::-1]
    n_dup_lines = n_lines - np.bincount(first_seen, minlength=n_docs)

    triple, at = W.windows(hashed, words.doc, 3)
    covered = np.zeros(len(hashed) + 1, np.int64)
    if len(at):
        inverse, count = _distinct_of(words.doc[at], triple)
        twice = at[count[inverse] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 3, -1)
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return {"n_words": n_words, "word_chars": letters[borders[1:]] - letters[borders[:-1]],
            "n_symbols": symbols[borders[1:]] - symbols[borders[:-1]], "n_lines": n_lines, "n_dup_lines": n_dup_lines,
            "n_repeat_words": repeated[words.first[1:]] - repeated[words.first[:-1]]}


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """``doc_id, lang, source`` and the counts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch):
                counts = count_texts(part.column(3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array(counts[c], pa.int64()) for c in COUNTS)],
                                                 ["doc_id", "lang", "source", *COUNTS])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(lang_column).cast("string").alias("lang"),
                       F.col(source_column).cast("string").alias("source"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The measures, as whole numbers: parts per thousand, or hundredths of a letter."""

    def share(part: str, whole: str, scale: int) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * scale / F.col(whole))).otherwise(0).cast("long")

    return {"symbol_rate": share("n_symbols", "word_chars", 1000), "dup_line_rate": share("n_dup_lines", "n_lines", 1000),
            "repeat_rate": share("n_repeat_words", "n_words", 1000), "word_length": share("word_chars", "n_words", 100)}


def bucket(measure: str) -> Column:
    """Lower end of a value's bucket: exact below 32, beyond that the five leading bits are kept."""
    shift = f"greatest(0, length(bin({measure})) - 5)"
    return F.expr(f"shiftleft(shiftright({measure}, {shift}), {shift})")


def sketch(rows: DataFrame) -> DataFrame:
    """Counts ``n`` per ``lang, source, rule, bucket`` over rows that hold the measures.

    Equal combinations of buckets are counted before the rules are laid out below each other.
    """
    cells = rows.groupBy("lang", "source", *(bucket(m).alias(m) for m in MEASURES)).agg(F.count(F.lit(1)).alias("n"))
    laid_out = ", ".join(f"'{m}', {m}" for m in MEASURES)
    return merged(cells.select("lang", "source", "n", F.expr(f"stack({len(MEASURES)}, {laid_out}) as (rule, bucket)")), ["lang", "source"])


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of parts become one sketch per ``by``."""
    return sketches.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``total, q25, q50, q75, q95`` per group and rule: the bucket at which that share of the group is reached."""
    group = Window.partitionBy(*by, "rule")
    reached = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))

    def at(percent: int) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("bucket"))).alias(f"q{percent}")

    return reached.groupBy(*by, "rule").agg(F.max("total").alias("total"), at(25), at(50), at(75), at(95))


def thresholds(sketches: DataFrame, spreads: int = SPREADS, group_min: int = GROUP_MIN) -> DataFrame:
    """``low`` and ``high`` of each rule for every ``lang, source`` of the sketches, one row a group.

    A group with fewer than ``group_min`` documents takes the merged sketch of its language; if
    that is as small, the merged sketch of all.
    """
    own = quantiles(sketches, ["lang", "source"])
    by_lang = quantiles(merged(sketches, ["lang"]), ["lang"])
    of_all = quantiles(merged(sketches, []), [])
    names = ["total", "q25", "q50", "q75", "q95"]

    def renamed(df: DataFrame, level: str, keys: list[str]) -> DataFrame:
        return df.select(*(F.col(k).alias(f"{level}_{k}") for k in keys), *(F.col(n).alias(f"{level}_{n}") for n in names))

    joined = (own.join(renamed(by_lang, "l", ["lang", "rule"]), same(F.col("lang"), F.col("l_lang")) & (F.col("rule") == F.col("l_rule")))
              .join(renamed(of_all, "a", ["rule"]), F.col("rule") == F.col("a_rule")))

    def wider(value: Callable[[str], Column]) -> Column:
        return F.when(F.col("l_total") >= group_min, value("l_")).otherwise(value("a_"))

    def chosen(value: Callable[[str], Column]) -> Column:
        return F.when(F.col("total") >= group_min, value("")).otherwise(wider(value))

    def spread(level: str) -> Column:
        return F.col(f"{level}q75") - F.col(f"{level}q25")

    def tail(level: str) -> Column:
        return F.col(f"{level}q95")

    def of_rule(values: dict[str, int]) -> Column:
        return F.expr("case rule " + " ".join(f"when '{m}' then {value}" for m, value in values.items()) + " end")

    middle = chosen(lambda level: F.col(f"{level}q50"))
    reach = spreads * F.greatest(F.least(chosen(spread), wider(spread)), of_rule(FLOORS))
    by_tail = F.col("rule").isin(*TAILS)
    limits = joined.select("lang", "source", "rule", F.when(by_tail, 0).otherwise(middle - reach).alias("low"),
                           F.when(by_tail, F.least(chosen(tail), wider(tail)) + of_rule(TAILS)).otherwise(middle + reach).alias("high"))
    return limits.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")))


def _limits(rows: DataFrame, spreads: int, group_min: int) -> DataFrame:
    found = thresholds(sketch(rows.where(~F.col("base_failed"))), spreads, group_min)
    return found.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})


def _judged(rows: DataFrame, limits: DataFrame, lang: str, source: str) -> DataFrame:
    """``rows`` with ``failed``, the first rule that failed, and ``kept``."""
    joined = rows.join(limits, same(F.col(lang), F.col("of_lang")) & same(F.col(source), F.col("of_source")), "left").drop("of_lang", "of_source")
    failed = F.coalesce(*(F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)) for m in MEASURES))
    return joined.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("failed").isNull())


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
          spreads: int = SPREADS, group_min: int = GROUP_MIN) -> DataFrame:
    """Counts, measures, ``base_failed``, the rule that failed first (``failed``) and ``kept`` of every row.

    Sketches are taken over the rows that pass the base rules. A row fails a rule if its measure is
    outside the limits of its language and source. A null text counts as empty and fails the base
    rules. A null language or source is a group like any other. Repeated rows are judged alike.
    A group none of whose rows passes the base rules has no limits and needs none.
    """
    rows = measure(docs, id_column, text_column, lang_column, source_column)
    rows = written(docs.sparkSession, rows.withColumns(rates()).withColumn("base_failed", base_failed()), "measures")
    return _judged(rows, _limits(rows, spreads, group_min), "lang", "source")


def keep(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
         spreads: int = SPREADS, group_min: int = GROUP_MIN) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Texts are counted twice, once for the limits and once beside the row, so that no text is shuffled.
    """
    rows = measure(docs, id_column, text_column, lang_column, source_column)
    rows = written(docs.sparkSession, rows.withColumns(rates()).withColumn("base_failed", base_failed()), "measures")
    limits = written(docs.sparkSession, _limits(rows, spreads, group_min), "limits")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (text_column, lang_column, source_column)}
    plain = docs.toDF(*names)  # the names do not matter inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, text=at[text_column]):
                counts = count_texts(part.column(names.index(at[text_column])))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(counts[c], pa.int64()) for c in COUNTS)], [*names, *COUNTS])

    schema = StructType([*plain.schema.fields, *(StructField(c, LongType()) for c in COUNTS)])
    counted = plain.mapInArrow(run, schema).withColumns(rates()).withColumn("base_failed", base_failed())
    return _judged(counted, limits, at[lang_column], at[source_column]).where("kept").select(*names).toDF(*docs.columns)
