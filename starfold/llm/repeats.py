"""Removal of long passages that occur earlier, by suffix trees over prefix groups.

A window is ``length`` consecutive words. Every window has an anchor, its five words of least hash.
Neighbouring windows mostly share their anchor; they form one segment, and equal windows lie in
segments of equal anchors. So suffixes are grouped by the words of their anchor as their prefix, and a
group in which nothing repeats is dropped at once.

* Segments that are equal as a whole need no tree: all but the earliest are repeats throughout.
* Groups with different segments become trees. The suffixes of a group, cut at ``length`` words, are
  sorted with their common prefix lengths; that is the tree in array form, and each inner node at depth
  ``length`` is a repeat with its places. All but the earliest are marked.
* Where too many segments share an anchor, the prefix is made longer: each window goes to the group of
  all its words. Anchors of this kind are found in a sample; the choice changes no result.

Documents are dealt by hash into parts of some megabytes. Equal segments are combined in their part
before they are shuffled, and a part is only told what concerns it, so that a passage found in a third
of all documents costs one row a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import none_of

ANCHOR_WORDS = 5
PART_BYTES = 8 << 20
#: A part is looked at in pieces of this size.
PIECE_BYTES = 256 << 10
#: Anchors with this many segments in a sample of one document of SAMPLE_ONE_OF are split by whole windows.
SPLIT_FROM = 100
SPLIT_KEPT = 20_000
SAMPLE_ONE_OF = 64
NO_ID = -(1 << 63)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Segments(NamedTuple):
    """Runs of windows with one anchor. ``first`` counts words from the start of the part, ``start`` from that of the document."""

    words: W.Words
    hashed: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    start: np.ndarray
    n_windows: np.ndarray
    anchor: np.ndarray
    key: np.ndarray


def segments(column: pa.Array, length: int) -> Segments:
    data, borders = W.text_bytes(column)
    words = W.split(data, borders)
    hashed = W.hashes(data, words.begin, words.end)
    none = np.zeros(0, np.int64)
    n = len(hashed) - length + 1
    inside = np.flatnonzero(words.doc[:n] == words.doc[length - 1:]) if n > 0 else none
    if not len(inside):
        return Segments(words, hashed, none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    grams, at = W.windows(hashed, words.doc, ANCHOR_WORDS)
    value = np.full(len(hashed), _NONE)
    value[at] = np.minimum(grams, _NONE - np.uint64(1))
    wide = length - ANCHOR_WORDS + 1
    anchor = sliding_window_view(value, wide)[: n].argmin(axis=1)[inside] + inside
    doc = words.doc[inside]
    fresh = np.ones(len(inside), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    opens = np.flatnonzero(fresh)
    first, place, doc = inside[opens], anchor[opens], doc[opens]
    n_windows = np.diff(np.append(opens, len(inside)))
    stop = first + n_windows + length - 1
    powers, inverse = W._tables(len(hashed) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * powers[: len(hashed)])])
    shape = ((place - first).astype(np.uint64) << np.uint64(32)) + n_windows.astype(np.uint64)
    key = W.mix(W.mix((sums[stop] - sums[first]) * inverse[first]) + shape)
    return Segments(words, hashed, doc, first, first - words.first[doc], n_windows, value[place], key)


def _earliest(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the earliest row of each key, and the number of its rows."""
    order = np.lexsort((start, doc, key))
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    opens = np.flatnonzero(fresh)
    return order[opens], np.diff(np.append(opens, len(order)))


def marked(rows: pa.Table, length: int) -> np.ndarray:
    """Bit ``j`` of each row is set if window ``j`` of its segment occurs earlier in another row.

    The tree of the suffixes: sorted, with common prefix lengths between neighbours. Neighbours that
    agree in all ``length`` words hang below the same inner node of that depth.
    """
    stored = rows["words"].to_pylist()
    runs = [np.frombuffer(w, np.uint64) for w in stored]
    sizes = np.array([len(r) for r in runs])
    codes = np.unique(np.concatenate(runs), return_inverse=True)[1].astype(">u4")
    n_windows = sizes - length + 1
    owner = np.repeat(np.arange(len(runs)), n_windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = np.repeat(np.cumsum(sizes) - sizes, n_windows) + offset
    suffixes = np.ascontiguousarray(sliding_window_view(codes, length)[at])
    order = np.argsort(suffixes.view(f"S{4 * length}").reshape(-1), kind="stable")
    suffixes = suffixes[order]
    differs = suffixes[1:] != suffixes[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    # runs of neighbours with a common prefix of full length are the inner nodes at that depth
    node = np.concatenate([[0], np.cumsum(common < length)])
    doc = rows["doc_id"].to_numpy()[owner]
    place = rows["start"].to_numpy()[owner] + offset
    by_place = np.lexsort((place, doc))
    later = (doc[by_place][1:] != doc[by_place][:-1]) | (place[by_place][1:] != place[by_place][:-1])
    rank = np.empty(len(owner), np.int64)
    rank[by_place] = np.concatenate([[0], np.cumsum(later)])
    first = np.minimum.reduceat(rank[order], np.flatnonzero(np.concatenate([[True], common < length])))
    repeat = order[rank[order] != first[node]]
    bits = np.zeros(len(runs), np.int64)
    np.bitwise_or.at(bits, owner[repeat], np.int64(1) << offset[repeat])
    return bits


def kept_texts(words: W.Words, n_docs: int, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words that stay, joined by one blank in each text, and the borders of the texts."""
    data = np.where(W._BLANK[words.data], np.uint8(0x20), words.data)
    stay = np.flatnonzero(~gone)
    edge = np.zeros(len(data) + 2, np.int32)
    doc = words.doc[stay]
    joined = np.zeros(len(stay), np.int64)
    joined[:-1] = doc[1:] == doc[:-1]  # a blank after each word but the last that stays
    np.add.at(edge, words.begin[stay], 1)
    np.add.at(edge, words.end[stay] + joined, -1)
    mask = np.cumsum(edge[: len(data)]) > 0
    before = np.concatenate([[0], np.cumsum(mask)])
    limits = np.zeros(n_docs + 1, np.int64)
    ends = np.zeros(n_docs, np.int64)
    np.maximum.at(ends, doc, before[words.end[stay]])
    limits[1:] = np.maximum.accumulate(ends)
    return data[mask].tobytes(), limits


OCCURRENCE = "part int, anchor long, key long, doc_id long, start int, n_windows int, n int"
TREE = "bin int, part int, key long, doc_id long, start int, shift int, words binary"
MARK = "part int, key long, doc_id long, start int, bits long"


def _sample(docs: DataFrame, length: int) -> np.ndarray:
    """Anchors that very many different segments share, at most ``SPLIT_KEPT``, sorted."""

    def run(batches):
        for batch in batches:
            for part in W.chunks(batch):
                found = segments(part.column(1), length)
                anchor = found.anchor[np.unique(found.key, return_index=True)[1]]
                value, count = np.unique(anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], ["anchor", "n"])

    sample = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_ONE_OF)) == 0)
    counted = sample.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= SPLIT_FROM)
    found = counted.orderBy(F.desc("n"), "anchor").limit(SPLIT_KEPT).collect()
    return np.sort(np.array([r[0] for r in found], np.int64))


def remove(docs: DataFrame, length: int = 20, id_column: str = "doc_id", text_column: str = "text", digest: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` without words that a window covers whose words also start earlier.

    Earlier is in a row with a smaller id, or in the same row further ahead; a null id comes first.
    Windows are judged on the texts as given. Rows of the same id are one place: none of them is
    earlier than the other. A text that loses words becomes its other words joined by one blank; all
    other texts, null ones among them, stay as they are. All columns of ``docs`` are returned, and
    ``n_words, n_removed``. With ``digest`` the columns are ``doc_id, n_words, n_removed,
    kept_sha256``, the digest being of the words that stay, joined by one blank, in any case.
    """
    if not ANCHOR_WORDS <= length <= 60:
        raise ValueError(f"windows of {ANCHOR_WORDS} to 60 words")
    text_bytes = docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
    parts = int(text_bytes // part_bytes) + 1
    base = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_column).cast("string").alias("text"),
                       *([] if digest else [F.struct(*docs.columns).alias("row")]))
    split = _sample(base, length)
    # by text as well, so that an id, or none, that many rows have does not fill one part
    dealt = base.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))

    def occurrences(rows: pa.Table) -> pa.Table:
        held = []
        for some in _pieces(rows):
            found = segments(some.column("text"), length)
            held.append((found.key, some.column("doc_id").to_numpy()[found.doc], found.start, found.anchor, found.n_windows))
        key, doc, start, anchor, n_windows = map(np.concatenate, zip(*held))
        at, n = _earliest(key, doc, start)
        return pa.table({"part": np.full(len(at), rows["part"][0].as_py(), np.int32), "anchor": anchor[at].view(np.int64), "key": key[at].view(np.int64),
                         "doc_id": doc[at], "start": start[at].astype(np.int32), "n_windows": n_windows[at].astype(np.int32), "n": n.astype(np.int32)})

    seen = dealt.groupBy("part").applyInArrow(occurrences, OCCURRENCE)
    wide = docs.sparkSession.createDataFrame([(int(a),) for a in split], "split long")
    seen = (seen.join(F.broadcast(wide), F.col("anchor") == F.col("split"), "left")  # at most SPLIT_KEPT rows
            .withColumn("wide", F.col("split").isNotNull()).withColumn("own", F.when(F.col("wide"), F.pmod("key", F.lit(4096))).otherwise(-1)).drop("split"))
    group, equal = Window.partitionBy("anchor", "own"), Window.partitionBy("anchor", "own", "key")
    judged = (seen.repartition("anchor", "own")
              .withColumn("origin", F.min(F.struct("doc_id", "start")).over(equal)).withColumn("total", F.sum("n").over(equal))
              .withColumn("several", F.col("wide") | (F.min("key").over(group) != F.max("key").over(group)))
              .where((F.col("total") > 1) | F.col("several")))
    # both uses need all columns, so that one exchange serves both
    copies = (judged.where("total > 1").select("part", "key", F.col("origin.doc_id").alias("doc_id"), F.col("origin.start").alias("start"), (-F.col("n_windows") - F.col("several").cast("int")).cast("long").alias("bits")))
    needed = (judged.where(F.col("several") & (F.col("origin.doc_id") == F.col("doc_id")) & (F.col("origin.start") == F.col("start")))
              .select("part", "anchor", "key", "doc_id", "start", "n_windows", "wide", "total"))
    bins = 2 * parts
    no_work, out = none_of(TREE), "doc_id long, n_words long, n_removed long, kept_sha256 string" if digest else _schema(docs)
    no_rows = none_of(out)

    def work(rows: pa.Table, need: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or need.num_rows == 0:
            return no_work
        return pa.concat_tables([_windows_of(some, need, length, bins) for some in _pieces(rows)])

    def tree(rows: pa.Table) -> pa.Table:
        shift = rows["shift"].to_numpy()
        moved = rows.set_column(rows.schema.get_field_index("start"), "start", pa.array(rows["start"].to_numpy() + shift))
        bits = marked(moved, length) << shift
        hit = np.flatnonzero(bits)
        return pa.table({"part": rows["part"].to_numpy()[hit], "key": rows["key"].to_numpy()[hit], "doc_id": rows["doc_id"].to_numpy()[hit],
                         "start": rows["start"].to_numpy()[hit], "bits": bits[hit]})

    trees = dealt.groupBy("part").cogroup(needed.groupBy("part")).applyInArrow(work, TREE).groupBy("bin").applyInArrow(tree, MARK)
    marks = copies.unionByName(trees)

    def finish(rows: pa.Table, marks: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return no_rows
        return pa.concat_tables([_without(some, marks, length, text_column, digest) for some in _pieces(rows)])

    return dealt.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(finish, out)


def _schema(docs: DataFrame) -> str:
    clash = {"n_words", "n_removed"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken; rename them first")
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_words long", "n_removed long"])


def _pieces(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    return W.chunks(rows.combine_chunks().to_batches()[0], size=PIECE_BYTES)


def _windows_of(rows: pa.RecordBatch, need: pa.Table, length: int, bins: int) -> pa.Table:
    """Words of the segments in ``need`` that lie in ``rows``: each as a whole, or where ``wide`` each of its windows by itself."""
    found = segments(rows.column("text"), length)
    place = _place(rows.column("doc_id").to_numpy()[found.doc], found.start, found.key)
    order = np.argsort(place, kind="stable")
    wanted = _place(need["doc_id"].to_numpy(), need["start"].to_numpy(), need["key"].to_numpy().view(np.uint64))
    if len(place):
        at = order[np.minimum(np.searchsorted(place[order], wanted), len(order) - 1)]
        here = np.flatnonzero(place[at] == wanted)
        at = at[here]
    else:
        here = at = np.zeros(0, np.int64)
    wide = need["wide"].to_numpy()[here]
    n = np.where(wide, found.n_windows[at], 1)
    row = np.repeat(np.arange(len(at)), n)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = found.first[at][row] + shift
    stop = begin + np.where(wide[row], 1, found.n_windows[at][row]) + length - 1
    held = found.hashed.tobytes()
    goal = np.where(wide[row], _window_hash(found.hashed, begin, length), W.mix(need["anchor"].to_numpy().view(np.uint64)[here][row])) % np.uint64(bins)
    return pa.table({"bin": goal.astype(np.int32), "part": need["part"].to_numpy()[here][row], "key": need["key"].to_numpy()[here][row], "doc_id": need["doc_id"].to_numpy()[here][row],
                     "start": need["start"].to_numpy()[here][row], "shift": shift.astype(np.int32),
                     "words": pa.array([held[8 * b: 8 * s] for b, s in zip(begin.tolist(), stop.tolist())], pa.binary())})


def _place(doc: np.ndarray, start: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for a segment and where it is; the key tells rows of the same id apart."""
    return W.mix(W.mix(doc.view(np.uint64)) + start.astype(np.uint64)) + key


def _window_hash(hashed: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    total = np.zeros(len(begin), np.uint64)
    for j in range(length):
        total = W.mix(total + hashed[begin + j])
    return total


def _without(rows: pa.RecordBatch, marks: pa.Table, length: int, text_column: str, digest: bool) -> pa.Table:
    """Rows of one part, as ``remove`` returns them."""
    found = segments(rows.column("text"), length)
    ids = rows.column("doc_id").to_numpy()
    n_docs = len(ids)
    bits = np.zeros(len(found.key), np.int64)
    if marks.num_rows and len(bits):
        doc = ids[found.doc]
        whole = marks["bits"].to_numpy() < 0
        every = (np.int64(1) << found.n_windows) - 1
        key, origin, start = (marks[c].to_numpy()[whole] for c in ("key", "doc_id", "start"))
        if len(key):
            order = np.argsort(key, kind="stable")
            at = order[np.minimum(np.searchsorted(key[order], found.key.view(np.int64)), len(order) - 1)]
            copy = (key[at] == found.key.view(np.int64)) & ((origin[at] != doc) | (start[at] != found.start))
            bits[copy] = every[copy]
        own, begin, kind, some = (marks[c].to_numpy()[~whole] for c in ("doc_id", "start", "key", "bits"))
        place = _place(own, begin, kind.view(np.uint64))
        if len(place):
            order = np.argsort(place, kind="stable")
            place, opens = np.unique(place[order], return_index=True)
            some = np.bitwise_or.reduceat(some[order], opens)
            here = _place(doc, found.start, found.key)
            at = np.minimum(np.searchsorted(place, here), len(place) - 1)
            bits |= np.where(place[at] == here, some[at], 0)
    words = found.words
    edge = np.zeros(len(found.hashed) + 1, np.int64)
    for j in range(length - ANCHOR_WORDS + 1):
        hit = found.first[(bits >> j) & 1 == 1] + j
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    n_words = np.diff(words.first)
    lost = np.concatenate([[0], np.cumsum(gone)])
    n_removed = lost[words.first[1:]] - lost[words.first[:-1]]
    kept, limits = kept_texts(words, n_docs, gone)
    own = pa.array(np.where(ids == NO_ID, 0, ids), mask=ids == NO_ID)
    if digest:
        view = memoryview(kept)
        named = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]
        return pa.table({"doc_id": own, "n_words": n_words, "n_removed": n_removed, "kept_sha256": named})
    texts = [kept[a:b].decode() if r else t for a, b, r, t in zip(limits[:-1].tolist(), limits[1:].tolist(), n_removed.tolist(), rows.column("text").to_pylist())]
    row = rows.column("row")
    columns = {f.name: pa.array(texts, pa.string()) if f.name == text_column else pc.struct_field(row, i) for i, f in enumerate(row.type)}
    return pa.table(columns | {"n_words": n_words, "n_removed": n_removed})
