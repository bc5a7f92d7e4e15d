"""Alignment of two tokenizers' tokens, with corpus-wide counts by external spilling.

Each text is encoded with a byte-level vocabulary (A) and with a piece vocabulary (B). Wherever a token
of both ends at the same byte, the two ids are linked. Counting links over the corpus goes through spilled runs:

* a task gathers documents up to ``BATCH_BYTES`` of text, sorts their records (B id, A id, document) and cuts them into
  ``RADIXES`` runs by the B id. A run is a zstd directory of its pairs with their counts, and zstd postings of
  its documents, both in B-major order. Runs are rows of a table in the shared folder.
* the runs of a radix are dealt to parts of about ``PART_BYTES``; a task merges the directories of its part
  through a heap of runs, all records of one B id at a time. What parts have counted is summed per pair.
* the sums of a radix go to each of its parts. They are B-major too, so the highest count of a B id is known once its
  stretch is read, and the runs' postings turn into what each document gets. One row a run goes back to the batch.

A B id with a third of all links makes its radix larger, which then has more parts; no task holds more than
a part and the sums of a radix, whose number of pairs the two vocabularies bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .bpe import byte_letters
from .common import id_and_text, none_of, written
from .packing import WORDS_KEPT, Tokens

RADIXES = 64
BATCH_BYTES = 8 << 20
BATCH_DOCS = 1 << 14
PART_BYTES = 24 << 20
#: Bits of an A id, a B id and a document's number in its batch within one sort key.
A_BITS, B_BITS, DOC_BITS = 24, 20, 16

SPILLED = ("batch long, radix int, bytes long, pairs binary, postings binary, "
           "doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")
PAIRS = "b int, a int, n long"
SHARES = "batch long, shares binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# ---------------------------------------------------------------- tokens

class Pieces(Tokens):
    """Piece numbers of texts that begin with a blank, which the model adds by itself.

    No piece has a blank after another letter, so a text may be cut before every blank that follows another
    letter, and each distinct stretch goes to the model once.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.forget()

    def _numbers(self, words: list[str]) -> list[bytes]:
        blank = [self.model.piece_to_id("▁")]  # the model has nothing for an empty text
        return [np.array(ids or blank, "<u4").tobytes() for ids in self.model.encode([w[1:] for w in words], num_threads=1)]

    def encode_all(self, column: pa.Array) -> list[bytes]:
        data, borders = W.text_bytes(column)
        if len(data) == 0:
            return [b""] * (len(borders) - 1)
        opens = np.zeros(len(data), bool)
        opens[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        opens[borders[:-1]] = True
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(data))
        distinct, one, inverse = np.unique(W.hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self.hash) > WORDS_KEPT:
            self.forget()
        new, raw = np.flatnonzero(~self._known(distinct)), data.tobytes()
        self._learn(distinct[new], [raw[i:j].decode() for i, j in zip(begin[one[new]].tolist(), end[one[new]].tolist())])
        at = np.searchsorted(self.hash, distinct)[inverse]
        sizes = self.length[at].astype(np.int64)
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(stops[-1]) + np.repeat(self.start[at] - stops[:-1], sizes)].tobytes()
        limits = (4 * stops[np.searchsorted(begin, borders)]).tolist()
        return [ids[i:j] for i, j in zip(limits[:-1], limits[1:])]


class Aligner:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Tokens(path_a), Pieces(path_b)
        self.a.tokenizer.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters, model = byte_letters(), self.b.model
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            # added tokens may hold letters that stand for no byte; they are never produced
            self.bytes_a[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.bytes_a) > 1 << A_BITS or len(self.bytes_b) > 1 << B_BITS:
            raise ValueError("a vocabulary has more tokens than the sort keys hold")
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.written = [b"%d%c" % (i, c) for i in range(len(self.bytes_a)) for c in b",|"]
        self.written += [b"%d%c" % (i, c) for i in range(len(self.bytes_b)) for c in b",;"]

    def align(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text its numbers of A tokens, B tokens, groups and the groups' digest; the links as arrays (text, B id, A id).

        A null or empty text has no tokens, nor has one that either tokenizer does not give back byte by byte.
        """
        n_docs = len(column)
        texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(column.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()))
        data, borders = W.text_bytes(texts)
        raw = data.tobytes()
        empty = np.diff(borders) == 1
        found_a, found_b = self.a.encode_all(texts), self.b.encode_all(texts)
        table_a, table_b = self.bytes_a, self.bytes_b
        for doc, (i, j) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist())):
            if empty[doc] or (b"".join([table_a[t] for t in np.frombuffer(found_a[doc], "<u4").tolist()]) != raw[i:j]
                              or b"".join([table_b[t] for t in np.frombuffer(found_b[doc], "<u4").tolist()]) != raw[i:j]):
                found_a[doc] = found_b[doc] = b""
        n_a, n_b = (np.array([len(x) // 4 for x in found], np.int64) for found in (found_a, found_b))
        a, b = (np.frombuffer(b"".join(found), "<u4").astype(np.int64) for found in (found_a, found_b))
        if len(a) == 0:
            nothing = np.zeros(0, np.int64)
            return n_a, n_b, np.zeros(n_docs, np.int64), nothing, [""] * n_docs, nothing, nothing
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        # both cover the same bytes, so their ends are places on one line
        last_a = end_b[np.searchsorted(end_b, end_a)] == end_a
        last_b = end_a[np.searchsorted(end_a, end_b)] == end_b
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        doc = np.repeat(np.arange(n_docs), n_a)[at_a]
        group_a = np.cumsum(last_a) - last_a
        group_b = np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], at_b + 1])[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + (at_a + 1)[group_b]] = 2 * (len(table_a) + b) + last_b
        limits = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        table, order = self.written, order.tolist()
        digest = ["" if i == j else hashlib.sha256(b"".join([table[t] for t in order[i:j]])[:-1]).hexdigest() for i, j in zip(limits[:-1], limits[1:])]
        return n_a, n_b, np.bincount(doc, minlength=n_docs), doc, digest, b[at_b], a[at_a]


@lru_cache(maxsize=1)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# ---------------------------------------------------------------- runs

def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2**32 as one zstd block."""
    body = b"".join(np.asarray(c, "<u4").tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(body)


def unpacked(block: bytes, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), "<u4")
    return list(flat.reshape(columns, -1).astype(np.int64))


def spilled(keys: np.ndarray, radixes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """``radix, directory, postings`` of the records of a batch; a key holds B id, A id and document from its high bits down."""
    keys, n = np.unique(keys, return_counts=True)
    radix = (keys >> (A_BITS + DOC_BITS)) % radixes
    for r in np.unique(radix).tolist():
        mine = np.flatnonzero(radix == r)
        pair, each = keys[mine] >> DOC_BITS, n[mine]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        docs = np.diff(first, append=len(pair))
        yield r, packed(pair[first] >> A_BITS, pair[first] & ((1 << A_BITS) - 1), docs, np.add.reduceat(each, first)), packed(keys[mine] & ((1 << DOC_BITS) - 1), each)


def merged(directories: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """B ids, A ids and counts of several runs, B-major: a heap of runs gives the least B id and all runs that stand at it."""
    runs, heap = [], []
    for number, block in enumerate(directories):
        b, a, _, n = unpacked(block, 4)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        runs.append((a, n, b[first].tolist(), np.append(first, len(b)).tolist()))
        heap.append((runs[-1][2][0], number, 0))
    heapq.heapify(heap)
    out_b, out_a, out_n = [], [], []
    while heap:
        b, parts = heap[0][0], []
        while heap and heap[0][0] == b:
            _, number, step = heap[0]
            a, n, stands, first = runs[number]
            parts.append((a[first[step]: first[step + 1]], n[first[step]: first[step + 1]]))
            if step + 1 < len(stands):
                heapq.heapreplace(heap, (stands[step + 1], number, step + 1))
            else:
                heapq.heappop(heap)
        if len(parts) == 1:
            a, n = parts[0]
        else:
            a, n = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(a, kind="stable")
            a, n = a[order], n[order]
            first = np.flatnonzero(np.diff(a, prepend=-1))
            a, n = a[first], np.add.reduceat(n, first)
        out_b.append(np.full(len(a), b))
        out_a.append(a)
        out_n.append(n)
    return np.concatenate(out_b), np.concatenate(out_a), np.concatenate(out_n)


def shares(directory: bytes, postings: bytes, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> bytes:
    """What a run gives to its documents: ``document, links with the highest count, sum of counts``, zstd."""
    b, a, docs, _ = unpacked(directory, 4)
    doc, n = unpacked(postings, 2)
    at = np.repeat(np.searchsorted(keys, b << A_BITS | a), docs)
    order = np.argsort(doc, kind="stable")
    first = np.flatnonzero(np.diff(doc[order], prepend=-1))
    body = (doc[order][first], np.add.reduceat((n * best[at])[order], first), np.add.reduceat((n * counts[at])[order], first))
    return zstandard.ZstdCompressor(level=3).compress(b"".join(c.astype("<i8").tobytes() for c in body))


# ---------------------------------------------------------------- jobs

def spill(docs: DataFrame, path_a: str, path_b: str, radixes: int = RADIXES, batch_bytes: int = BATCH_BYTES,
          id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document, and a row per run with ``radix`` set. ``batch`` tells which documents a run's postings count."""
    schema = none_of(SPILLED).schema

    def rows(**columns) -> pa.RecordBatch:
        length = len(columns["batch"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(length, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        number, seen, held, keys = TaskContext.get().partitionId() << 33, 0, 0, []

        def runs() -> Iterator[pa.RecordBatch]:
            for radix, directory, postings in spilled(np.concatenate(keys), radixes) if keys else ():
                yield rows(batch=[number], radix=[radix], bytes=[len(directory) + len(postings)], pairs=[directory], postings=[postings])

        for batch in batches:
            for part in W.chunks(batch):
                if held >= batch_bytes or seen + part.num_rows > BATCH_DOCS:
                    yield from runs()
                    number, seen, held, keys = number + 1, 0, 0, []
                n_a, n_b, n_groups, doc, digest, b, a = aligner.align(part.column(1))
                keys.append((b << A_BITS | a) << DOC_BITS | (doc + seen))
                yield rows(batch=np.full(part.num_rows, number), doc=np.arange(seen, seen + part.num_rows), doc_id=part.column(0),
                           n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_groups, groups_sha256=digest)
                seen += part.num_rows
                held += len(W.text_bytes(part.column(1))[0])
        yield from runs()
        aligner_of.cache_clear()  # the worker lives on, and other work needs its memory

    return id_and_text(docs, id_column, text_column).mapInArrow(run, SPILLED)


def dealt(runs: DataFrame, radixes: int, part_bytes: int) -> tuple[DataFrame, list[int]]:
    """Runs with their ``part``, and the number of parts of every radix: at most ``radixes`` sums reach the driver."""
    sizes = {r["radix"]: r["bytes"] for r in runs.groupBy("radix").agg(F.sum("bytes").alias("bytes")).collect()}
    parts = [max(1, math.ceil(sizes.get(r, 0) / part_bytes)) for r in range(radixes)]
    return runs.withColumn("part", F.pmod(F.xxhash64("batch"), F.get(F.lit(parts), F.col("radix"))).cast("int")), parts


def count_pairs(runs: DataFrame) -> DataFrame:
    """``b, a, n``: how many links of the corpus hold each pair of ids."""

    schema = none_of(PAIRS).schema

    def run(table: pa.Table) -> pa.Table:
        return pa.table(list(merged(table["pairs"].to_pylist())), names=schema.names).cast(schema)

    return runs.select("radix", "part", "pairs").groupBy("radix", "part").applyInArrow(run, PAIRS).groupBy("b", "a").agg(F.sum("n").alias("n"))


def hand_back(runs: DataFrame, counts: DataFrame, parts: list[int]) -> DataFrame:
    """``batch, shares`` of every run, from its postings and the corpus-wide counts of its radix."""

    nothing = none_of(SHARES)

    def run(mine: pa.Table, sums: pa.Table) -> pa.Table:
        if mine.num_rows == 0:
            return nothing
        b, a, n = (np.asarray(sums[c]).astype(np.int64) for c in ("b", "a", "n"))
        keys = b << A_BITS | a
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.diff(keys >> A_BITS, prepend=-1))
        highest = np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(keys)))
        blocks = [shares(mine["pairs"][i].as_py(), mine["postings"][i].as_py(), keys, n, n == highest) for i in range(mine.num_rows)]
        return pa.table({"batch": mine["batch"], "shares": pa.array(blocks, pa.binary())})

    radix = F.col("b") % len(parts)
    sums = (counts.withColumn("radix", radix)
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.get(F.lit(parts), F.col("radix")) - 1))))
    keys = ["radix", "part"]
    return (runs.select(*keys, "batch", "pairs", "postings").groupBy(*keys)
            .cogroup(sums.select(*keys, "b", "a", "n").groupBy(*keys)).applyInArrow(run, SHARES))


def align(docs: DataFrame, path_a: str, path_b: str, radixes: int = RADIXES, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES,
          id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its tokens, groups and links, and how its links stand in the whole corpus.

    ``n_best`` counts links whose pair is the most frequent one of its B id (ties included), ``count_sum`` adds up
    the counts of their pairs. Null and empty texts, and those that a tokenizer does not give back, have zeros
    and an empty digest. Repeated rows and repeated or null ids are documents of their own. No rows, no result.
    """
    spark = docs.sparkSession
    table = written(spark, spill(docs, path_a, path_b, radixes, batch_bytes, id_column, text_column), "alignment")
    runs, parts = dealt(table.where(F.col("radix").isNotNull()), radixes, part_bytes)
    counts = written(spark, count_pairs(runs), "pair-counts")
    given = hand_back(runs, counts, parts)
    mine = table.where(F.col("radix").isNull()).select("batch", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    schema = none_of(RESULT).schema

    def finish(rows: pa.Table, gifts: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return schema.empty_table()
        doc = np.asarray(rows["doc"])
        best, total = np.zeros(doc.max() + 1, np.int64), np.zeros(doc.max() + 1, np.int64)
        for block in gifts["shares"].to_pylist():
            at, n_best, count_sum = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), "<i8").reshape(3, -1)
            best[at] += n_best
            total[at] += count_sum
        columns = {c: rows[c] for c in rows.column_names} | {"n_best": pa.array(best[doc]), "count_sum": pa.array(total[doc])}
        return pa.table([columns[f.name] for f in schema], schema=schema)

    return mine.groupBy("batch").cogroup(given.groupBy("batch")).applyInArrow(finish, RESULT)
