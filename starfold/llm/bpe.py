"""BPE encoding by backtracking over longest matches, and decoding through an offset table.

A word is encoded in time linear in its length. All tokens that occur in it are found by one
Aho-Corasick pass. From the left the longest token is taken that may follow the token before it;
where none may, the last token is given up for the next shorter one and the place it led to is
never tried again. Two tokens may follow each other if merging their joined text would yield just
these two. That is decided by undoing merges from the border outwards, and kept per pair.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text

WORDS_KEPT = 400_000
PAIRS_KEPT = 1_000_000
#: White space as the tokenizer's patterns know it.
SPACE = r"\t-\r \x85\xa0  -     　"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: visible Latin-1 letters for themselves, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Merges of a vocabulary file, with words as strings of one symbol per byte.

    A byte that ends a word is another symbol (256 higher) where the vocabulary marks word ends.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        self.word_end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        letters = byte_letters()

        def symbols(token: str) -> str:
            ends = bool(self.word_end) and token.endswith(self.word_end)
            body = [letters[c] for c in (token[: -len(self.word_end)] if ends else token)]
            if ends:
                body[-1] += 256
            return "".join(map(chr, body))

        special = set(self.special.values())
        self.tokens = {symbols(t): i for t, i in self.vocab.items() if i not in special}
        self.finder = ahocorasick.Automaton()
        for token, number in self.tokens.items():
            self.finder.add_word(token, (number, len(token)))
        self.finder.make_automaton()
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            a, b, made = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.merged.setdefault((a, b), rank)
            if made not in self.parts:
                self.parts[made], self.rank[made] = (a, b), rank
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of ``left`` and ``right`` side by side end in just these two."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= PAIRS_KEPT:
                self._fits.clear()
            known = self._fits[(left, right)] = self._border_stays(left, right)
        return known

    def _border_stays(self, left: int, right: int) -> bool:
        a, b = left, right
        undone = len(self.merged)  # rank of the merge undone last: an earlier one across the border would win
        from_right = False
        while True:
            across = self.merged.get((a, b))
            if across is not None and (across < undone or across == undone and from_right):
                return False
            rank_a, rank_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b or rank_a == rank_b:
                undone, from_right = (rank_a, False) if rank_a > rank_b else (rank_b, True)
            else:
                undone, from_right = rank_b, True
            if from_right:
                b = self.parts[b][0]
            else:
                a = self.parts[a][1]

    def encode_word(self, word: str) -> list[int]:
        """Token numbers of one word that the pattern has split off."""
        symbols = word.encode("utf-8", "surrogatepass").decode("latin-1")
        if self.word_end:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + 256)
        whole = self.tokens.get(symbols)
        if whole is not None:
            return [whole]
        end = len(symbols)
        options: list[list[tuple[int, int]]] = [[] for _ in range(end)]
        for last, (number, length) in self.finder.iter(symbols):
            options[last + 1 - length].append((number, last + 1))
        dead = [False] * (end + 1)
        taken: list[tuple[int, int, int]] = []
        at, choice = 0, len(options[0]) - 1
        while at < end:
            here = options[at]
            before = taken[-1][0] if taken else -1
            while choice >= 0:
                number, stop = here[choice]
                if not dead[stop] and (before < 0 or self.fits(before, number)):
                    break
                choice -= 1
            if choice >= 0:
                taken.append((number, at, choice))
                at = stop
                choice = len(options[at]) - 1 if at < end else 0
            else:
                dead[at] = True
                _, at, choice = taken.pop()
                choice -= 1
        return [number for number, _, _ in taken]

    def offset_table(self) -> tuple[np.ndarray, np.ndarray]:
        """All token texts in one run of bytes, each with a blank after it, and where each begins."""
        texts = [b""] * (max([*self.vocab.values(), *self.special.values()], default=-1) + 1)
        for token, number in [*self.vocab.items(), *self.special.items()]:
            texts[number] = token.encode() + b" "
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=begins[1:])
        return np.frombuffer(b"".join(texts), np.uint8), begins


class _WordBytes(dict):
    """Word -> its token numbers as little-endian bytes; filled on demand, emptied when it is large."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.codec.encode_word(word), "<u4").tobytes()
        self[word] = found
        return found


class TextCodec:
    """Whole texts to token numbers and back, for vocabularies of lower-cased words."""

    def __init__(self, path: str):
        self.codec = Codec(path)
        self.words = _WordBytes(self.codec)
        self.find = regex.compile(WORD_PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.codec.special)) + ")").split if self.codec.special else None
        self.blob, self.begins = self.codec.offset_table()

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each character by itself: a final sigma is no special case
                text = text.replace("Σ", "σ")
        return b"".join(map(self.words.__getitem__, self.find(text.lower())))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit token numbers of a text."""
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        special = self.codec.special
        return b"".join(np.array([special[p]], "<u4").tobytes() if p in special else self._plain(p) for p in self.cut(text))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of the tokens, one blank between two."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(numbers) == 0:
            return b""
        begin = self.begins[numbers]
        length = self.begins[numbers + 1] - begin
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(begin - ends + length, length)
        return self.blob[at].tobytes()[:-1]


@lru_cache(maxsize=2)
def text_codec(path: str) -> TextCodec:
    return TextCodec(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) of every row; a null or empty text has no tokens, a null id stays null.

    ``path`` is the vocabulary file, at the same place on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = text_codec(path)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(codec.encode(batch.column(1)[i].as_py() or ""), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.ListArray.from_arrays([0, len(ids)], pa.array(ids))], ["doc_id", "ids"])

    return id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of the rows of ``encode``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = text_codec(path)
        for batch in batches:
            texts = [None if ids is None else codec.decode(np.array(ids, "<u4").tobytes()).decode("utf-8") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token count, digest of the numbers and digest of the decoded text of every row, in one pass.

    A null or empty text has no tokens and decodes to the empty text. Rows are independent:
    repeated rows, null ids and any other columns change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = text_codec(path)
        for batch in batches:
            counts, ids_digest, text_digest = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                text_digest.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.words.clear()  # the worker lives on, and other work needs its memory

    return id_and_text(docs, id_column, text_column).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
