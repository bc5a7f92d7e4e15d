"""Fold-in as state: what a user's ratings add up to, changed by the ratings that arrive.

A user's state is the Gram matrix of their rows ``[item vector, rating - mean - item bias, 1]`` and their latest
rating per item. A new rating is a rank-one update of the matrix, a changed one a downdate by the old row and an
update by the new one; a rating that is older than the stored one changes nothing. So a batch costs what
arrives in it, at any length of the history. The latest ratings are kept in chunks by item, and only the
chunks of arriving items are read. Every access to the state is a call to the JVM, so a user has one packed chunk
beside the sums at first, read and written with them; when the chunks are full their ratings are dealt to twice as many.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from starfold.operators.ridge import RidgeSpec, solve_grams

#: Ratings that a user's chunks hold on the average before there are more chunks.
CHUNK_ITEMS = 512
USERS = "userId long, alpha double, n long, vec array<double>, bias double, status string"


def chunk_of(items: np.ndarray, chunks: int) -> np.ndarray:
    """Chunk of each item; ``chunks`` is a power of two."""
    mixed = items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.int64) & (chunks - 1)


#: Latest ratings of a chunk, sorted by item.
RATED = np.dtype([("item", "<i8"), ("rating", "<f8"), ("line", "<i8")])
#: Line of a rating without one: any other is later.
NO_LINE = np.iinfo(np.int64).min


def last_lines(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Usable ratings of a batch, vectors and biases, one row per item: the last line's, of these the highest rating."""
    vec, rating, line, item = (frame[c].to_numpy() for c in ("vec", "rating", "line_no", "movieId"))
    usable = np.flatnonzero(frame["vec"].notna().to_numpy() & ~np.isnan(rating))
    order = usable[np.lexsort((rating[usable], line[usable]))[::-1]]
    _, first = np.unique(item[order], return_index=True)
    order = order[first]
    rows = np.empty(len(order), RATED)
    rows["item"], rows["rating"] = item[order], rating[order]
    rows["line"] = np.where(np.isnan(line[order]), NO_LINE, line[order]) if line.dtype.kind == "f" else line[order]
    return rows, np.array(vec[order].tolist(), np.float64), frame["bias"].to_numpy(np.float64)[order]


def changed(chunk: np.ndarray, arrived: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk with arriving ratings, which of them count, which of these replace another, and the ratings replaced.

    Both have one row per item, sorted by item. A rating counts if its line is later than the stored one's.
    """
    at = np.searchsorted(chunk["item"], arrived["item"])
    there = np.zeros(len(arrived), bool)
    inside = at < len(chunk)
    there[inside] = chunk["item"][at[inside]] == arrived["item"][inside]
    counts = ~there
    counts[there] = arrived["line"][there] > chunk["line"][at[there]]
    replaces = counts & there
    old = chunk["rating"][at[replaces]]
    out = chunk.copy()
    out[at[replaces]] = arrived[replaces]
    fresh = ~there
    return np.insert(out, at[fresh], arrived[fresh]), counts, replaces, old


class TasteState(StatefulProcessor):
    """Rows ``movieId, rating, line_no, vec, bias`` of a user -> their solution for every penalty.

    The key is the user's id, and whether there is none.
    """

    def __init__(self, mean: float, alphas: Sequence[float], min_rows: int = 2):
        self.mean, self.alphas, self.min_rows = mean, tuple(map(float, alphas)), min_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "chunk int", "ratings binary")
        # ``ratings``: those of a user's only chunk
        self.sums = handle.getValueState("sums", "gram binary, items long, chunks int, ratings binary")

    def _rows(self, vectors: np.ndarray, bias: np.ndarray, rating: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors, rating - self.mean - bias, np.ones(len(rating))])

    def _chunk(self, number: int) -> np.ndarray:
        stored = self.latest.getValue((number,))
        return np.frombuffer(b"" if stored is None else stored[0], RATED)

    def _dealt(self, some: dict[int, np.ndarray], chunks: int, known: int) -> tuple[dict[int, np.ndarray], int]:
        """All ratings of a user, of which ``some`` chunks are in memory, in more chunks."""
        every = np.concatenate([some[n] if n in some else self._chunk(n) for n in range(chunks)])
        while known > CHUNK_ITEMS * chunks:
            chunks *= 2
        every = every[np.argsort(every["item"])]
        place = chunk_of(every["item"], chunks)
        order = np.argsort(place, kind="stable")
        borders = np.searchsorted(place[order], np.arange(chunks + 1))
        return {n: every[order[borders[n]:borders[n + 1]]] for n in range(chunks)}, chunks

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived, vectors, bias = last_lines(pd.concat(list(rows), ignore_index=True))
        held = self.sums.get()
        gram, known, chunks, only = (None, 0, 1, b"") if held is None else held
        if gram is not None:
            gram = np.frombuffer(gram)
            gram = gram.reshape(2 * (round(len(gram) ** 0.5),))
        touched, add, take, replaced = {}, [], [], []
        place = chunk_of(arrived["item"], chunks)
        for number in np.unique(place).tolist():
            at = np.flatnonzero(place == number)
            before = np.frombuffer(only, RATED) if chunks == 1 else self._chunk(number)
            chunk, counts, replaces, old = changed(before, arrived[at])
            if counts.any():
                touched[number], known = chunk, known + len(chunk) - len(before)
                add.append(at[counts])
                take.append(at[replaces])
                replaced.append(old)
        if touched:
            if known > CHUNK_ITEMS * chunks:
                touched, chunks = self._dealt(touched, chunks, known)
            if chunks == 1:
                only = touched[0].tobytes()
            else:
                only = b""
                for number, chunk in touched.items():
                    self.latest.updateValue((number,), (chunk.tobytes(),))
            add, take = np.concatenate(add), np.concatenate(take)
            new = self._rows(vectors[add], bias[add], arrived["rating"][add])
            old = self._rows(vectors[take], bias[take], np.concatenate(replaced))
            gram = new.T @ new - old.T @ old + (0 if gram is None else gram)
            self.sums.update((gram.tobytes(), known, chunks, only))
        yield self.solved(None if key[1] else key[0], gram)

    def solved(self, user: int | None, gram: np.ndarray | None) -> pd.DataFrame:
        n = 0 if gram is None else round(gram[-1, -1])
        out = []
        for alpha in self.alphas:
            if n < max(self.min_rows, 1):
                out.append((user, alpha, n, None, None, "too_few"))
                continue
            spec = RidgeSpec(alphas=(alpha,), min_rows=self.min_rows)
            vec, bias, _, _ = solve_grams(gram[None], np.zeros((1, gram.shape[0] - 1)), alpha, spec)
            out.append((user, alpha, n, vec[0].tolist(), float(bias[0]), "ok"))
        return pd.DataFrame(out, columns=["userId", "alpha", "n", "vec", "bias", "status"])

    def close(self) -> None:
        pass
