"""Product quantisation of vectors with exact integer codebooks.

Components become ``floor(256 * x)``; vectors are cut into equal parts, and each
part position has a codebook of at most ``entries`` entries, begun with the parts
of the smallest ids. A round assigns every part to its nearest entry and moves
each entry to the floored mean of its parts.

Assignment is an exponion search. An entry at least as near to a part as its
previous entry ``a`` (at squared distance ``u``) lies within twice that distance of
``a`` by the triangle inequality, so only entries with squared distance ``<= 4 u``
from ``a`` are scanned, in the order of their distance from it. Distances are
integers, so neither the radius nor a tie (to the lower index) depends on rounding.

Only codebooks pass through the driver (``entries`` rows of one vector each).
The previous codes are stored beside the vectors, so every round is one pass
over the rows and one sum per entry and component with partial sums in each task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize, materialize_at
from .common import fresh, lean, packed

#: Components are multiples of one part in SCALE.
SCALE = 256


@dataclass
class Codebooks:
    """``books``: entries by part, entry and position within the part; none if no vector was kept."""

    books: np.ndarray

    def sha256(self) -> str:
        """Hash of all components as decimals, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


class Neighbours:
    """A codebook's entries sorted by distance from each entry, and the error that each place suffices for."""

    def __init__(self, book: np.ndarray):
        self.book = book
        apart = ((book[:, None] - book[None]) ** 2).sum(2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        # an entry at squared distance D from a is in reach of error u if D <= 4 u
        self.reach = (np.take_along_axis(apart, self.order, 1) + 3) // 4

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of ``x``, found from the entry ``start``."""
        best, least = start.copy(), ((x - self.book[start]) ** 2).sum(1)
        scans = np.zeros(len(x), np.int64)
        for a in np.unique(start).tolist():
            at = start == a
            scans[at] = np.searchsorted(self.reach[a], least[at], "right")
        rows = np.argsort(-scans, kind="stable")
        falling = -scans[rows]
        for place in range(int(scans.max(initial=0))):
            some = rows[: np.searchsorted(falling, -place, "left")]
            entry = self.order[start[some], place]
            apart = ((x[some] - self.book[entry]) ** 2).sum(1)
            better = (apart < least[some]) | ((apart == least[some]) & (entry < best[some]))
            best[some[better]], least[some[better]] = entry[better], apart[better]
        return best, least


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("c").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assign(books: np.ndarray):
    """Rows with ``code`` and ``error`` against ``books``, each part searched from its entry in the old ``code``."""
    parts, _, width = books.shape
    near = [Neighbours(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, parts * width).reshape(-1, parts, width)
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            code, error = np.empty_like(old), np.zeros(len(x), np.int64)
            for p in range(parts):
                found, apart = near[p].nearest(x[:, p], old[:, p].astype(np.int64))
                code[:, p] = found
                error += apart
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["code"] = pa.array([row.tobytes() for row in code], pa.binary())
            columns["error"] = pa.array(error, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _sums(parts: int, entries: int, width: int):
    """One row for each entry's component that a task has parts of: their sum and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch, parts * width).reshape(-1, parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        columns = {"part": np.repeat(p, width), "entry": np.repeat(e, width), "place": np.tile(np.arange(width), len(p))}
        columns |= {"total": total[p, e].ravel(), "n": np.repeat(count[p, e], width)}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    return run


def vectors_of(df: DataFrame, vector: str, parts: int) -> tuple[DataFrame, int]:
    """``r`` (the row), ``c`` (integer components) of the kept rows, and their dimension (0 if none is kept)."""
    v = F.col(f"`{vector}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    whole = (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, finite)
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    kept = df.filter(F.coalesce(whole, F.lit(False)))
    biggest = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    sizes = kept.groupBy(F.size(v).alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(biggest).alias("most"))
    found = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if found is None:
        return df.limit(0).select(packed(df).alias("r"), F.array().cast("array<long>").alias("c")), 0
    if found.most * SCALE + 1 > math.isqrt(2**61 // found.dim):
        raise ArithmeticError(f"components up to {found.most} are too large for exact distances in 64 bits")
    return kept.filter(F.size(v) == found.dim).select(packed(df).alias("r"), scaled.alias("c")), found.dim


def compress(
    df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2
) -> tuple[DataFrame, Codebooks]:
    """The kept rows of ``df`` with ``code`` (a byte for each part) and ``error``, and the codebooks.

    Rows whose vector is null or empty, holds a null or non-finite component, or is
    not of ``parts`` equal parts are dropped, and of several dimensions the commonest
    (of these the largest) stays. Codebooks begin with the smallest ids, null ids
    last, equal ids by their components; fewer rows give fewer entries, repeated rows
    give equal entries. Entries without parts stay as they were. Without a kept row the
    result is empty. Components too large for exact 64-bit distances raise
    ArithmeticError. Columns named like a result are replaced.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte a part")
    spark = df.sparkSession
    rows, dim = vectors_of(df, vector, parts)
    columns = [c for c in df.columns if c.lower() not in ("code", "error")]
    names = [F.col("r").getField(c).alias(c) for c in columns]
    if not dim:
        empty = rows.select(*names, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, Codebooks(np.zeros((parts, 0, 0), np.int64))
    state, path = materialize_at(rows.withColumn("code", F.lit(bytes(parts))).withColumn("error", F.lit(0).cast("long")), "vector-codes")
    first = state.orderBy(F.col("r").getField(vec_id).asc_nulls_last(), "c").limit(entries).select("c").collect()
    books = np.array([r.c for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        following, new_path = materialize_at(state.mapInArrow(lean(_assign(books)), state.schema), "vector-codes")
        discard(spark, path)
        state, path = following, new_path
        if turn < rounds:
            schema = "part long, entry long, place long, total long, n long"
            sums = state.select("c", "code").mapInArrow(lean(_sums(*books.shape)), schema)
            for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
                books[r.part, r.entry, r.place] = r.total // r.n
    return state.select(*names, "code", "error"), Codebooks(books)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the error summed over rows of equal labels, nulls together.

    The sums are a stored table, so Spark joins them by broadcast if they are small and
    else splits hot labels.
    """
    a, e = fresh(coded, "_label"), "label_error"
    sums = materialize(coded.groupBy(F.col(f"`{label}`").alias(a)).agg(F.sum("error").alias(f"{a}_sum")), "label-errors")
    joined = coded.join(sums, F.col(f"`{label}`").eqNullSafe(F.col(a)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in coded.columns if c.lower() != e], F.col(f"{a}_sum").alias(e))
