"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of input after which a worker returns freed memory.
STEP = 32 << 20
#: ASCII white space that separates words: space, tab, LF, VT, FF, CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALNUM = bytes(
    c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space as UTF-8, A-Z in lower case."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII bytes, A-Z in lower case."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def word_count(text: str | Column) -> Column:
    """Words between ASCII white space; null counts as none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(df: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """All columns of ``df`` but those in ``leave`` as one struct, so that none can clash with a column made here."""
    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() not in leave]
    return F.struct(*(columns or [F.lit(0).alias("_none")]))


def crc32_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the decimal id, modulo n: the fold rule of held-out rows."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % n


def give_back() -> None:
    """Return freed memory to the system; Python workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What a worker keeps from one task to the next, by owner.
_kept: dict[str, object] = {}


def kept(owner: str, make: Callable):
    """What this worker keeps for ``owner``, made at first use; a ``lean`` function of no or another owner drops it."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


def drop_kept(owner: str | None = None) -> None:
    """Drop what this worker keeps for others than ``owner``."""
    for other in _kept.keys() - {owner}:
        del _kept[other]


def lean(run: Callable, owner: str | None = None) -> Callable:
    """A mapInArrow function that returns freed memory after every ``STEP`` bytes of input and at its end.

    Workers serve one operator after another, so what they keep for others than ``owner`` is dropped first.
    """

    def watched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch
            seen += batch.nbytes
            del batch
            if seen > STEP:
                give_back()
                seen = 0

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(owner)
        try:
            yield from run(watched(batches))
        finally:
            give_back()

    return wrapped
