"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Every benchmark item gives windows of ``width`` consecutive words (an item of
fewer words is one window). Documents are scanned in Arrow batches: word hashes
are combined into rolling window hashes for the whole batch at once, a bit table
and a sorted hash list leave the few candidate positions, and each is verified
against the words themselves. No shuffle is needed.

The set is broadcast only in chunks of about ``chunk_words`` words of the
benchmark, which bounds the windows and so the memory of a worker (some 100
bytes a word); they are counted before anything is collected. A larger benchmark is
scanned chunk after chunk, each pass carrying the hits of the earlier ones
through a table in the shared folder, so the result is the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from .common import _ALNUM, alnum_words, fresh, lean, packed

#: Bytes of text scanned at a time.
PIECE = 4 << 20
#: Words of items, in Java's syntax.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes that hold within one process."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, by doubling."""
    total, at, power, block = None, 0, _STEP, hashes
    size = 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if total is None:
                    total, at = block, size
                else:
                    n = len(hashes) - at - size + 1
                    scale = np.uint64(pow(int(_STEP), at, 1 << 64))
                    total = total[:n] + scale * block[at : at + n]
                    at += size
            if size * 2 > width:
                return total
            block = block[:-size] + power * block[size:]
            power = power * power
            size *= 2


class WindowSet:
    """The windows of some items, for lookups in batches of documents.

    Held as arrays: the hash of each distinct window, one place where it occurs
    in the items' words, and the items that have it.
    """

    def __init__(self, items: Iterable[tuple[str, str | None]], width: int):
        self.names: list[str] = []
        self.words: list[bytes] = []
        shared: dict[bytes, bytes] = {}
        starts: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            words = alnum_words(text)
            n = min(width, len(words))
            if n:
                starts.setdefault(n, []).append((len(self.names), len(self.words), len(words) - n + 1))
                self.words.extend(shared.setdefault(w, w) for w in words)
            self.names.append(item_id)
        hashes = word_hashes(self.words)
        self.tables = []
        for n, spans in starts.items():
            count = np.array([c for _, _, c in spans])
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat([s for _, s, _ in spans], count) + inside
            item = np.repeat([i for i, _, _ in spans], count).astype(np.int32)
            sums = rolling(hashes, n)[at]
            order = np.argsort(sums, kind="stable")
            self.tables.append(self._table(n, sums[order], at[order], item[order]))

    def _table(self, n: int, sums: np.ndarray, at: np.ndarray, item: np.ndarray) -> tuple:
        """Equal windows become one; those that only share a hash stay apart, side by side."""
        new = np.append(True, sums[1:] != sums[:-1])
        group = np.cumsum(new) - 1
        kept = at[new]
        for i in np.flatnonzero(~new).tolist():
            a, b = int(kept[group[i]]), int(at[i])
            if self.words[a : a + n] != self.words[b : b + n]:  # another window with this hash: sort by content
                rank = np.array([self.words[x : x + n] for x in at.tolist()] + [None], object)[:-1]
                order = np.array(sorted(range(len(at)), key=lambda j: (int(sums[j]), rank[j])))
                sums, at, item, rank = sums[order], at[order], item[order], rank[order]
                new = np.array([True] + [sums[j] != sums[j - 1] or rank[j] != rank[j - 1] for j in range(1, len(at))])
                break
        ends = np.append(np.flatnonzero(new)[1:], len(at))
        sums, at = sums[new], at[new]
        bits = max(16, min(24, int(len(sums) * 8).bit_length()))
        seen = np.zeros(1 << bits, bool)
        seen[sums >> np.uint64(64 - bits)] = True
        return n, sums, at, item, ends, seen, np.uint64(64 - bits)

    def scan(self, docs: list[list[bytes]]):
        """Cover flags of all words, document bounds, and the items of each document."""
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        ends = np.cumsum(counts)
        words = [w for d in docs for w in d]
        cover = np.zeros(len(words) + 1, np.int32)
        items: dict[int, set[str]] = {}
        hashes = word_hashes(words)
        for n, sums, starts, item, item_ends, seen, shift in self.tables:
            if len(words) < n:
                continue
            run = rolling(hashes, n)
            at = np.flatnonzero(seen[run >> shift])
            place = np.minimum(np.searchsorted(sums, run[at]), len(sums) - 1)
            hit = sums[place] == run[at]
            at, place = at[hit], place[hit]
            doc = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[doc] if len(at) else np.zeros(0, bool)
            for i, d, k in zip(at[inside].tolist(), doc[inside].tolist(), place[inside].tolist()):
                here = words[i : i + n]
                while k < len(sums) and sums[k] == run[i]:
                    if self.words[starts[k] : starts[k] + n] == here:
                        cover[i] += 1
                        cover[i + n] -= 1
                        found = item[item_ends[k - 1] if k else 0 : item_ends[k]]
                        items.setdefault(d, set()).update(self.names[x] for x in found.tolist())
                        break
                    k += 1
        return np.cumsum(cover[:-1]) > 0, ends, counts, items


def cut_words(text: str, flags: np.ndarray) -> str:
    """The text without its flagged words, nor what stands between two of them."""
    data = text.encode("utf-8", "surrogatepass")
    kept, last, open_at = [], 0, None
    spans = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_ALNUM))]
    for (start, end), flag in zip(spans, flags):
        if flag and open_at is None:
            open_at = start
        if flag:
            stop = end
        elif open_at is not None:
            kept.append(data[last:open_at])
            last, open_at = stop, None
    if open_at is not None:
        kept.append(data[last:open_at])
        last = stop
    kept.append(data[last:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def scan_batches(shared, width: int, text: str, out: list[str], cut: bool):
    """The mapInArrow function of one pass over ``out`` + hit columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(shared.value, width)
        for whole in batches:
            for start, n in parts_by_bytes(whole.column(text), PIECE):
                part = whole.slice(start, n)
                texts = part.column(text).to_pylist()
                flags, ends, counts, items = windows.scan([alnum_words(t) for t in texts])
                masks = [flags[e - c : e] for e, c in zip(ends, counts)]
                earlier = part.column("_items").to_pylist()
                if "_mask" in part.schema.names:
                    old = part.column("_mask").to_pylist()
                    masks = [
                        m | np.unpackbits(np.frombuffer(o, np.uint8), count=len(m)).astype(bool) if o else m
                        for m, o in zip(masks, old)
                    ]
                found = [sorted({*(earlier[i] or ()), *items.get(i, ())}) for i in range(n)]
                columns = {c: part.column(c) for c in out}
                if cut:
                    columns[text] = pa.array(
                        [cut_words(t, m) if t and m.any() else t for t, m in zip(texts, masks)], pa.string()
                    )
                columns |= {
                    "_n_words": pa.array(counts, pa.int64()),
                    "_n_hit": pa.array([int(m.sum()) for m in masks], pa.int64()),
                    "_items": pa.array(found, pa.list_(pa.string())),
                    "_mask": pa.array([np.packbits(m).tobytes() if m.any() else None for m in masks], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def parts_by_bytes(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Slices of a string column of about ``most`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i - start
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes) - start


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    chunk_words: int = 1 << 20,
    carry: list[str] | None = None,
    cut: bool = False,
) -> DataFrame:
    """The rows of ``docs`` with ``n_words, n_hit, items, contaminated``.

    A word is hit if it lies in an occurrence of a window. ``items`` holds the
    ids (as strings) of the items with occurring windows. Null and empty texts
    have no words and no hits; an empty benchmark hits nothing; an empty table
    gives no rows; equal rows give equal results; items without an id count
    under ``null``. Columns of ``docs`` named like a result are replaced.
    ``carry`` names the columns to return (default: all); with ``cut`` the
    returned text lacks the hit passages.
    """
    results = ("n_words", "n_hit", "items", "contaminated")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in results]
    inner = [f"c{i}" for i in range(len(carry))]
    body = fresh(docs, "_body")
    rows = docs.select(
        *[F.col(f"`{c}`").alias(a) for c, a in zip(carry, inner)],
        F.col(text).alias(body),
        F.lit(None).cast("array<string>").alias("_items"),
    )
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("body")
    )
    size = items.agg(F.sum(F.regexp_count("body", F.lit(WORDS)) + 1)).first()[0] or 0
    chunks = max(1, -(-size // chunk_words))
    extra = "_n_words long, _n_hit long, _items array<string>, _mask binary"
    sc = docs.sparkSession.sparkContext
    for k in range(chunks):
        part = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(chunks)) == k) if chunks > 1 else items
        shared = sc.broadcast([(r.item, r.body) for r in part.collect()])
        last = k == chunks - 1
        out = inner if last else [*inner, body]
        fields = T.StructType([rows.schema[c] for c in out] + list(T._parse_datatype_string(extra).fields))
        position = carry.index(text) if text in carry else None
        step = scan_batches(shared, width, body, out, False)
        if cut and last and position is not None:
            step = scan_and_cut(shared, width, body, out, inner[position])
        rows = rows.select(*[c for c in rows.columns if c not in ("_n_words", "_n_hit")]).mapInArrow(lean(step), fields)
        if not last:
            rows = materialize(rows, "decontaminate")
    return rows.select(
        *[F.col(a).alias(c) for c, a in zip(carry, inner)],
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.col("_items").alias("items"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


def scan_and_cut(shared, width: int, body: str, out: list[str], target: str):
    """Like ``scan_batches``; the column ``target`` gets the text without hits."""
    inner = scan_batches(shared, width, body, [*out, body], True)

    def run(batches):
        for batch in inner(batches):
            columns = {c: batch.column(body if c == target else c) for c in batch.schema.names if c != body}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **options
) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit passages.

    Rows without text or words stay. Columns may have any name; repeated rows
    share their fate; an empty table stays empty.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    rows = docs.select(packed(docs).alias("_row"), F.col(text).alias("_text"))
    found = find_contamination(rows, benchmark, text="_text", cut=remove == "spans", **options)
    if remove == "documents":
        return found.filter(~F.col("contaminated")).select("_row.*")
    return found.select(*[F.col("_text" if c == text else f"_row.`{c}`").alias(c) for c in docs.columns])
