"""Jaccard join of documents on word shingles, exact for a threshold.

A document's set holds 64-bit hashes of its distinct ``width``-word shingles.
Copies share a set digest and act as one node from the start.

*Candidates.* Sets are ordered by hash. Two sets with similarity ``t`` or more
overlap in at least ``ceil(t * size)`` elements of either, so their prefixes of
``size - ceil(t * size) + l`` share at least the smaller of their two ``l``, with
``l = 1 + floor(extra * size)``. Prefix elements that several nodes hold are
*live*; a node stays only while it has ``1 + floor(extra * ceil(t * size))`` live
elements, which drops documents that merely share a passage. Each element then
ties its holders to the smallest of them - never to each other - and the
components of these ties contain all components of true links.

*Likely groups.* Each set has a hashed bitmap of two to four bits an element.
Candidate components are cut in size bands of ratio ``1 / t`` and, within a band,
in blocks by hash; tiles are pairs of blocks of the same or neighbouring bands,
since sets further apart in size cannot link. In a tile, bits that only one side
has bound the overlap from above; the components of the pairs that pass are the
likely groups. Only bitmaps travel here, a small part of the sets.

*Exact links.* A likely group is dealt in chunks by hash, each with a few anchors
of its group, and pairs of a chunk that pass the bitmap bound are intersected
exactly as sorted arrays. ``spanning`` links skip pairs already connected, so a
group of near-copies costs one intersection a member. A group of several chunks
that this leaves in pieces is then compared as a whole, in tiles as above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_forest
from ..storage import discard, materialize, materialize_at
from .common import fresh, lean
from .decontaminate import parts_by_bytes, rolling
from .secret_scan import segment_of

_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes for Arrow columns of texts, without a loop over words."""

    def __init__(self, width: int):
        self.width = width
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.lower = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 1 << 16)
            unit = np.full(size, _BASE, np.uint64)
            unit[0] = 1
            self.powers = np.cumprod(unit, dtype=np.uint64)
            unit[1:] = pow(_BASE, -1, 1 << 64)
            self.inverse = np.cumprod(unit, dtype=np.uint64)

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts and the number of words of each."""
        data, bounds = segment_of(column)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
        self._grow(n)
        inside = ~self.space[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds[:-1]] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.lower[data] + np.uint64(1)) * self.powers[:n], dtype=np.uint64)])
        hashes = mixed((total[ends] - total[starts]) * self.inverse[starts])
        counts = np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])
        return hashes, counts

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        words, counts = self.words(column)
        k, out, at = self.width, [], 0
        runs = mixed(rolling(words, k)) if len(words) >= k else words[:0]
        for n in counts.tolist():
            if n >= k:
                out.append(np.unique(runs[at : at + n - k + 1]))
            elif n:
                out.append(mixed(rolling(words[at : at + n], n)[:1] + np.uint64(n)))
            else:
                out.append(words[:0])
            at += n
        return out


def digest(items: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(items.tobytes(), 77)).view(np.int64))


def least_overlap(n, percent: int):
    """ceil(percent / 100 * n) in integers."""
    return -(-n * percent // 100)


def _map_sets(rows: DataFrame, width: int, schema: str, each) -> DataFrame:
    """mapInArrow over ``id, body``; ``each(ids, sets, state)`` gives columns."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, state = Shingler(width), {}
        for whole in batches:
            for start, n in parts_by_bytes(whole.column("body"), _PIECE):
                part = whole.slice(start, n)
                columns = each(part.column("id"), shingler.sets(part.column("body")), state)
                yield pa.RecordBatch.from_pydict(dict(zip(names, columns)))

    return rows.mapInArrow(lean(run), schema)


def bitmap(items: np.ndarray) -> np.ndarray:
    """Bitmap of the smallest power of two of bits that gives two or more an element, 64 at least."""
    bits = max(64, 1 << (2 * len(items) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(items & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _nodes(ids, sets, state):
    return (
        ids,
        pa.array([len(s) for s in sets], pa.int64()),
        pa.array([digest(s) if len(s) else None for s in sets], pa.int64()),
        pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()),
    )


def _prefixes(percent: int, extra: float):
    def each(ids, sets, state):
        seen = state.setdefault("seen", set())
        hashes, nodes = [], []
        for s in sets:
            n = len(s)
            if not n or (d := digest(s)) in seen:
                continue
            seen.add(d)
            p = min(n, n - least_overlap(n, percent) + 1 + math.floor(extra * n))
            hashes.append(s[:p])
            nodes.append(np.full(p, d, np.int64))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        d = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        return pa.array(h.view(np.int64), pa.int64()), pa.array(d, pa.int64())

    return each


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose element several nodes hold, with the smallest of them as ``m``."""
    per = rows.repartition("h").sortWithinPartitions("h", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h0 = m0 = last_d = None  # the element, its smallest node and the last one given
        waiting = False  # whether (h0, m0) was not yet given
        for batch in batches:
            h, d = (batch.column(c).to_numpy() for c in ("h", "d"))
            if not len(h):
                continue
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            if h0 is not None:
                fresh[0] = h[0] != h0 or d[0] != last_d
            h, d = h[fresh], d[fresh]
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            new[0] = h0 is None or h[0] != h0
            at = np.flatnonzero(new)
            head = np.where(np.cumsum(new) > 0, np.concatenate([at, [0]])[np.maximum(np.cumsum(new) - 1, 0)], 0)
            least = np.where(np.cumsum(new) > 0, d[head], m0 if m0 is not None else 0)
            follow = np.zeros(len(h), bool)
            follow[:-1] = ~new[1:]
            give = ~new | follow
            out_h, out_d, out_m = h[give], d[give], least[give]
            if waiting and not new[0]:
                out_h, out_d, out_m = np.append(out_h, h0), np.append(out_d, m0), np.append(out_m, m0)
            yield pa.RecordBatch.from_pydict({"h": pa.array(out_h), "d": pa.array(out_d), "m": pa.array(out_m)})
            waiting = bool(new[-1])
            h0, m0, last_d = int(h[-1]), int(least[-1]), int(d[-1])

    return per.mapInArrow(lean(run), "h long, d long, m long")


def tile_rows(members: DataFrame, percent: int, tile: int, weight: int) -> DataFrame:
    """``tile, side, d`` from ``d, n, root``: which nodes meet in which tile (side 2: all with all)."""
    ratio = F.log(F.lit(100.0 / percent))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_w"))
    sizes = sizes.withColumn("_big", (F.col("_c") > tile) | (F.col("_w") > weight))
    members = members.join(sizes.select("root", "_big"), "root")
    small = members.filter(~F.col("_big")).select(F.xxhash64("root", F.lit("c")).alias("tile"), F.lit(2).alias("side"), "d")
    big = members.filter("_big").withColumn("b", F.floor(F.log(F.col("n").cast("double")) / ratio + F.lit(1e-9)))
    bands = big.groupBy("root", "b").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) * 2 / F.lit(tile)), F.ceil(F.sum("n") * 2 / F.lit(weight))).cast("long").alias("blocks")
    )
    above = bands.select("root", (F.col("b") - 1).alias("b"), F.col("blocks").alias("above"))
    below = bands.select("root", (F.col("b") + 1).alias("b"), F.col("blocks").alias("below"))
    big = big.join(bands.join(above, ["root", "b"], "left").join(below, ["root", "b"], "left"), ["root", "b"])
    big = big.withColumn("s", F.pmod(F.xxhash64("d", F.lit(3)), F.col("blocks")))

    def to(b1, s1, b2, s2):
        return F.xxhash64("root", b1, s1, b2, s2).alias("tile")

    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("o")
    same = big.select("root", "b", "s", "d", other(F.col("blocks")))
    up = big.filter("above is not null").select("root", "b", "s", "d", other(F.col("above")))
    down = big.filter("below is not null").select("root", "b", "s", "d", other(F.col("below")))
    b, s, o = F.col("b"), F.col("s"), F.col("o")
    return (
        small.unionByName(
            same.select(
                to(b, F.least(s, o), b, F.greatest(s, o)),
                F.when(s == o, 2).when(s < o, 0).otherwise(1).alias("side"),
                "d",
            )
        )
        .unionByName(up.select(to(b, s, b + 1, o), F.lit(0).alias("side"), "d"))
        .unionByName(down.select(to(b - 1, o, b, s), F.lit(1).alias("side"), "d"))
    )


def tile_links(
    nodes: np.ndarray,
    sides: np.ndarray,
    sizes: np.ndarray,
    maps: list[np.ndarray],
    percent: int,
    spanning: bool,
    sets: list[np.ndarray] | None = None,
    groups: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Links between the sets of a tile (between its sides, or all if side is 2).

    Without ``sets``, the pairs that the bitmaps let pass. ``groups``: what is
    connected already.
    """
    order = np.argsort(sizes, kind="stable")
    nodes, sides, sizes = nodes[order], sides[order], sizes[order]
    maps = [maps[i] for i in order]
    words = np.array([len(x) for x in maps])
    # bitmaps of one length side by side; partners have the same length or half of it
    layers, starts = {}, {}
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        layers[int(w)], starts[int(w)] = np.stack([maps[i] for i in at]), int(at[0])
    group = np.arange(len(nodes)) if groups is None else np.unique(groups[order], return_inverse=True)[1]
    links = []
    low = np.searchsorted(sizes, least_overlap(sizes, percent))
    for i in range(1, len(nodes)):
        near = (nodes[low[i] : i] != nodes[i]) & ((sides[i] == 2) | (sides[low[i] : i] != sides[i]))
        if spanning:
            near &= group[low[i] : i] != group[i]
        at = low[i] + np.flatnonzero(near)
        if not len(at):
            continue
        bound = np.zeros(len(at), np.int64)
        w = int(words[i])
        for length in (w // 2, w):
            own = words[at] == length
            if not own.any():
                continue
            mine = maps[i] if length == w else maps[i][:length] | maps[i][length:]
            others = layers[length][at[own] - starts[length]]
            only_i = np.bitwise_count(mine & ~others).sum(1, dtype=np.int64)
            only_j = np.bitwise_count(others & ~mine).sum(1, dtype=np.int64)
            bound[own] = np.minimum(sizes[i] - only_i, sizes[at[own]] - only_j)
        may = 100 * bound >= percent * (sizes[i] + sizes[at] - bound)
        at = at[may][np.argsort(-bound[may], kind="stable")]
        while len(at):
            j = int(at[0])
            at = at[1:]
            if sets is not None:
                a, b = sets[order[i]], sets[order[j]]
                place = np.searchsorted(a, b)
                place[place == len(a)] = 0
                both = int((a[place] == b).sum())
                if 100 * both < percent * (sizes[i] + sizes[j] - both):
                    continue
            links.append((int(nodes[i]), int(nodes[j])))
            if spanning:
                group[group == group[j]] = group[i]
                at = at[group[at] != group[i]]
    return links


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each linked node with the smallest node that its links reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _solve(percent: int, spanning: bool, exact: bool):
    """Links of tiles from rows ``tile, side, d, n, g, body`` sorted by tile; body: the set if exact, else its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def solve():
            if len(rows) < 2:
                return []
            nodes, sides, sizes, groups = (np.array([r[k] for r in rows], np.int64) for k in range(4))
            bodies = [np.frombuffer(r[4], np.uint64) for r in rows]
            if exact:
                links = tile_links(nodes, sides, sizes, [bitmap(x) for x in bodies], percent, spanning, bodies, groups)
            else:
                links = tile_links(nodes, sides, sizes, bodies, percent, True)
            return stars(links) if spanning or not exact else links

        for batch in batches:
            links = []
            for tile, *row in zip(*(batch.column(c).to_pylist() for c in ("tile", "d", "side", "n", "g", "body"))):
                if tile != now:
                    links += solve()
                    now, rows = tile, []
                rows.append(row)
            yield pack(links)
        yield pack(solve())

    def pack(links):
        return pa.RecordBatch.from_pydict(
            {"src": pa.array([a for a, _ in links], pa.int64()), "dst": pa.array([b for _, b in links], pa.int64())}
        )

    return run


def chunk_rows(members: DataFrame, tile: int, weight: int, anchors: int) -> DataFrame:
    """``tile, side, d`` from ``d, n, root``: each node in one chunk of its group, with the anchors of the group."""
    sizes = members.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(tile)), F.ceil(F.sum("n") / F.lit(weight))).cast("long").alias("chunks")
    )
    some = members.groupBy("root", F.pmod(F.xxhash64("d", F.lit(5)), F.lit(anchors)).alias("_k")).agg(F.min("d").alias("d"))
    some = some.join(sizes.filter("chunks > 1"), "root").select(
        "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("s"), "d"
    )
    each = members.join(sizes, "root").select("root", F.pmod(F.xxhash64("d", F.lit(3)), F.col("chunks")).alias("s"), "d")
    both = each.unionByName(some).select(F.xxhash64("root", "s", F.lit("k")).alias("tile"), F.lit(2).alias("side"), "d")
    return both.distinct()


def rooted(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``d, n, id, root`` of the nodes (``d, n, id``) that have links."""
    forest = star_forest(links)
    roots = forest.select("root").distinct().select(F.col("root").alias("d"), F.col("root"))
    return forest.select(F.col("v").alias("d"), "root").unionByName(roots).join(nodes, "d").select("d", "n", "id", "root")


def _exact_links(rows: DataFrame, nodes: DataFrame, placed: DataFrame, width: int, percent: int, spanning: bool, few: int) -> DataFrame:
    """Links of tiles ``tile, side, d``; nodes: ``d, id, n, g``. Sets are made once a node and sent to its tiles."""
    wanted = nodes.select("id").distinct()
    wanted = F.broadcast(wanted) if nodes.count() <= few else wanted
    texts = rows.join(wanted, "id", "left_semi")
    dealt = placed.groupBy("d").agg(F.collect_list(F.struct("tile", "side")).alias("to")).join(nodes.select("d", "id", "g"), "d")
    named = texts.join(dealt.select("id", "d", "g", "to"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for whole in batches:
            for start, n in parts_by_bytes(whole.column("body"), _PIECE):
                part = whole.slice(start, n)
                given = zip(part.column("d").to_pylist(), part.column("g").to_pylist(), part.column("to").to_pylist())
                for (d, g, to), s in zip(given, shingler.sets(part.column("body"))):
                    if not len(s) or digest(s) != d:
                        continue  # another row with the id of the node's document
                    k = len(to)
                    for at in range(0, k, 64):
                        some = to[at : at + 64]
                        columns = {
                            "tile": pa.array([t["tile"] for t in some], pa.int64()),
                            "side": pa.array([t["side"] for t in some], pa.int32()),
                            "d": pa.array([d] * len(some), pa.int64()),
                            "n": pa.array([len(s)] * len(some), pa.int64()),
                            "g": pa.array([g] * len(some), pa.int64()),
                            "body": pa.array([s.tobytes()] * len(some), pa.binary()),
                        }
                        yield pa.RecordBatch.from_pydict(columns)

    sets = named.mapInArrow(lean(run), "tile long, side int, d long, n long, g long, body binary")
    solved = sets.repartition("tile").sortWithinPartitions("tile", "d")
    return materialize(solved.mapInArrow(lean(_solve(percent, spanning, True)), "src long, dst long"), "ngram-links")


class Similar:
    """The result of a join.

    ``documents``: id, n (set size), d (node; null without words);
    ``links``: src, dst between nodes: all, or if spanning, ties of nodes to the
    smallest node that their links reach within a tile.
    """

    def __init__(self, documents: DataFrame, links: DataFrame, forest: DataFrame | None = None):
        self.documents, self.links, self.forest = documents, links, forest

    def components(self) -> DataFrame:
        """``id, n, component`` (smallest id reachable) of every document."""
        forest = self.forest if self.forest is not None else star_forest(self.links)
        joined = self.documents.join(forest.withColumnRenamed("v", "d"), "d", "left")
        rooted = joined.select("id", "n", F.coalesce("root", "d").alias("root"))
        named = rooted.filter("root is not null")
        least = named.groupBy("root").agg(F.min("id").alias("component"))
        alone = rooted.filter("root is null").select("id", "n", F.col("id").alias("component"))
        return named.join(least, "root").select("id", "n", "component").unionByName(alone)


def similarity_join(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    width: int = 5,
    percent: int = 75,
    extra: float = 0.125,
    rounds: int = 1,
    tile: int = 1024,
    weight: int = 1 << 21,
    map_tile: int = 2048,
    map_weight: int = 1 << 24,
    anchors: int = 8,
    broadcast_rows: int = 1_000_000,
    spanning: bool = True,
) -> Similar:
    """Link documents whose shingle sets have a Jaccard similarity of ``percent``/100 or more.

    A text of fewer than ``width`` words is one shingle; null, empty and blank
    texts have an empty set and link with nothing, not even each other. Rows
    that repeat an id are rows of their own. An empty table gives empty results.
    Only the id and text columns are read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    documents = materialize(_map_sets(rows, width, "id long, n long, d long, bits binary", _nodes), "ngram-nodes")
    sized = documents.filter("d is not null").groupBy("d").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    least = F.ceil(F.col("n") * percent / 100)
    need = F.floor(F.lit(extra) * least) + 1
    live, path = materialize_at(_shared(_map_sets(rows, width, "h long, d long", _prefixes(percent, extra))), "ngram-live")
    for k in range(rounds):
        enough = live.groupBy("d").count().join(sized, "d").filter(F.col("count") >= need).select("d")
        kept = live.select("h", "d").join(enough, "d")
        following, new_path = materialize_at(_shared(kept.select("h", "d")), "ngram-live")
        discard(spark, path)
        live, path = following, new_path
    enough = live.groupBy("d").count().join(sized, "d").filter(F.col("count") >= need).select("d")
    ties = live.join(enough, "d").filter("d <> m").select("d", "m").distinct()
    nodes = sized.select("d", "n", "id")
    members = materialize(rooted(ties.select(F.col("d").alias("src"), F.col("m").alias("dst")), nodes), "ngram-members")
    discard(spark, path)
    named = F.broadcast(members.select("id", "d")) if members.count() <= broadcast_rows else members.select("id", "d")
    maps = documents.select("id", "d", "n", "bits").join(named, ["id", "d"], "left_semi").dropDuplicates(["d"]).drop("id")
    placed = tile_rows(members.select("d", "n", "root"), percent, map_tile, map_weight)
    dealt = placed.join(maps, "d").select("tile", "side", "d", "n", F.col("d").alias("g"), F.col("bits").alias("body"))
    passed = dealt.repartition("tile").sortWithinPartitions("tile", "d").mapInArrow(lean(_solve(percent, True, False)), "src long, dst long")
    likely = materialize(rooted(passed, nodes), "ngram-likely")

    def exact(some: DataFrame, placed: DataFrame) -> DataFrame:
        return _exact_links(rows, some, placed, width, percent, spanning, broadcast_rows)

    plain = likely.select("d", "n", "root")
    start = likely.select("d", "n", "id", "root", F.col("d").alias("g"))
    if not spanning:
        return Similar(documents, exact(start, tile_rows(plain, percent, tile, weight)))
    links = exact(start, chunk_rows(plain, tile, weight, anchors))
    large = likely.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    large = materialize(large.filter((F.col("c") > tile) | (F.col("w") > weight)).select("root"), "ngram-large")
    if large.isEmpty():
        return Similar(documents, links)
    forest = star_forest(links)
    found = forest.select(F.col("v").alias("d"), F.col("root").alias("g"))
    grouped = likely.join(large, "root", "left_semi").join(found, "d", "left").withColumn("g", F.coalesce("g", "d"))
    grouped = materialize(grouped.select("d", "n", "id", "root", "g"), "ngram-grouped")
    pieces = grouped.groupBy("root").agg(F.min("g").alias("a"), F.max("g").alias("b")).filter("a <> b").select("root")
    broken = materialize(grouped.join(pieces, "root", "left_semi"), "ngram-broken")
    if broken.isEmpty():
        return Similar(documents, links, forest)
    more = exact(broken, tile_rows(broken.select("d", "n", "root"), percent, tile, weight))
    return Similar(documents, links.unionByName(more))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``df`` with one document of each component: the one with the smallest id.

    Documents without words and rows without id stay. Rows that repeat an id
    stay or go together. Columns may have any name; an empty table stays empty.
    """
    parts = similarity_join(df, text, doc_id, **options).components()
    name = fresh(df, "_gone")
    gone = parts.filter("id <> component").select(F.col("id").alias(name)).distinct()
    return df.join(gone, F.col(doc_id) == F.col(name), "left_anti")
