"""Repair of conversation structure by cheapest edits.

A repaired conversation has the role initials ``(s?(ua)+)?``. Kept rows cost nothing
(5 if truncated), a changed role 1 more, a deletion 2, an inserted empty turn 5;
blank and repeated rows must go. Of the cheapest edits the least string of their
initials (D, I, K, R) counts.

The edits of a conversation are a path in the lattice of (row, state of the grammar),
whose nodes are made only when reached: Dijkstra's search with the key
(cost, edits so far) ends at the first accepting end node that it pops. Costs are
not negative and the key grows along every edge, so that node is the answer.

Rows are put in order by range, so a conversation of any size is spread over tasks,
and cut into pieces of ``PIECE`` rows at most. A conversation in one piece is searched
at once. Of others each piece is searched from every state; insertions belong
before a row, so of two different edit strings of a piece neither begins the other,
and costs and ranks of the pieces' strings decide for the whole. Linking the pieces
streams a few numbers a piece forward, and back to choose the states between them.
Repeated rows are found by one aggregate, not by memory of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import lean

PIECE = 256
#: States of the grammar: nothing yet, and after a turn of the system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Marks of a row are an initial (s, u, a, other) and four times a fault (none, to delete, truncated).
INITIALS = "sua"
DELETE, TRUNCATED = 1, 2
#: What ends a conversation in each state, and costs 5 a letter.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
SPACES = r"\x20\x09-\x0D"
#: The legal pairs of neighbours' initials.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def answer(state: int) -> int:
    """The state after a turn that is free to be user or assistant."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: int) -> int | None:
    """The state after a kept turn, None if the grammar has no place for it."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def cheapest(marks: bytes, entry: int, whole: bool) -> dict[int, tuple[int, str]]:
    """Cost and edits by end state. whole: rows may follow no more, so only the best accepted end is sought."""
    n, found, settled = len(marks), {}, set()
    heap = [(0, "", 0, entry)]
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n:
            if whole and state in (START, ASSISTANT):
                return {state: (cost, audit)}
            if not whole:
                found[state] = cost, audit
                continue
        else:
            fault, initial = divmod(marks[i], 4)
            heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if fault != DELETE:
                more = 5 if fault == TRUNCATED else 0
                after = kept(state, initial)
                if after is not None:
                    heappush(heap, (cost + more, audit + "K", i + 1, after))
                heappush(heap, (cost + more + 1, audit + "R", i + 1, answer(state)))
        heappush(heap, (cost + 5, audit + "I", i, answer(state)))
    return found


#: Pieces repeat, since there are few kinds of rows.
_cheapest = lru_cache(20_000)(cheapest)


def table_of(marks: bytes) -> tuple[list[int], list[int]]:
    """By entry and end state the cost (-1: none) and the rank of the edits among those of the same entry."""
    costs, ranks = [-1] * 16, [0] * 16
    for entry in range(4):
        ends = _cheapest(marks, entry, False)
        for rank, (_, end) in enumerate(sorted((audit, end) for end, (_, audit) in ends.items())):
            costs[4 * entry + end], ranks[4 * entry + end] = ends[end][0], rank
    return costs, ranks


def row_edits(marks: bytes, audit: str, entry: int) -> list[list[str]]:
    """For each row the initials inserted before it, what becomes of it (K, D or its new initial), and those after it."""
    out, before, state = [], "", entry
    for letter in audit:
        if letter == "I":
            state = answer(state)
            before += INITIALS[state - 1]
            continue
        mark = marks[len(out)]
        if letter == "R":
            state = answer(state)
        elif letter == "K":
            state = kept(state, mark % 4)
        out.append([before, INITIALS[state - 1] if letter == "R" else letter, ""])
        before = ""
    out[-1][2] = before
    return out


def illegal_pairs(marks: bytes) -> int:
    return sum((a % 4, b % 4) not in LEGAL for a, b in zip(marks, marks[1:]))


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of rows in order: ``conv, at, ids, marks``."""
    kind, now, pieces = None, None, []

    def pack():
        columns = {"conv": pa.array([p[0] for p in pieces], kind), "at": pa.array([p[1] for p in pieces], pa.int64())}
        columns |= {"ids": pa.array([p[2] for p in pieces], pa.list_(pa.int64())), "marks": pa.array([bytes(p[3]) for p in pieces], pa.binary())}
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, pos, id_, mark in zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "id", "mark"))):
            if now is None or conv != now[0] or len(now[3]) == most:
                now = (conv, pos, [], bytearray())
                pieces.append(now)
            now[2].append(id_)
            now[3].append(mark)
        if len(pieces) > 1:
            last = pieces.pop()
            yield pack()
            pieces = [last]
    if pieces:
        yield pack()


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column("marks").to_pylist()
        found = [table_of(m) for m in marks]
        columns = {"conv": batch.column("conv"), "at": batch.column("at"), "costs": pa.array([c for c, _ in found], pa.list_(pa.int64()))}
        columns |= {"ranks": pa.array([r for _, r in found], pa.list_(pa.int32()))}
        columns |= {"first": pa.array([m[0] % 4 for m in marks], pa.int32()), "last": pa.array([m[-1] % 4 for m in marks], pa.int32())}
        yield pa.RecordBatch.from_pydict(columns)


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)})


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece in order the entry from which each end is best, whether the pair across its start is illegal,
    and at a conversation's last piece the end state."""
    now, held, paths, last, schema = None, None, {}, None, None
    for batch in batches:
        out = []
        schema = pa.schema(
            [batch.schema.field("conv"), ("at", pa.int64()), ("entries", pa.list_(pa.int32())), ("illegal", pa.int64()), ("final", pa.int32())]
        )
        for conv, at, costs, ranks, first, end in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "costs", "ranks", "first", "last"))):
            if held is None or conv != now:
                if held is not None:
                    out.append((*held, _best_end(paths)))
                now, paths, last = conv, {START: (0, 0)}, None
            else:
                out.append((*held, -1))
            best: dict[int, tuple] = {}
            for entry, (cost, order) in paths.items():
                for f in range(4):
                    if costs[4 * entry + f] >= 0:
                        offer = (cost + costs[4 * entry + f], order, ranks[4 * entry + f], entry)
                        best[f] = min(best.get(f, offer), offer)
            strings = sorted((order, rank, f) for f, (_, order, rank, _) in best.items())
            paths = {f: (best[f][0], i) for i, (_, _, f) in enumerate(strings)}
            held = (conv, at, [best[f][3] if f in best else -1 for f in range(4)], int(last is not None and (last, first) not in LEGAL))
            last = end
        yield _packed(out, schema)
    if held is not None:
        yield _packed([(*held, _best_end(paths))], schema)


def _best_end(paths: dict[int, tuple[int, int]]) -> int:
    return min((cost + 5 * len(TAIL[f]), order, f) for f, (cost, order) in paths.items())[2]


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last pieces first: the states at which the best path enters and leaves each piece."""
    state = None
    for batch in batches:
        out = []
        for at, entries, illegal, final in zip(*(batch.column(c).to_pylist() for c in ("at", "entries", "illegal", "final"))):
            end = final if final >= 0 else state
            state = entries[end]
            out.append((at, state, end, final >= 0, illegal))
        yield _packed(out, pa.schema([("at", pa.int64()), ("entry", pa.int32()), ("end", pa.int32()), ("closes", pa.bool_()), ("across", pa.int64())]))


EDITS = "array<struct<id:long,before:string,own:string,after:string>>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their edits; those without an entry are whole conversations."""
    schema = pa.struct([("id", pa.int64()), ("before", pa.string()), ("own", pa.string()), ("after", pa.string())])
    for batch in batches:
        rows = []
        for ids, marks, entry, end, closes, across in zip(*(batch.column(c).to_pylist() for c in ("ids", "marks", "entry", "end", "closes", "across"))):
            if entry is None:
                entry, across = START, 0
                ((_, (cost, audit)),) = _cheapest(marks, START, True).items()
            else:
                cost, audit = _cheapest(marks, entry, False)[end]
                if closes:
                    cost, audit = cost + 5 * len(TAIL[end]), audit + TAIL[end]
            edits = [{"id": i, "before": e[0], "own": e[1], "after": e[2]} for i, e in zip(ids, row_edits(marks, audit, entry))]
            rows.append((cost, audit, across + illegal_pairs(marks), edits))
        columns = {"conv": batch.column("conv"), "at": batch.column("at")}
        for i, (name, kind) in enumerate((("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("edits", pa.list_(schema)))):
            columns[name] = pa.array([r[i] for r in rows], kind)
        yield pa.RecordBatch.from_pydict(columns)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, joined by newlines, as they stream by in order."""
    now, digest, schema = None, None, None
    for batch in batches:
        out, schema = [], pa.schema([batch.schema.field("conv"), ("sha256", pa.string())])
        for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
            line = line.encode("utf-8", "surrogatepass")
            if digest is None or conv != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256(line)
            else:
                digest.update(b"\n")
                digest.update(line)
        yield _packed(out, schema)
    if digest is not None:
        yield _packed([(now, digest.hexdigest())], schema)


def damage(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with faults planted by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20
    rows = df.select(F.col(f"`{conv_id}`").alias("a"), F.col(f"`{turn}`").alias("b"), space(role).alias("c"), space(text).alias("d"), k.alias("k"))
    rows = rows.filter("k <> 0").withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    changed = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("d", ".!?", "")).otherwise(F.col("d"))
    return rows.select(
        F.col("a").alias(conv_id), F.col("b").alias(turn), F.when(F.col("k") == 4, "user").otherwise(F.col("c")).alias(role), changed.alias(text)
    )


@dataclass
class Repaired:
    """``rows``: conv, turn, role, text, id; ``flagged``: rows in order with faults; ``solved``: pieces with edits."""

    rows: DataFrame
    flagged: DataFrame
    solved: DataFrame

    def conversations(self) -> DataFrame:
        """``conv, at, place, step, role, text``: the repaired turns; ``at, place, step`` order those of a conversation."""
        edits = self.solved.select("conv", "at", F.posexplode("edits").alias("place", "e")).select("conv", "at", "place", "e.*")
        joined = edits.join(self.rows.select("id", "role", "text"), "id")
        named = lambda x: F.when(x == "u", "user").otherwise("assistant")
        empty = lambda c: F.transform(F.split(c, ""), lambda x: F.struct(named(x).alias("role"), F.lit("").alias("text")))
        none = F.array().cast("array<struct<role:string,text:string>>")
        some = lambda c: F.when(F.col(c) == "", none).otherwise(empty(F.col(c)))
        own = F.when(F.col("own") == "K", F.col("role")).otherwise(named(F.col("own")))
        mine = F.when(F.col("own") == "D", none).otherwise(F.array(F.struct(own.alias("role"), F.col("text").alias("text"))))
        turns = joined.select("conv", "at", "place", F.posexplode(F.concat(some("before"), mine, some("after"))).alias("step", "t"))
        return turns.select("conv", "at", "place", "step", "t.role", "t.text")

    def summary(self) -> DataFrame:
        """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of conversations with rows.

        One task hashes a conversation, as its lines stream by; a hash has no parallel form.
        """
        count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
        faults = ("blank", "duplicate", "truncated")
        turns = self.flagged.groupBy("conv", "turn").agg(*map(count, faults)).groupBy("conv")
        span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
        stats = turns.agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.sum(f).alias(f) for f in faults])
        conv = self.rows.schema["conv"].dataType.simpleString()
        lines = self.conversations().select("conv", "at", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
        order = ("conv", "at", "place", "step")
        hashes = lines.repartition("conv").sortWithinPartitions(*order).select("conv", "line").mapInArrow(lean(_hash), f"conv {conv}, sha256 string")
        every = stats.unionByName(self.solved.select("conv", "at", "cost", "illegal", "audit"), True).unionByName(hashes, True)
        audits = F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("at", "audit"))))
        sums = [F.max("gaps").alias("gaps"), *[F.max(f).alias(f) for f in faults], F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost")]
        out = every.groupBy("conv").agg(*sums, audits.alias("audits"), F.max("sha256").alias("sha256"))
        return out.select(
            "conv", "gaps", *faults, "illegal", "cost", F.array_join(F.transform("audits", lambda x: x["audit"]), "").alias("audit"),
            F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def repair(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE
) -> Repaired:
    """The cheapest repair of every conversation.

    Rows go by turn, null turns first; rows of one turn by role and SHA-256 of the text, so reruns
    agree, and equal rows are told apart (the later are duplicates). A null conversation id is
    a conversation. Null roles and texts count as one space: such texts are blank, such roles have to
    change. The first fault of a row counts: blank, repeated (same role and text before), truncated.
    Other columns are not used. An empty table gives no conversations.
    """
    column = lambda c: F.col(f"`{c}`")
    space = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    rows = df.select(column(conv_id).alias("conv"), column(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "turns")
    own = F.when(~F.col("text").rlike(f"[^{SPACES}]"), "blank").when(~F.col("text").rlike(rf"[.!?][{SPACES}]*\z"), "truncated")
    narrow = rows.select("conv", "turn", "role", F.sha2("text", 256).alias("digest"), own.alias("own"), "id")
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest", "id")]
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    placed = materialize(placed, "turns-in-order")
    firsts = placed.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
    firsts = materialize(firsts.agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "turns-repeated")
    joined = placed.join(firsts, _same("conv", "c") & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("pos") > F.col("first"), "duplicate").otherwise(F.col("own"))
    flagged = joined.select("conv", "turn", "id", "pos", F.substring("role", 1, 1).alias("i"), fault.alias("fault"))
    initial = F.when(F.col("i") == "s", 0).when(F.col("i") == "u", 1).when(F.col("i") == "a", 2).otherwise(3)
    weight = F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", TRUNCATED).otherwise(DELETE)
    flagged = materialize(flagged.select("conv", "turn", "id", "pos", "fault", (initial + 4 * weight).cast("int").alias("mark")), "turns-flagged")
    conv = rows.schema["conv"].dataType.simpleString()
    ordered = flagged.select("conv", "pos", "id", "mark").repartitionByRange("pos").sortWithinPartitions("pos")
    schema = f"conv {conv}, at long, ids array<long>, marks binary"
    pieces = materialize(ordered.mapInArrow(lean(lambda batches: _cut(batches, piece)), schema), "turn-pieces")
    cut = pieces.groupBy(F.col("conv").alias("c")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c")
    some = pieces.join(cut, _same("conv", "c"), "left_semi").select("conv", "at", "marks")
    tables = some.mapInArrow(lean(_tables), f"conv {conv}, at long, costs array<long>, ranks array<int>, first int, last int")
    ahead = tables.repartition("conv").sortWithinPartitions("conv", "at")
    ahead = materialize(ahead.mapInArrow(lean(_forward), f"conv {conv}, at long, entries array<int>, illegal long, final int"), "turn-links")
    back = ahead.repartition("conv").sortWithinPartitions("conv", F.desc("at"))
    ways = materialize(back.mapInArrow(lean(_backward), "at long, entry int, end int, closes boolean, across long"), "turn-ways")
    led = pieces.join(ways, "at", "left").select("conv", "at", "ids", "marks", "entry", "end", "closes", "across")
    solved = led.mapInArrow(lean(_solve), f"conv {conv}, at long, cost long, audit string, illegal long, edits {EDITS}")
    return Repaired(rows, flagged, materialize(solved, "turn-edits"))
