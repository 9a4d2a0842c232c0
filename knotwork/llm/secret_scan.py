"""Secret scanning through a trigram inverted index.

Each rule is a regular expression plus a least length of one group. Its Boolean
trigram query is derived from the parsed expression: alternatives become OR,
sequences AND, and literal stretches (with optional characters expanded) the AND
of their trigrams. Every Arrow batch is a segment with its own inverted index
over lower-cased UTF-8; postings of the trigrams that the rules ask for are
intersected and united as the query says, and only the remaining documents are
matched. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, packed
from .decontaminate import parts_by_bytes

#: More literal alternatives than this are not kept as exact strings.
MOST_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """``scan`` may give an equivalent, faster expression of the kept matches."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    scan: str = ""


# The three kinds of the contract, then well-known key formats.
BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, 0, r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]+://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES


# A query is True (no constraint), a trigram (bytes), or ("and"|"or", queries).
def both(a, b):
    if a is True:
        return b
    return a if b is True or a == b else ("and", (a, b))


def either(queries):
    queries = list(dict.fromkeys(queries))
    if True in queries:
        return True
    return queries[0] if len(queries) == 1 else ("or", tuple(queries))


def of_string(text: bytes):
    grams = list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))
    return True if not grams else grams[0] if len(grams) == 1 else ("and", tuple(grams))


def of_strings(texts: set[bytes]):
    return either([of_string(t) for t in sorted(texts)])


def _char(code: int) -> bytes:
    data = chr(code).encode("utf-8", "surrogatepass")
    return data.lower()


def _walk(parsed) -> tuple[set[bytes] | None, object]:
    """(all strings that it can match, if few; a query that every match meets)."""
    exact: set[bytes] | None = {b""}
    query: object = True
    run: set[bytes] = {b""}
    for op, arg in parsed:
        part, need = _node(op, arg)
        query = both(query, need)
        joined = {a + b for a in run for b in part} if part is not None and len(run) * len(part) <= MOST_EXACT else None
        if joined is None:
            query = both(query, of_strings(run))
            exact, run = None, part if part is not None and len(part) <= MOST_EXACT else {b""}
        else:
            run = joined
    return (run, query) if exact is not None else (None, both(query, of_strings(run)))


def _node(op, arg) -> tuple[set[bytes] | None, object]:
    if op is sre.LITERAL:
        return {_char(arg)}, True
    if op is sre.IN:
        chars: set[bytes] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(_char(value))
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                chars |= {_char(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        sides = [_walk(p) for p in arg[1]]
        if all(e is not None for e, _ in sides):
            return set().union(*[e for e, _ in sides]), either([q for _, q in sides])
        return None, either([both(q, of_strings(e) if e is not None else True) for e, q in sides])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, inner = arg
        exact, query = _walk(inner)
        if low == 0:
            return (exact | {b""}, True) if high == 1 and exact is not None else (None, True)
        if exact is not None and low == high and len(exact) ** min(int(low), 7) <= MOST_EXACT and low <= 8:
            out = {b""}
            for _ in range(low):
                out = {a + b for a in out for b in exact}
            return out, query
        return None, both(query, of_strings(exact) if exact is not None else True)
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {b""}, True
    return None, True


def trigram_query(pattern: str):
    """A query over lower-cased trigrams that every match of ``pattern`` meets."""
    exact, query = _walk(sre_parser.parse(pattern))
    return both(query, of_strings(exact)) if exact is not None else query


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


def evaluate(query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Flags of the documents of a segment that meet the query."""
    if query is True:
        return np.ones(n, bool)
    if isinstance(query, bytes):
        return postings[query]
    join = np.logical_and if query[0] == "and" else np.logical_or
    return join.reduce([evaluate(q, postings, n) for q in query[1]])


class TrigramIndex:
    """Builds the postings of a fixed set of trigrams for one segment."""

    def __init__(self, grams: set[bytes]):
        self.grams = sorted(grams)
        self.codes = np.array([int.from_bytes(g, "big") for g in self.grams], np.int64)
        self.lower = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
        self.screen = np.zeros(1 << 16, bool)
        for g in self.grams:
            self.screen[((g[0] << 11) ^ (g[1] << 5) ^ g[2]) & 0xFFFF] = True

    def postings(self, data: np.ndarray, bounds: np.ndarray) -> dict[bytes, np.ndarray]:
        """data: UTF-8 of all documents; document i is data[bounds[i]:bounds[i + 1]]."""
        n = len(bounds) - 1
        found = np.zeros((len(self.grams), n), bool)
        if len(data) >= 3 and self.grams:
            low = self.lower[data]
            wide = low.astype(np.uint16)
            at = np.flatnonzero(self.screen[(wide[:-2] << 11) ^ (wide[1:-1] << 5) ^ wide[2:]])
            codes = (low[at].astype(np.int64) << 16) | (low[at + 1].astype(np.int64) << 8) | low[at + 2]
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            right = self.codes[place] == codes
            at, place = at[right], place[right]
            doc = np.searchsorted(bounds, at, side="right") - 1
            inside = at + 3 <= bounds[doc + 1]
            found[place[inside], doc[inside]] = True
        return dict(zip(self.grams, found))


def segment_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its values; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        # re.ASCII: letter case is that of A-Z only
        self.rules = [
            (r, re.compile(r.scan or r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules
        ]
        self.index = TrigramIndex(set().union(*[trigrams_of(q) for _, _, q in self.rules], set()))

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per document (start, rule number, end) in code points, sorted."""
        n = len(column)
        postings = self.index.postings(*segment_of(column))
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        texts: dict[int, str] = {}
        for k, (rule, expression, query) in enumerate(self.rules):
            for i in np.flatnonzero(evaluate(query, postings, n)).tolist():
                if i not in texts:
                    texts[i] = column[i].as_py() or ""
                for m in expression.finditer(texts[i]):
                    if len(m.group(rule.group)) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in found]


def scan_secrets(
    df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, carry: list[str] | None = None
) -> DataFrame:
    """The rows of ``df`` with ``secrets``: array of (kind, start, end), end exclusive.

    Positions are code points. Per rule, matches are leftmost and do not
    overlap; too short ones are dropped. Null and empty texts have none; equal
    rows give equal results; an empty table gives no rows. A column of ``df``
    named ``secrets`` is replaced. ``carry`` names the columns to return.
    """
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() != "secrets"]
    inner = [f"c{i}" for i in range(len(carry))]
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(carry, inner)], F.col(text).cast("string").alias("_body"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for whole in batches:
            for start, n in parts_by_bytes(whole.column("_body"), 8 << 20):
                part = whole.slice(start, n)
                spans = [
                    [{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in doc]
                    for doc in scanner.spans(part.column("_body"))
                ]
                columns = {c: part.column(c) for c in inner} | {"_spans": pa.array(spans, pa.list_(span))}
                yield pa.RecordBatch.from_pydict(columns)

    fields = T.StructType(
        [rows.schema[c] for c in inner]
        + list(T._parse_datatype_string("_spans array<struct<kind:string,start:bigint,end:bigint>>").fields)
    )
    out = rows.mapInArrow(lean(run), fields)
    return out.select(*[F.col(a).alias(c) for c, a in zip(carry, inner)], F.col("_spans").alias("secrets"))


def redact(df: DataFrame, text: str = "text", mark: str = "<secret>", **options) -> DataFrame:
    """``df`` with every found span replaced by ``mark`` (overlaps count once).

    Null texts stay null; all other columns stay, whatever their names.
    """
    whole = df.select(packed(df).alias("_row"), F.col(text).cast("string").alias("_text"))
    found = scan_secrets(whole, "_text", **options)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(
        s["start"] < acc["at"],
        F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")),
    ).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(
                acc["out"],
                F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.lit(mark),
            ).alias("out"),
        )
    )
    done = F.aggregate("secrets", start, step)
    rest = F.expr("substring(_text, cast(_done.at + 1 as int))")
    clean = found.withColumn("_done", done).withColumn("_clean", F.concat(F.col("_done.out"), rest))
    return clean.select(*[F.col("_clean" if c == text else f"_row.`{c}`").alias(c) for c in df.columns])
