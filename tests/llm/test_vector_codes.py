"""Vector codes against plain search of all entries, and odd rows."""

import math

import numpy as np
import pytest

from knotwork.llm import queries, vector_codes
from tests.oracle import mismatch

SCHEMA = "vec_id long, label int, embedding array<float>, r string, c string, code string, `_label` string"


def plain(rows, parts, entries, rounds):
    """Codes and errors by trying every entry, and the codebooks as lists."""
    ints = [[math.floor(256 * x) for x in v] for v in rows]
    width = len(ints[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        found = [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in cut]
        if turn == rounds:
            return found, books
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [v[p] for v, f in zip(cut, found) if f[p][1] == i]
                if mine:
                    books[p][i] = tuple(sum(x) // len(mine) for x in zip(*mine))


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_search_finds_the_nearest_entry_from_any_start(spread):
    draw = np.random.default_rng(spread)
    book = draw.integers(-spread, spread + 1, (40, 3))
    x = draw.integers(-spread, spread + 1, (500, 3))
    apart = ((x[:, None] - book[None]) ** 2).sum(2)
    for start in (np.zeros(500, np.int64), draw.integers(0, 40, 500)):
        best, least = vector_codes.Neighbours(book).nearest(x, start)
        assert best.tolist() == apart.argmin(1).tolist() and least.tolist() == apart.min(1).tolist()


def test_codes_against_trying_every_entry(spark):
    draw = np.random.default_rng(5)
    vectors = np.round(draw.normal(0, 0.05, (120, 8)), 3).astype(np.float32)
    vectors[30:60] = vectors[7]
    rows = [(i, i % 3 or None, [float(x) for x in v], "r", "c", "code", "l") for i, v in enumerate(vectors)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), parts=4, entries=16)
    found, want = plain([r[2] for r in rows], 4, 16, 2)
    assert [[tuple(e) for e in b] for b in books.books.tolist()] == want
    got = {r.vec_id: r for r in vector_codes.with_label_error(coded).collect()}
    for i, f in enumerate(found):
        assert list(got[i].code) == [e for _, e in f] and got[i].error == sum(d for d, _ in f)
        assert got[i].label_error == sum(got[j].error for j in range(120) if j % 3 == i % 3)
        assert (got[i].r, got[i].c, got[i]["_label"]) == ("r", "c", "l")


def test_odd_rows(spark):
    one = [0.5, -0.5, 0.001, -0.001]
    rows = [
        (3, 1, one), (3, 1, one), (None, None, one), (4, None, [1.0] * 4), (5, 1, None), (6, 1, []), (7, 1, [1.0, None, 1.0, 1.0]),
        (8, 1, [math.nan] * 4), (9, 1, [math.inf] * 4), (10, 1, [1.0] * 3), (11, 1, [1.0] * 8),
    ]
    df = spark.createDataFrame([(*r, "", "", "", "") for r in rows], SCHEMA)
    coded, books = vector_codes.compress(df, parts=2)
    assert books.books.tolist() == [[[128, -128]] * 2 + [[256, 256], [128, -128]], [[0, -1]] * 2 + [[256, 256], [0, -1]]]
    assert sorted((r.vec_id or 0, bytes(r.code), r.error) for r in coded.collect()) == [(0, b"\0\0", 0), (3, b"\0\0", 0), (3, b"\0\0", 0), (4, b"\2\2", 0)]
    empty, books = vector_codes.compress(df.limit(0), parts=2)
    assert vector_codes.with_label_error(empty).count() == 0 and books.books.size == 0
    with pytest.raises(ArithmeticError):
        vector_codes.compress(spark.createDataFrame([(1, 1, [1e30] * 4, "", "", "", "")], SCHEMA), parts=2)


def test_query_equals_sql(spark):
    name = "op11_vector_codes"
    assert mismatch(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001") == ""
