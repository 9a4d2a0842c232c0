"""Toxicity: the automaton against edit distances, the score against one pass, held-out accuracy, odd rows."""

import random

import numpy as np
import pytest

from knotwork.llm import queries, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def nearest(word, terms):
    """Errors, length and place of the best term by whole tables of edit distances."""
    found = []
    for i, t in enumerate(terms):
        stem = not t.endswith(" ")
        ends = [distance(word[:k], t.rstrip(" "))[-1] for k in (range(len(word) + 1) if stem else [len(word)])]
        if min(ends) <= toxicity.errors_allowed(t):
            found.append((min(ends), -len(t), i))
    return min(found)[:0:-2] + (min(found)[0],) if found else None


@pytest.mark.parametrize("few", [True, False])
def test_automaton_against_edit_distances(few, monkeypatch):
    """Random words near random terms; with few transitions remembered it gives the same."""
    if few:
        monkeypatch.setattr(toxicity, "MOVES", 30)
    draw = random.Random(4)
    terms = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(3, 11))) + draw.choice(["", " "]) for _ in range(40)})
    matcher = toxicity.Matcher(terms)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 13))) for _ in range(1500)]
    for t in terms:
        w = t.rstrip(" ")
        i = draw.randrange(len(w))
        words += [w, w[:i] + w[i + 1 :], w[:i] + "d" + w[i:], w[:i] + "d" + w[i + 1 :], w + "ddd"]
    for w in words:
        want = nearest(w, terms)
        assert matcher.match(w) == want, w
    assert toxicity.Matcher([]).match("abc") is None


def test_terms_leave_out_what_others_cover():
    rows = [("tra", 60), ("trash ", 50), ("lowei", 40), ("trash", 50), ("trashy", 10), ("loweich", 20), ("lowe", 45), ("low", 70), ("scum ", 9)]
    assert toxicity.choose_terms(rows, 10) == ["trash ", "lowei", "trashy", "lowe", "scum "]
    assert toxicity.choose_terms(rows, 2) == ["trash ", "lowei"]


@pytest.fixture(scope="module")
def made(spark):
    """Texts of plain words; toxic ones hold insults, some misspelled; others quote them after a word of report."""
    draw = random.Random(8)
    plain = ["".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(300)]
    bad, rows = ["wretchling", "snotface", "dunderhead"], []
    for i in range(900):
        words = [draw.choice(plain) for _ in range(draw.randint(20, 60))] + ["you", "reported", "quote"] * 3
        draw.shuffle(words)
        kind = i % 3
        for _ in range((0, 3, 1)[kind]):
            at, w = draw.randrange(len(words)), draw.choice(bad)
            if kind == 1 and draw.random() < 0.3:
                k = draw.randrange(1, len(w))
                w = w[:k] + w[k + 1 :]
            words[at] = f"you {w}" if kind == 1 else f'reported "{w}" quote'
        rows.append((i, " ".join(words), int(kind == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return docs, toxicity.train(docs.filter("doc_id < 600"), docs.select("doc_id", "toxic"))


def test_misspellings_count_and_quotations_do_not(made):
    docs, model = made
    assert {t.strip()[:8] for t in model.terms} >= {"wretchli", "snotface", "dunderhe"}
    rows = toxicity.score_toxicity(docs.filter("doc_id >= 600"), model, carry=["doc_id", "toxic", "text"], spans=True).collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    spans = [(r, s) for r in rows for s in r.toxic_spans]
    assert sum(s.errors > 0 for _, s in spans) > 20
    assert sum(s.quoted != bool(r.toxic) for r, s in spans) >= 0.95 * len(spans)
    assert all(r.text[s.start : s.end].lower().startswith(s.term[:1]) or s.errors for r, s in spans)


def test_score_against_one_pass(made):
    docs, model = made
    reader = toxicity.Reader(model)
    for r in toxicity.score_toxicity(docs, model).collect():
        x = np.array([reader.features(r.text)[0]])
        assert r.score == pytest.approx(float(model.probability(x)[0])) and r.predicted == (r.score >= 0.3)


def test_odd_rows(spark, made):
    _, model = made
    names = "x p s y t _id _body c0 score predicted toxic_spans key pos neg"
    texts = [None, "", " ", "wretchling", "WRETCHLING you", "x" * 5_000_000, "a***" * 1_000_000, "you wretchling " * 100_000, "İ you snotface"]
    df = spark.createDataFrame([(i, t, *["v"] * 14) for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names.split()))
    rows = {r.doc_id: r for r in toxicity.score_toxicity(df, model, spans=True).collect()}
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.x == r.key == "v" for r in rows.values())
    assert rows[0].score == rows[1].score == rows[2].score < 0.3 and rows[3].score == rows[9].score
    assert rows[7].predicted == 1 and [(s.start, s.end) for s in rows[8].toxic_spans] == [(6, 14)]
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (2, 1), (77, 0), (None, 1)], "doc_id long, toxic int")
    one = toxicity.train(df, labels)
    assert one.share == 1.0 and {r.score for r in toxicity.score_toxicity(df, one).collect()} == {1.0}
    none = toxicity.train(df, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(df, none).collect()} == {0.0}
    assert toxicity.train(df.limit(0), labels).share == 0.0


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_held_out_documents(spark, sf):
    """Labels of a quarter of the documents, not seen in training: few misses, few false alarms."""
    folder = f"/root/testdata/{sf}"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op12_toxicity(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(rows) == docs.count() and all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p and y for p, y in held)
    assert hit >= 0.9 * sum(y for _, y in held) and hit >= 0.9 * sum(p for p, _ in held), held and (hit, sum(y for _, y in held), sum(p for p, _ in held))
