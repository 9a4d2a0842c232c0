"""Every operator and pipeline stage on a table whose columns have any name, with nulls, empties, 5 MB texts, repeats and ties."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from knotwork.llm import decontaminate, exact_dedup, language_id, line_dedup, mixing, neural_lm, ngram_join, secret_scan, token_files, warc

NAMES = (
    "_k1 _k2 _k3 _band _split _rank _before _gone secrets _row _text _t _s _d _copy _copies _items _mask _body c0 c1 _done _clean "
    "_mix_source _source _size _id _row_key _id_of_row _pred _score _runs size kept n_words n_hit items contaminated keep_id group_size "
    "text_sha256 _spans lang_pred score lang_spans copies taken target source_size n_lines n_dropped part id ids body i x d r p whole root "
    "component n h key _response _n _sum html url page_id n_tokens n_known base_score start ids_crc32"
).split()
BIG = "\n".join(" ".join(f"w{(i * 7919 + j) % 9973}" for j in range(50)) for i in range(18_000))
TEXTS = [
    (1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, "the cat and the dog, one two three", "b"), (5, "the cat and the dog, one two three", "b"),
    (5, "the cat and the dog, one two three", "b"), (6, BIG, "c"), (7, BIG + " end", "c"), (8, "x" * 5_000_000, "c"), (None, "le chat et le chien, un deux trois", "a"),
    (9, "password = abcdefghijkl12", None),
]
assert len(BIG) > 5_000_000


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, s, "en" if i else "fr", *[f"v_{n}" for n in NAMES]) for i, t, s in TEXTS]
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema)


def identified(df):
    return language_id.identify(df, language_id.train(df, per_label=3), spans=True)


def items(df):
    return df.sparkSession.createDataFrame([("q", "the cat and the dog one two three")], "item_id string, text string")


WHOLE = {  # every row comes back
    "mix_sources": (mixing.mix_sources, "size source_size target copies taken"),
    "dedup_lines": (lambda df: line_dedup.dedup_lines(df, groups_of=line_dedup.alike_groups), "n_lines n_dropped"),
    "identify": (identified, "lang_pred score lang_spans"),
    "exact_duplicates": (exact_dedup.exact_duplicates, "keep_id group_size kept text_sha256"),
    "find_contamination": (lambda df: decontaminate.find_contamination(df, items(df)), "n_words n_hit items contaminated"),
    "cut_spans": (lambda df: decontaminate.decontaminate(df, items(df), remove="spans"), ""),
    "scan_secrets": (secret_scan.scan_secrets, "secrets"),
    "redact": (secret_scan.redact, ""),
}
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_rows_come_back_with_their_columns(table, name):
    run, results = WHOLE[name]
    for df in (table, table.limit(0)):
        out = run(df)
        assert sorted(out.columns) == sorted({*df.columns, *results.split()})
        others = [c for c in NAMES if c not in results.split()]
        rows = out.select("doc_id", *[f"`{c}`" for c in others]).collect()
        assert Counter(r.doc_id for r in rows) == (Counter(i for i, _, _ in TEXTS) if df is table else Counter())
        assert all(r[c] == f"v_{c}" for r in rows for c in others)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, table, name):
    for df in (table, table.limit(0)):
        out = STAGES[name](spark, df, "/root/testdata/sf0.001")
        assert out.columns == df.columns
        rows = out.drop("text").collect()
        assert all(r[c] == f"v_{c}" for r in rows for c in NAMES)
        found = Counter(r.doc_id for r in rows)
        assert not found if df is not table else found
        if df is table and name == "language id":
            assert not {1, 2, 3} & set(found) and {4, 5, None} <= set(found)
        if df is table and name == "n-gram join":
            assert found == Counter([1, 2, 3, 4, 6, 8, 9, None])
        if df is table and name == "decontamination":
            assert found == Counter(i for i, _, _ in TEXTS)


def test_token_stage(spark, table):
    out = STAGES["token files"](spark, table, "").collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _, _ in TEXTS) and out[0].__fields__ == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id: r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1: 1, 2: 1, 3: 1}
    assert STAGES["token files"](spark, table.limit(0), "").count() == 0


def test_run_is_its_stages(spark):
    """The pipeline's rows are those of its stages run one by one, each held against what it promises."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs.filter(language_id.fold("doc_id") != 1))
    known = {r.doc_id for r in language_id.identify(docs, model).filter("lang_pred <> 'und' and score >= 0.4").collect()}
    one = STAGES["language id"](spark, docs, sf_dir)
    assert {r.doc_id for r in one.collect()} == known
    sets = {}
    for r in one.collect():
        words = [w.decode() for w in neural_lm.lower_words(r.text)]
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids, root = sorted(sets), {i: i for i in sets}
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    two = STAGES["n-gram join"](spark, one, sf_dir)
    kept = {i for i in ids if root[i] == i}
    assert {r.doc_id for r in two.collect()} == kept
    grams = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = decontaminate.alnum_words(r.text)
        n = min(10, len(words))
        grams |= {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
    hit = set()
    for r in two.collect():
        words = decontaminate.alnum_words(r.text)
        if any(tuple(words[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(words) - n + 1)):
            hit.add(r.doc_id)
    three = STAGES["decontamination"](spark, two, sf_dir)
    assert {r.doc_id for r in three.collect()} == kept - hit
    four = STAGES["mixing"](spark, three, sf_dir)
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(three).collect()}
    assert Counter(r.doc_id for r in four.collect()) == Counter({i: n for i, n in copies.items() if n})
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in four.collect())
    want = [tuple(r) for r in STAGES["token files"](spark, four, sf_dir).collect()]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_scores_and_files_of_odd_tables(spark, table):
    scored, _ = neural_lm.score_documents(table, table, examples=2000, classes=50)
    by_id = {}
    for r in scored.collect():
        by_id.setdefault(r.doc_id, set()).add((r.n_tokens, round(r.score, 6)))
    assert len(by_id) == 10 and by_id[1] == by_id[2] == by_id[3] and by_id[4] == by_id[5]
    assert neural_lm.score_documents(table.limit(0), table.limit(0))[0].count() == 0
    pages = table.select("doc_id", "text", *[f"`{n}`" for n in NAMES])
    read = warc.read_warc(warc.write_warc(pages, key="doc_id", url="url", payload="text")).collect()
    assert Counter(r.key for r in read) == Counter(i for i, _, _ in TEXTS)
    manifest, frequencies = token_files.write_token_files(table)
    assert token_files.read_token_files(manifest, frequencies).count() == len(TEXTS)


def test_windows_that_share_a_hash(monkeypatch):
    rows = [("a", "one two three"), ("b", "two three four"), ("c", "one two three"), ("d", "four")]
    text = decontaminate.alnum_words("zero one two three four five")
    want = decontaminate.WindowSet(rows, 2).scan([text, []])
    monkeypatch.setattr(decontaminate, "word_hashes", lambda words: np.zeros(len(words), np.uint64))
    got = decontaminate.WindowSet(rows, 2).scan([text, []])
    assert got[0].tolist() == want[0].tolist() == [False, True, True, True, True, False]
    assert got[3] == want[3] == {0: {"a", "b", "c", "d"}}


def test_workers_drop_what_other_operators_kept(spark):
    from knotwork.llm import common

    def keeps(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([common.kept("a", list) is common.kept("a", list)])})

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([not common._kept])})

    one = spark.range(1, numPartitions=1)
    for run, owner in ((keeps, "a"), (held, None)):
        assert one.mapInArrow(common.lean(run, owner), "n boolean").first().n
    common.kept("a", list).append(1)
    common.drop_kept("a")
    assert common.kept("a", list) == [1]
    common.drop_kept()
    assert common.kept("a", list) == []


def test_language_stage_keeps_text_alone_and_in_place(spark):
    from knotwork.llm import language_id

    docs = [(i, t, l) for i, (t, l) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 20)]
    df = spark.createDataFrame(docs + [(99, None, "en")], "doc_id long, text string, lang string")
    model = language_id.train(df)
    kept = language_id.keep_known(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(40))
    assert {tuple(r) for r in kept.collect()} == set(docs)
    assert language_id.keep_known(df.select("text"), model).columns == ["text"]
    assert language_id.keep_known(df.select("text"), model).count() == 40
