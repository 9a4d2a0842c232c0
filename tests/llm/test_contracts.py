"""Queries without SQL against brute force over whole test tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
import math

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from knotwork.llm import language_id, neural_lm, queries, secret_scan, token_files

SF = "/root/testdata/sf0.001"
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 18),
    "hex": (r"([0-9a-f]+)", 1, 16),
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_secrets_against_plain_expressions(spark, texts):
    got = {r.doc_id: r for r in queries.op10_secret_scan(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        spans = []
        for k, (kind, (pattern, group, least)) in enumerate(BASE.items()):
            here = [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "", re.A) if len(m[group]) >= least]
            assert got[i][f"n_{kind}"] == len(here)
            spans += here
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_index_finds_what_full_scans_find(texts):
    scanner = secret_scan.Scanner(secret_scan.RULES)
    whole = [*texts.values(), "api_key: 'ABCDEFGHIJKLMN'", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----"]
    got = scanner.spans(pa.array(whole, pa.string()))
    for text, spans in zip(whole, got):
        want = []
        for k, rule in enumerate(secret_scan.RULES):
            for m in re.finditer(rule.scan or rule.pattern, text or "", re.A):
                if len(m.group(rule.group)) >= rule.least:
                    want.append((m.start(), k, m.end()))
        assert spans == sorted(want)


def test_token_files_against_the_library(spark, texts):
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in queries.op6_token_files(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)


ODD = [
    None, "", " ", "a b\x85c\x1cd\x1fe\vx\fy\rz\n\n", "it's <|endoftext|> here", "x<|startoftext|>", ". , ;",
    "\u0130stanbul \u03a3\u03a3 A\u0301", "\u3000\u4e2d\u6587 x", "long" * 50_000, "\u4e2d\u6587" * 20_000, "a.b, 12,5; \u00c9\u00df\u00aa",
]


@pytest.mark.parametrize("splits, most", [(True, 300_000), (True, 20), (False, 300_000)])
def test_word_tokenizer_against_the_library(splits, most):
    """Any Latin-1 character, marks, special tokens, other scripts, long words; a memory that forgets at once."""
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    library, draw = Tokenizer.from_str(definition), random.Random(3)
    signs = [chr(c) for c in range(256)] + list("'stmdlre.,:; \n\t") * 4 + list("\u0130\u03a3\u0301\u4e2d\u2003\u200b")
    texts = ODD + ["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    words = token_files.WordTokenizer(definition, splits, most)
    for part in (texts[:1000], texts[1000:], texts[:1000], []):
        ids, counts = words.encode(pa.array(part, pa.string()), 1)
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in part]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
    assert all(len(piece) <= token_files.LONGEST for piece in words.known)


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_language_model_against_counts_and_plain_scores(spark, texts):
    got = {r.doc_id: r for r in queries.op5_neural_lm(spark, SF).collect()}
    training = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in training for w in tokens_of(texts[i]))
    total, types = sum(counts.values()), len(counts)
    for i, text in texts.items():
        tokens = tokens_of(text)
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in tokens)
        assert (got[i].held_out, got[i].n_tokens, got[i].train_tokens) == (i not in training, len(tokens), total)
        assert got[i].n_known == sum(counts[w] > 0 for w in tokens) and got[i].base_score == pytest.approx(base)


def test_held_out_texts_gain_from_the_network(spark):
    rows = [r for r in queries.op5_neural_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.1


def test_language_id_against_one_pass(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter(language_id.fold("doc_id") != 1))
    got = {r.doc_id: r for r in queries.op4_language_id(spark, SF).collect()}
    step = np.exp(model.moves)
    for i, text in texts.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        words = language_id.words_of(text)
        letters = np.array([language_id.has_letter(w) for w in words], bool)
        if not letters.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = np.exp(model.emissions(words).astype(float))
        ahead, back = [x[0] * (np.ones(len(step)) @ step)], [np.ones(len(step))]
        for t in range(1, len(x)):
            ahead.append(ahead[-1] / ahead[-1].sum() @ step * x[t])
            back.append(step @ (x[-t] * back[-1] / back[-1].sum()))
        both = np.array(ahead) * np.array(back[::-1])
        mean = (both / both.sum(1, keepdims=True))[letters].mean(0)
        assert got[i].lang_pred == model.labels[int(mean.argmax())] and got[i].score == pytest.approx(mean.max(), abs=1e-4)
