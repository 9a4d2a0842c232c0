"""Language identification of code-switched text by a linear-chain CRF.

Words are labelled with languages. Each word has affix, byte n-gram and lexicon
features whose weights, like the transitions between labels, are learned by
maximum conditional likelihood in numpy. Training labels are those of whole
documents; chains are cut from documents, and some are spliced from several so
that switches occur. Marginals come from the forward-backward algorithm over the
whole text: the chain is cut in blocks, the matrix products of all blocks of a
batch are formed together, a short scan over blocks gives every block's entry
and exit messages, and a second pass fills in the words. This is exact for texts
of any length. A document's language is the label with the largest mean marginal.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, give_back, lean, packed
from .decontaminate import parts_by_bytes

#: Letters whose features are held at a time; bytes of text labelled at a time.
LETTERS, PIECE = 1 << 18, 1 << 20
HASHES = 1 << 16
BLOCK = 32
CHAIN = 64


class Features:
    """Rows of weight indices for words; index 0 stands for no feature."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = {w: HASHES + 1 + i for i, w in enumerate(lexicon)}
        self.size = HASHES + 1 + len(lexicon)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Weight indices of all words one after another, and how many each has.

        Every word has its lexicon entry, eight affixes from its real ends and all its trigrams.
        """
        n = len(words)
        raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
        length = np.fromiter(map(len, raw), np.int64, n)
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        start = np.cumsum(length) - length
        out = [np.fromiter((self.lexicon.get(w, 0) for w in words), np.int64, n)]

        def index(code: np.ndarray, kind: int) -> np.ndarray:
            mixed = (code + np.uint32(kind * 0x01000193)) * np.uint32(0x9E3779B1)
            return (mixed >> np.uint32(16)).astype(np.int64) % HASHES + 1

        code, end = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        for k in range(1, 5):
            code = code * np.uint32(257) + data[start + np.minimum(k, length - 1)]
            end = end * np.uint32(257) + data[start + np.maximum(length - 1 - k, 0)]
            out.append(np.where(length >= k + 2, index(code, 1 + k), 0))
            out.append(np.where(length >= k + 2, index(end, 5 + k), 0))
        fixed = len(out)
        sizes = fixed + np.maximum(length - 2, 0)
        first = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int64)
        for i, column in enumerate(out):
            flat[first + i] = column
        word = np.repeat(np.arange(n), length - 2)  # trigrams, which also give the affixes of two letters
        inside = np.arange(len(word)) - np.repeat(np.cumsum(length - 2) - (length - 2), length - 2)
        at = start[word] + inside
        flat[first[word] + fixed + inside] = index(data[at] | (data[at + 1] << 8) | (data[at + 2] << 16), 1)
        return flat, sizes


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Crf:
    """labels, weights (feature x label), transitions (label x label)."""

    def __init__(self, labels: list[str], lexicon: list[str]):
        self.labels, self.features = labels, Features(lexicon)
        self.weights = np.zeros((self.features.size, len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.empty((len(words), len(self.labels)), np.float32)
        at = 0
        while at < len(words):  # pieces of bounded size, or one longer word
            size, stop = len(words[at]), at + 1
            while stop < len(words) and size + len(words[stop]) <= LETTERS:
                size += len(words[stop])
                stop += 1
            flat, sizes = self.features.rows(words[at:stop])
            ends = np.cumsum(sizes)
            for j in range(len(self.labels)):
                out[at:stop, j] = np.add.reduceat(self.weights[flat, j], ends - sizes)
            at = stop
        out[[not has_letter(w) for w in words]] = 0
        return out

    def marginals(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label marginals of all words; ``scores`` holds the documents one after another."""
        n, k = scores.shape
        if not n:
            return np.zeros((0, k))
        step = np.exp(self.moves)
        sizes = sizes[sizes > 0]
        blocks = -(-sizes // BLOCK)
        first_word = np.cumsum(sizes) - sizes
        first_block = np.cumsum(blocks) - blocks
        doc_of_block = np.repeat(np.arange(len(sizes)), blocks)
        inside = np.arange(blocks.sum()) - first_block[doc_of_block]
        place = first_word[doc_of_block] + inside * BLOCK
        held = np.minimum(BLOCK, sizes[doc_of_block] - inside * BLOCK)
        at = place[:, None] + np.arange(BLOCK)[None, :]
        real = np.arange(BLOCK)[None, :] < held[:, None]
        at = np.where(real, at, 0)
        x = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)[at]
        m = len(place)
        product = np.broadcast_to(np.eye(k), (m, k, k)).copy()
        for t in range(BLOCK):
            new = (product.reshape(-1, k) @ step).reshape(m, k, k) * x[:, t, None, :]
            new /= new.max((1, 2), keepdims=True)
            product = np.where(real[:, t, None, None], new, product)
        order = np.argsort(-blocks, kind="stable")
        entry, leave = np.empty((m, k)), np.empty((m, k))
        forward, backward = np.full((len(sizes), k), 1.0), np.full((len(sizes), k), 1.0)
        for b in range(int(blocks.max())):
            live = order[: np.searchsorted(-blocks[order], -b, side="left")]
            now, last = first_block[live] + b, first_block[live] + blocks[live] - 1 - b
            entry[now], leave[last] = forward[live], backward[live]
            f = np.einsum("ni,nij->nj", forward[live], product[now])
            g = np.einsum("nij,nj->ni", product[last], backward[live])
            forward[live], backward[live] = f / f.max(1, keepdims=True), g / g.max(1, keepdims=True)
        alpha = np.empty((m, BLOCK, k))
        a = entry
        for t in range(BLOCK):
            new = (a @ step) * x[:, t]
            a = np.where(real[:, t, None], new / new.max(1, keepdims=True), a)
            alpha[:, t] = a
        b = leave
        for t in range(BLOCK - 1, -1, -1):
            alpha[:, t] *= b
            new = (b * x[:, t]) @ step.T
            b = np.where(real[:, t, None], new / new.max(1, keepdims=True), b)
        out = alpha[real]
        return out / out.sum(1, keepdims=True)

    def fit(self, docs: list[tuple[list[str], int]], epochs: int, rate: float, decay: float, seed: int) -> None:
        """Adam on the likelihood of chains of ``CHAIN`` words."""
        rng = np.random.default_rng(seed)
        vocabulary: dict[str, int] = {}
        chains, labels = [], []
        for words, label in docs:
            ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words))
            for start in range(0, max(1, len(ids) - CHAIN // 2), CHAIN):
                part = ids[start : start + CHAIN]
                chains.append(np.pad(part, (0, CHAIN - len(part)), constant_values=-1))
                labels.append(label)
        if not chains:
            return
        grid, of = np.stack(chains), np.array(labels)
        spliced, spliced_of = grid.copy(), np.repeat(of[:, None], CHAIN, 1)
        for row in np.flatnonzero(rng.random(len(grid)) < 0.3):  # pieces of other chains
            at = int(rng.integers(4, 24))
            while at < CHAIN:
                size, other = int(rng.integers(4, 24)), int(rng.integers(len(grid)))
                spliced[row, at : at + size] = grid[other, at : at + size]
                spliced_of[row, at : at + size] = of[other]
                at += size + int(rng.integers(4, 24))
        words = list(vocabulary)
        flat, sizes = self.features.rows(words)
        flat[np.repeat([not has_letter(w) for w in words], sizes)] = 0
        first_of = np.cumsum(sizes) - sizes
        k = len(self.labels)
        w = np.zeros((self.features.size, k))
        first, second = np.zeros_like(w), np.zeros_like(w)
        m1, m2 = np.zeros((k, k)), np.zeros((k, k))
        turn = 0
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(grid)), max(1, len(grid) // 128)):
                turn += 1
                ids, gold = spliced[some], spliced_of[some]
                real = ids >= 0
                here = np.where(real, ids, 0).ravel()
                count = sizes[here]
                starts = np.cumsum(count) - count
                feats = flat[np.repeat(first_of[here] - starts, count) + np.arange(int(count.sum()))]
                feats[np.repeat(~real.ravel(), count)] = 0
                scores = np.add.reduceat(w[feats], starts).reshape(*ids.shape, k)
                probs, pairs, want = self._expect(scores, gold, real)
                error = probs - np.eye(k)[gold] * real[..., None]
                grad = np.zeros_like(w)
                err = error.reshape(-1, k)
                for j in range(k):
                    grad[:, j] = np.bincount(feats, np.repeat(err[:, j], count), minlength=len(w))
                grad = grad / len(some) + decay * w
                grad[0] = 0
                move = (pairs - want) / len(some) + decay * self.moves
                first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
                m1, m2 = 0.9 * m1 + 0.1 * move, 0.99 * m2 + 0.01 * move**2
                c1, c2 = 1 - 0.9**turn, 1 - 0.99**turn
                w -= rate * (first / c1) / (np.sqrt(second / c2) + 1e-6)
                self.moves -= rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-6)
        self.weights = w.astype(np.float32)

    def _expect(self, scores: np.ndarray, gold: np.ndarray, real: np.ndarray):
        """Expected labels, expected and observed label pairs of a batch of chains."""
        n, size, k = scores.shape
        step = np.exp(self.moves)
        x = np.exp(scores - scores.max(2, keepdims=True))
        alpha, beta = np.empty((n, size, k)), np.ones((n, size, k))
        a = np.ones((n, k))
        for t in range(size):
            a = (a @ step) * x[:, t]
            a /= a.sum(1, keepdims=True)
            alpha[:, t] = a
        pairs, want = np.zeros((k, k)), np.zeros((k, k))
        for t in range(size - 2, -1, -1):
            ahead = beta[:, t + 1] * x[:, t + 1] * real[:, t + 1, None] + ~real[:, t + 1, None]
            back = ahead @ step.T
            both = alpha[:, t, :, None] * step * ahead[:, None, :]
            both *= (real[:, t + 1] / both.sum((1, 2)))[:, None, None]
            pairs += both.sum(0)
            keep = real[:, t + 1, None]
            beta[:, t] = np.where(keep, back / back.max(1, keepdims=True), 1.0)
            np.add.at(want, (gold[:, t][real[:, t + 1]], gold[:, t + 1][real[:, t + 1]]), 1)
        probs = alpha * beta
        return probs / probs.sum(2, keepdims=True) * real[..., None], pairs, want


def train(
    df: DataFrame,
    text: str = "text",
    label: str = "lang",
    per_label: int = 300,
    lexicon_size: int = 4000,
    epochs: int = 4,
    seed: int = 5,
) -> Crf | None:
    """Fit on about ``per_label`` documents of each label (a bounded, hashed sample; documented bound).

    Rows without text or label are left out. None if nothing is left.
    """
    rows = df.filter(F.col(text).isNotNull() & F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(text), F.lit(seed)), F.lit(1 << 30)).cast("double") / (1 << 30)
    rates = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n)))])
    sample = rows.select(F.col(text).alias("t"), F.col(label).alias("l"), draw.alias("u"), rates[F.col(label)].alias("r"))
    sample = sample.filter("u < r").orderBy("u", "l", "t").limit(2 * per_label * len(counts)).collect()
    labels = sorted(counts)
    docs = [(words_of(r.t), labels.index(r.l)) for r in sample]
    common = Counter(w for words, _ in docs for w in words if has_letter(w))
    model = Crf(labels, [w for w, n in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size] if n > 1])
    model.fit(docs, epochs, 0.05, 1e-4, seed)
    del sample, docs, common
    give_back()
    return model


class Labeller:
    """Applies a model to batches; remembers the emissions of a bounded number of words."""

    def __init__(self, model: Crf, most: int = 250_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.labels)), np.float32)
        self.letters = np.zeros(1024, bool)

    def marginals(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        here = set().union(*docs)
        new = list(here - self.known.keys())
        if len(self.known) + len(new) > self.most:
            self._clear()
            new = list(here)
        start, need = len(self.known), len(self.known) + len(new)
        if need > len(self.table):
            more = 2 * need - len(self.table)
            self.table = np.pad(self.table, ((0, more), (0, 0)))
            self.letters = np.pad(self.letters, (0, more))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            at = slice(start + i, start + i + len(part))
            self.table[at] = self.model.emissions(part)
            self.letters[at] = [has_letter(w) for w in part]
        self.known.update(zip(new, range(start, need)))
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        ids = np.fromiter((i for d in docs for i in map(self.known.__getitem__, d)), np.int64, int(sizes.sum()))
        return self.model.marginals(self.table[ids], sizes), self.letters[ids]


def label_runs(marginals: np.ndarray, labels: list[str]) -> list[dict]:
    """Runs of words with the same likeliest label."""
    best = marginals.argmax(1)
    cuts = np.flatnonzero(np.diff(best)) + 1
    return [
        {"start": int(a), "end": int(b), "lang": labels[best[a]]}
        for a, b in zip([0, *cuts], [*cuts, len(best)])
        if b > a
    ]


def identify(
    df: DataFrame, model: Crf | None, text: str = "text", carry: list[str] | None = None, spans: bool = False
) -> DataFrame:
    """The rows of ``df`` with ``lang_pred, score`` and, on request, ``lang_spans`` (word ranges).

    ``score`` is the mean marginal of the predicted language over the words
    with letters. Null texts and texts without letters give ``und`` and 0; so
    does a missing model. Equal texts give equal results; an empty table gives
    no rows. Columns named like a result are replaced.
    """
    results = ("lang_pred", "score", "lang_spans")
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in results]
    inner = [f"c{i}" for i in range(len(carry))]
    carried = text in carry  # then the text goes to the workers once
    body = inner[carry.index(text)] if carried else "_body"
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(carry, inner)], *[F.col(text).alias(body)] * (not carried))
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = pickle.loads(shared.value)
        labeller = crf and Labeller(crf)
        for whole in batches:
            for start, n in parts_by_bytes(whole.column(body), PIECE):
                part = whole.slice(start, n)
                docs = [words_of(t) for t in part.column(body).to_pylist()]
                preds, scores, runs = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
                if labeller:
                    probs, letters = labeller.marginals(docs)
                    ends = np.cumsum([len(d) for d in docs])
                    doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))
                    total = np.bincount(doc, letters, minlength=n)
                    sums = np.stack([np.bincount(doc, probs[:, j] * letters, minlength=n) for j in range(len(crf.labels))], 1)
                    mean = sums / np.maximum(total, 1)[:, None]
                    for i in np.flatnonzero(total > 0).tolist():
                        best = int(mean[i].argmax())
                        preds[i], scores[i] = crf.labels[best], min(1.0, float(mean[i, best]))
                        if spans:
                            runs[i] = label_runs(probs[ends[i] - len(docs[i]) : ends[i]], crf.labels)
                columns = {c: part.column(c) for c in inner}
                columns |= {"_pred": pa.array(preds, pa.string()), "_score": pa.array(scores, pa.float64())}
                if spans:
                    columns["_runs"] = pa.array(runs, pa.list_(span))
                yield pa.RecordBatch.from_pydict(columns)

    more = "_pred string, _score double" + ", _runs array<struct<start:bigint,end:bigint,lang:string>>" * spans
    fields = T.StructType([rows.schema[c] for c in inner] + list(T._parse_datatype_string(more).fields))
    out = rows.mapInArrow(lean(run), fields)
    named = [("_pred", "lang_pred"), ("_score", "score")] + [("_runs", "lang_spans")] * spans
    return out.select(*[F.col(a).alias(c) for c, a in [*zip(carry, inner)]], *[F.col(a).alias(c) for a, c in named])


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out of training."""
    return crc32_mod(doc_id, 3)


def keep_known(df: DataFrame, model: Crf | None, text: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of ``df`` whose language is known with a score of at least ``least``.

    Others go: null and empty texts, texts without letters, and texts of so many
    languages that the first has a mean marginal below ``least``. Repeated rows
    share their fate; columns may have any name; an empty table stays empty.
    """
    rows = df.select(packed(df, (text.lower(),)).alias("_row"), F.col(text).alias("_text"))
    found = identify(rows, model, "_text", carry=["_row", "_text"])
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*[F.col("_text").alias(c) if c.lower() == text.lower() else F.col(f"_row.`{c}`") for c in df.columns])
