"""Log-bilinear language model with noise-contrastive estimation, in numpy.

Words are counted over all training documents. The ``classes`` commonest words
and the end mark are predicted one by one, all other words as one class and
within it by their smoothed counts, so that every text gets a normalised
probability. The log-bilinear model sums the two previous classes' vectors, each
scaled per dimension and place, and scores the next class by inner product and
bias. It is trained against ``noise`` samples of the unigram distribution; the
normalisers of all pairs of previous classes come from one matrix product of
exponentials, after which a token costs one inner product and two look-ups.

All training tokens train the network: shards are fitted on executors and averaged
after every epoch, and large inputs are dealt to the epochs, so each token is seen once. The classes
grow too, within a bound since the normalisers take their square.

Counts of the ``listed`` commonest words are broadcast (a fixed bound); other
words of a document are joined with the count table by shuffle.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import crc32_mod, lean, lower_words
from .decontaminate import parts_by_bytes

PIECE = 3 << 20
#: Networks that a task adds up; tokens of a shard; most classes (the table of normalisers is their square).
MEANS, SHARD, MOST_CLASSES = 16, 1 << 20, 5_000


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 7; rows with 2 are held out of training."""
    return crc32_mod(doc_id, 7)


def count_words(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """``w`` (bytes), ``c``: occurrences of each word, counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for whole in batches:
            for start, n in parts_by_bytes(whole.column("body"), PIECE):
                for text in whole.slice(start, n).column("body").to_pylist():
                    held.update(lower_words(text))
                if len(held) > most:
                    yield pack(held)
                    held.clear()
        yield pack(held)

    def pack(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"w": pa.array(list(held), pa.binary()), "c": pa.array(list(held.values()), pa.int64())})

    return rows.select("body").mapInArrow(lean(run), "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, ascending, and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


class LogBilinear:
    """Vectors of context and target classes; the last class is the end mark. Fitted in single precision, normalised in double."""

    def __init__(self, unigram: np.ndarray, size: int, seed: int):
        rng = np.random.default_rng(seed)
        k = len(unigram)
        self.noise = unigram / unigram.sum()
        self.context = rng.normal(0, 0.1, (k, size)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (k, size)).astype(np.float32)
        self.scale = np.ones((2, size), np.float32)
        self.bias = np.log(self.noise).astype(np.float32)
        self.memory = [np.full_like(p, 1e-6) for p in self.parameters()]
        self.rng = rng

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.target, self.scale, self.bias]

    def state(self) -> np.ndarray:
        """Parameters and the memory of their steps, as one row."""
        return np.concatenate([p.ravel() for p in self.parameters() + self.memory])

    def load(self, state: np.ndarray) -> None:
        at = 0
        for p in self.parameters() + self.memory:
            p[...] = state[at : at + p.size].reshape(p.shape)
            at += p.size

    def fit(self, examples: np.ndarray, noise: int, epochs: int, rate: float, batch: int = 1024) -> None:
        """examples: rows (second last class, last class, class).

        The ``noise`` samples of a batch serve all its examples, so their scores
        and gradients are matrix products.
        """
        draws = np.cumsum(self.noise)
        log_noise = np.log(noise * self.noise).astype(np.float32)
        for _ in range(epochs):
            order = self.rng.permutation(len(examples))
            for start in range(0, len(order), batch):
                two, one, gold = examples[order[start : start + batch]].T
                n = len(gold)
                other = np.searchsorted(draws, self.rng.random(noise)).clip(0, len(draws) - 1)
                far, near = self.context[two], self.context[one]
                ahead = far * self.scale[0] + near * self.scale[1]
                own, against = self.target[gold], self.target[other]
                right = np.einsum("nd,nd->n", ahead, own) + self.bias[gold] - log_noise[gold]
                wrong = ahead @ against.T + (self.bias[other] - log_noise[other])
                right = (1 / (1 + np.exp(-right.clip(-30, 30))) - 1) / n
                wrong = 1 / (1 + np.exp(-wrong.clip(-30, 30))) / n
                back = right[:, None] * own + wrong @ against
                steps = (
                    (self.context, [two, one], [back * self.scale[0], back * self.scale[1]]),
                    (self.target, [gold, other], [right[:, None] * ahead, wrong.T @ ahead]),
                    (self.bias, [gold, other], [right, wrong.sum(0)]),
                    (self.scale, [np.arange(2)], [np.stack([(back * far).sum(0), (back * near).sum(0)])]),
                )
                for (p, at, grads), m in zip(steps, (self.memory[0], self.memory[1], self.memory[3], self.memory[2])):
                    rows, g = summed(np.concatenate(at), np.concatenate(grads))
                    m[rows] += g * g
                    p[rows] -= rate * g / np.sqrt(m[rows])

    def vectors(self) -> tuple[np.ndarray, ...]:
        """For log10 scores: vectors of second last, last and next classes, biases; log10 normalisers by (second last, last)."""
        ten = np.log(10)
        far, near = (self.context.astype(float) * s for s in self.scale)
        left, right = far @ self.target.T, near @ self.target.T + self.bias
        top_left, top_right = left.max(1, keepdims=True), right.max(1, keepdims=True)
        np.exp(left - top_left, out=left)
        np.exp(right - top_right, out=right)
        norm = np.empty((len(left), len(left)), np.float32)
        for at in range(0, len(left), 256):
            norm[at : at + 256] = (np.log(left[at : at + 256] @ right.T) + top_left[at : at + 256] + top_right.T) / ten
        return *((x / ten).astype(np.float32) for x in (far, near)), self.target.astype(np.float32), (self.bias / ten).astype(np.float32), norm


def class_codes(ids: np.ndarray, sizes: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(second last, last, class) of every token and the token's document; ids: word ranks, -1 unlisted."""
    n = len(sizes)
    code = np.where((ids >= 0) & (ids < classes), ids + 1, 0)
    ends = np.cumsum(sizes + 1)
    tokens = np.full(int(ends[-1]) if n else 0, classes + 1, np.int64)
    inside = np.ones(len(tokens), bool)
    inside[ends - 1] = False
    tokens[inside] = code
    doc = np.repeat(np.arange(n), sizes + 1)
    place = np.arange(len(tokens)) - np.repeat(ends - sizes - 1, sizes + 1)
    before = np.concatenate([[classes + 1], tokens[:-1]]) if len(tokens) else tokens
    before2 = np.concatenate([[classes + 1] * 2, tokens[:-2]])[: len(tokens)] if len(tokens) else tokens
    last = np.where(place >= 1, before, classes + 1)
    second = np.where(place >= 2, before2, classes + 1)
    return second, last, tokens, doc


class Model:
    """What scoring needs: listed words with counts, tables, totals."""

    def __init__(self, listed: list[tuple[bytes, int]], totals: dict[str, int], classes: int):
        self.classes = min(classes, len(listed))
        self.words = {w: i for i, (w, _) in enumerate(listed)}
        self.counts = np.array([c for _, c in listed], np.int64)
        self.totals = totals
        self.rest_tokens = totals["words"] - int(self.counts[: self.classes].sum())
        self.rest_types = totals["types"] - self.classes
        self.vectors: tuple | None = None

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """log10 scores by (second last, class) and (last, class), and log10 normalisers by (second last, last)."""
        if self.vectors is None:
            return None
        far, near, target, bias, norm = self.vectors
        return far @ target.T, near @ target.T + bias, norm

    def scores(self, second: np.ndarray, last: np.ndarray, tokens: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
        """log10 probability of the class of every token."""
        far, near, target, bias, norm = self.vectors
        out = np.empty(len(tokens))
        for at in range(0, len(tokens), piece):
            a, b, c = second[at : at + piece], last[at : at + piece], tokens[at : at + piece]
            out[at : at + piece] = np.einsum("nd,nd->n", far[a] + near[b], target[c]) + bias[c] - norm[a, b]
        return out

    def ids(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        get = self.words.get
        return np.fromiter((get(w, -1) for d in docs for w in d), np.int64, int(sizes.sum())), sizes


def deal_examples(rows: DataFrame, shared, shards: int) -> DataFrame:
    """``shard, drawn``: all tokens of all documents with their contexts, dealt to shards by hash; a row holds many of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for whole in batches:
            for start, n in parts_by_bytes(whole.column("body"), PIECE):
                texts = whole.slice(start, n).column("body").to_pylist()
                second, last, tokens, doc = class_codes(*model.ids([lower_words(t) for t in texts]), model.classes)
                if not len(tokens):
                    continue
                seeds = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
                place = (np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(np.uint64)
                draw = (seeds[doc] + place) * np.uint64(0x9E3779B97F4A7C15)
                draw = ((draw ^ (draw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11)
                shard = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                shard, drawn = shard[order], np.stack([second, last, tokens], 1)[order].astype("<u2")
                cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                parts = [drawn[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(drawn)])]
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard[cuts], pa.int64()), "drawn": pa.array(parts, pa.binary())})

    return rows.select("body").mapInArrow(lean(run), "shard long, drawn binary")


def fit_shards(examples: DataFrame, net: LogBilinear, shards: int, noise: int, epochs: int, rate: float, seed: int) -> None:
    """Every epoch its shards go on from the mean of the last epoch's, weighted by tokens, on an executor.

    Fewer shards than epochs all take part in each; more are dealt to the epochs, so that every token is seen once.

    Networks are added up on executors; the driver gets ``MEANS`` sums at most.
    """
    sc = examples.sparkSession.sparkContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            key = np.sort(np.concatenate(parts).astype(np.int64) @ np.array([1 << 32, 1 << 16, 1]))
            drawn = np.stack([key >> 32, (key >> 16) & 0xFFFF, key & 0xFFFF], 1).astype("<u2")
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "drawn": pa.array([drawn.tobytes()], pa.binary())})

        now, held = None, []
        for batch in batches:
            for shard, body in zip(batch.column("shard").to_pylist(), batch.column("drawn")):
                if held and now != shard:
                    yield row(now, held)
                    held = []
                now = shard
                held.append(np.frombuffer(body.as_py(), "<u2").reshape(-1, 3))
        if held:
            yield row(now, held)

    # a row a shard, its tokens ordered so that the fit does not depend on how tasks are dealt
    dealt = examples.repartition(min(shards, 4096), "shard").sortWithinPartitions("shard")
    dealt = materialize(dealt.mapInArrow(lean(pack), "shard long, drawn binary"), "lm-examples")
    for epoch in range(epochs):
        shared = sc.broadcast(pickle.dumps((net.noise, net.context.shape[1], net.state())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            noises, size, state = pickle.loads(shared.value)

            for batch in batches:
                for shard, body in zip(batch.column("shard").to_pylist(), batch.column("drawn")):
                    drawn = np.frombuffer(body.as_buffer(), "<u2").reshape(-1, 3).astype(np.int64)
                    local = LogBilinear(noises, size, seed + shards * epoch + shard)
                    local.load(state)
                    local.fit(drawn, noise, 1, rate)
                    total = (len(drawn) * local.state()).astype(np.float32)
                    columns = {"g": pa.array([shard], pa.int64()), "n": pa.array([len(drawn)], pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns | {"sum": pa.array([total.tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, n, total = None, 0, None

            def pack() -> pa.RecordBatch:
                columns = {"g": pa.array([now], pa.int64()), "n": pa.array([n], pa.int64())}
                return pa.RecordBatch.from_pydict(columns | {"sum": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

            for batch in batches:
                for up, count, part in zip(*(batch.column(c) for c in ("up", "n", "sum"))):
                    if now is not None and up.as_py() != now:
                        yield pack()
                        now, n, total = None, 0, None
                    some = np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
                    now, n, total = up.as_py(), n + count.as_py(), some if total is None else total + some
            if now is not None:
                yield pack()

        turn = dealt if shards < epochs else dealt.filter(F.col("shard") % epochs == epoch)
        means, groups = turn.mapInArrow(lean(run), "g long, n long, sum binary"), shards
        while groups > MEANS:  # a tree, so that no task adds more than MEANS networks and the driver gets no more
            groups = -(-groups // MEANS)
            means = means.withColumn("up", F.floor(F.col("g") / MEANS))
            means = means.repartition(groups, "up").sortWithinPartitions("up", "g").mapInArrow(lean(add), "g long, n long, sum binary")
        found = sorted(means.collect(), key=lambda r: r.g)
        if found:
            net.load(sum(np.frombuffer(r["sum"], np.float32).astype(np.float64) for r in found) / sum(r.n for r in found))


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The commonest words, ``most`` at most, by falling count and then by word.

    Words fall into bands of an eighth of a doubling of their count. Only the top
    bands that are needed are ordered, on an executor: the driver sees one row a
    band and the words taken, never those of every task.
    """
    band = F.floor(F.log2(F.col("c").cast("double")) * 8 + 1e-9)
    least, taken = None, 0
    for row in sorted(counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.band):
        least, taken = row.band, taken + row.n
        if taken >= most:
            break
    if least is None or most < 1:
        return []
    found = counts.filter(band >= least).orderBy(F.desc("c"), "w").limit(most).select("w", "c").toArrow()
    return sorted(zip(found.column("w").to_pylist(), found.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))


def class_count(tokens: int, least: int) -> int:
    """Classes grow with the fourth root of the training tokens, ``least`` up to ten million, within ``MOST_CLASSES``."""
    return max(least, min(MOST_CLASSES, int(least * (tokens / 10_000_000) ** 0.25)))


def train(
    rows: DataFrame,
    classes: int = 1000,
    listed: int = 200_000,
    size: int = 32,
    examples: int | None = None,
    noise: int = 64,
    epochs: int = 3,
    rate: float = 0.1,
    seed: int = 11,
    shard: int = SHARD,
) -> tuple[Model, DataFrame]:
    """Counts cover all of ``rows`` (column body), and so does the network's training: ``examples`` bounds nothing any more.

    ``classes`` are those of up to ten million tokens.
    """
    counts = materialize(count_words(rows), "lm-counts")
    words, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    docs = rows.count()
    top = commonest(counts, listed)
    totals = {"words": words, "types": types, "docs": docs, "tokens": words + docs, "vocabulary": types + (docs > 0)}
    model = Model(top, totals, class_count(totals["tokens"], classes))
    sc = rows.sparkSession.sparkContext
    if docs:
        shared = sc.broadcast(pickle.dumps(model))
        totals["seen"] = totals["tokens"]
        shards = max(1, totals["seen"] // shard)
        unigram = np.concatenate([[max(1, model.rest_tokens)], model.counts[: model.classes], [docs]]).astype(float)
        net = LogBilinear(unigram, size, seed)
        fit_shards(deal_examples(rows, shared, shards), net, shards, noise, epochs, rate, seed)
        model.vectors = net.vectors()
    return model, counts


def score(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for ``id, body`` (log10)."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    totals = model.totals
    schema = "k long, id long, n long, known long, base double, net double, rest long, w array<binary>, f array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, number = pickle.loads(shared.value), TaskContext.get().partitionId() << 40
        logs = np.log10(lm.counts + 1.0)
        end_log = np.log10(totals["docs"] + 1.0)
        for whole in batches:
            for start, n in parts_by_bytes(whole.column("body"), PIECE):
                part = whole.slice(start, n)
                docs = [lower_words(t) for t in part.column("body").to_pylist()]
                ids, sizes = lm.ids(docs)
                doc = np.repeat(np.arange(n), sizes)
                there = ids >= 0
                plain = np.where(there, logs[np.maximum(ids, 0)] if len(logs) else 0.0, 0.0)
                base = np.bincount(doc, plain, minlength=n).astype(float) + end_log
                known = np.bincount(doc, there, minlength=n).astype(np.int64) + (totals["docs"] > 0)
                rest = np.bincount(doc, (ids < 0) | (ids >= lm.classes), minlength=n).astype(np.int64)
                net = np.bincount(doc, np.where(ids >= lm.classes, plain, 0.0), minlength=n).astype(float)
                if lm.vectors is not None:
                    second, last, tokens, of = class_codes(ids, sizes, lm.classes)
                    net += np.bincount(of, lm.scores(second, last, tokens), minlength=n)
                words, freqs, bounds = [], [], [0]
                at = 0
                for d in docs:
                    new = Counter([w for w, i in zip(d, ids[at : at + len(d)].tolist()) if i < 0])
                    at += len(d)
                    words += new.keys()
                    freqs += new.values()
                    bounds.append(len(words))
                offsets = pa.array(bounds, pa.int32())
                columns = {
                    "k": pa.array(np.arange(number, number + n), pa.int64()),
                    "id": part.column("id"),
                    "n": pa.array(sizes + 1, pa.int64()),
                    "known": pa.array(known, pa.int64()),
                    "base": pa.array(base, pa.float64()),
                    "net": pa.array(net, pa.float64()),
                    "rest": pa.array(rest, pa.int64()),
                    "w": pa.ListArray.from_arrays(offsets, pa.array(words, pa.binary())),
                    "f": pa.ListArray.from_arrays(offsets, pa.array(freqs, pa.int32())),
                }
                number += n
                yield pa.RecordBatch.from_pydict(columns)

    local = materialize(rows.mapInArrow(lean(run), schema), "lm-local")
    unlisted = local.select("k", F.explode(F.arrays_zip("w", "f")).alias("x")).select("k", F.col("x.w").alias("w"), F.col("x.f").alias("f"))
    met = unlisted.join(counts, "w").groupBy("k").agg(
        F.sum("f").alias("more"), F.sum(F.col("f") * F.log10(F.col("c") + 1.0)).alias("logs")
    )
    joined = local.drop("w", "f").join(met, "k", "left")
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    scale = float(np.log10(totals["tokens"] + totals["vocabulary"] + 1))
    rest_scale = float(np.log10(model.rest_tokens + model.rest_types + 1))
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + more).cast("long").alias("n_known"),
        (F.col("base") + logs - F.col("n") * scale).alias("base_score"),
        (F.col("net") + logs - F.col("rest") * rest_scale).alias("score"),
    )


def score_documents(
    df: DataFrame, training: DataFrame, text: str = "text", doc_id: str = "doc_id", **options
) -> tuple[DataFrame, Model]:
    """Score every text of ``df`` by a model of ``training``.

    Null and empty texts are one end mark. Without training rows all words are
    unknown and the scores are those of the smoothed counts alone. Equal texts
    give equal scores; repeated rows stay apart; an empty table gives no rows.
    """
    def plain(d):
        return d.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body"))

    model, counts = train(plain(training), **options)
    return score(plain(df), model, counts), model
