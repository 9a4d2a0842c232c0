"""Toxicity from a learned lexicon, misspelled terms and their context.

The lexicon holds whole words and word beginnings whose share of toxic documents is
significantly higher, from counts over all labelled rows. It is a trie;
words are read by the product of that trie and a Levenshtein automaton (each state
is a set of trie nodes with the errors made on the way), made deterministic one
transition at a time as words ask for it, so most words are refused after a few
letters. Every term and number of errors has a weight of its own, counted over all
labelled rows, so misspellings that are ordinary words weigh nothing.

The words around a hit, and whether it stands between quotation marks, decide by
learned weights whether the hit counts as abuse or as quotation. A logistic
regression on a few sums over a document's hits gives the score.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, materialize, materialize_at
from .common import crc32_mod, lean
from .decontaminate import parts_by_bytes

#: Words may hold signs that stand for letters, but not at their ends.
WORD, ENDS = re.compile(r"[\w@$*]+"), "@$*_"
#: Letters of a stem at least and at most, and of a whole word that can be a term.
STEMS, LONGEST = (3, 8), 24
#: Bytes of text at a time, tokens and transitions that a worker remembers, counts before a task hands them on.
PIECE, WORDS, MOVES, COUNTS = 1 << 20, 400_000, 200_000, 200_000
#: Letters of a remembered dead beginning; characters of a text after which all is forgotten.
HEAD, LONG = 5, 1 << 20
#: Words on each side of a hit (the next ones also as <word and >word), and the mark of a hit between quotation marks.
AROUND, QUOTED = 5, '"'
MARKS = "\"'`«»‘’‚“”„‹›"
#: Logarithm of odds that a match must have to count; a document is toxic from this score on.
LEAST, LEVEL = 0.5, 0.3


def words_in(text: str) -> set[str]:
    """The distinct words of a text in lower case."""
    return {w.strip(ENDS).lower() for w in set(WORD.findall(" ".join(set(text.split()))))} - {""}


def forms_of(words: set[str]) -> set[str]:
    """What can be a term: the words, marked by a final space, and their beginnings."""
    least, most = STEMS
    out = {w + " " for w in words if len(w) <= LONGEST}
    for k in range(least, most + 1):
        out.update([w[:k] for w in words if len(w) >= k])
    return out


def errors_allowed(term: str) -> int:
    n = len(term.rstrip(" "))
    return 0 if n < 5 else 1 if n < 9 else 2


class Matcher:
    """Finds the term of a word with the fewest errors (then the longest, then the first)."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.term, self.slack = [-1], [0]
        for i, term in enumerate(terms):
            node, errors = 0, errors_allowed(term)
            self.slack[0] = max(self.slack[0], errors)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                    self.slack.append(0)
                node = self.next[node][c]
                self.slack[node] = max(self.slack[node], errors)
            self.term[node] = i
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first. State 0 is dead: nothing can follow."""
        self.states: list[tuple] = [((), None), self._settled({0: 0}, None)]
        self.number = {s: i for i, s in enumerate(self.states)}
        self.letters: list[frozenset] = [frozenset()] * 2
        self.letters[1] = self._letters(1)
        self.moves: dict[tuple[int, str], int] = {}

    def _letters(self, state: int) -> frozenset:
        """The letters that lead on from a state without an error; all others do the same."""
        return frozenset(c for node, _ in self.states[state][0] for c in self.next[node])

    def _settled(self, nodes: dict[int, int], stem: tuple | None) -> tuple:
        """A state after letters of terms may have been left out; ``stem`` is the best beginning read so far."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            for c, child in self.next[node].items():
                if c != " " and e <= self.slack[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        for node, e in nodes.items():
            i = self.term[node]
            if i >= 0 and e <= errors_allowed(self.terms[i]):
                offer = (e, -len(self.terms[i]), i)
                stem = offer if stem is None else min(stem, offer)
        return tuple(sorted(nodes.items())), stem

    def _move(self, state: int, letter: str) -> int:
        nodes, stem = self.states[state]
        after: dict[int, int] = {}
        for node, e in nodes:
            for c, child in self.next[node].items():
                if c == " ":
                    continue
                cost = e + (c != letter)
                if cost <= self.slack[child] and cost < after.get(child, 99):
                    after[child] = cost
            if e + 1 <= self.slack[node] and e + 1 < after.get(node, 99):
                after[node] = e + 1
        found = self._settled(after, stem)
        if found not in self.number:
            self.number[found] = len(self.states)
            self.states.append(found)
            self.letters.append(self._letters(len(self.states) - 1))
        return self.number[found]

    def refuses(self, start: str) -> bool:
        """Whether no word with this beginning can match."""
        state = 1
        for c in start:
            key = (state, c if c in self.letters[state] else "")
            if key not in self.moves:
                self.moves[key] = self._move(state, c)
            state = self.moves[key]
        return not self.states[state][0] and self.states[state][1] is None

    def match(self, word: str) -> tuple[int, int] | None:
        """Number of the term and errors, None if no term is near enough."""
        if len(self.moves) > MOVES:
            self.clear()
        state, moves, letters = 1, self.moves, self.letters
        for c in word:
            key = (state, c if c in letters[state] else "")
            if key not in moves:
                moves[key] = self._move(state, c)
            state = moves[key]
            if not self.states[state][0]:
                break
        nodes, best = self.states[state]
        for node, e in nodes:
            end = self.next[node].get(" ")
            if end is not None and e <= errors_allowed(self.terms[self.term[end]]):
                offer = (e, -len(self.terms[self.term[end]]), self.term[end])
                best = offer if best is None else min(best, offer)
        return best and (best[2], best[0])


@dataclass
class Hit:
    start: int
    end: int
    term: int
    errors: int
    around: list[str]


@dataclass
class Model:
    """``terms`` and their ``weights`` by errors, ``context`` weights, and the regression; ``share``: of toxic rows."""

    terms: list[str] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)
    context: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    beta: np.ndarray | None = None
    share: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), self.share)
        z = np.clip((x - self.mean) / self.scale @ self.beta[1:] + self.beta[0], -30, 30)
        return 1 / (1 + np.exp(-z))


class Reader:
    """Finds hits in texts; remembers bounded numbers of tokens (runs without white space), words and dead beginnings."""

    def __init__(self, model: Model):
        self.model, self.matcher = model, Matcher(model.terms)
        self._clear()

    def _clear(self) -> None:
        self.seen: set[str] = set()
        self.hot: dict[str, list[tuple]] = {}
        self.words: dict[str, tuple | None] = {}
        self.dead: set[str] = set()

    def _match(self, word: str) -> tuple[int, int] | None:
        start = word[:HEAD]
        if start in self.dead:
            return None
        core = word.strip(ENDS)
        found = self.matcher.match(core.lower())
        if not found:
            # a sigma is another letter at the end of a word
            if start[0] not in ENDS and "\u03a3" not in start and self.matcher.refuses(start.lower()):
                self.dead.add(start)
            return None
        return found if not self.model.weights or self.model.weights[found[0]][found[1]] > 0 else None

    def _learn(self, tokens: set[str]) -> dict[str, list[tuple]]:
        """Those of new tokens with words that weigh anything: start, end, term and errors of each."""
        words = set(WORD.findall(" ".join(tokens)))
        for w in words.difference(self.words):
            self.words[w] = self._match(w)
        hits = {w for w in words if self.words[w]}
        out: dict[str, list[tuple]] = {}
        for token in tokens if hits else ():
            for m in WORD.finditer(token):
                w = m.group()
                if w in hits:
                    at = m.start() + len(w) - len(w.lstrip(ENDS))
                    out.setdefault(token, []).append((at, at + len(w.strip(ENDS)), *self.words[w]))
        return out

    def hits(self, text: str, places: bool = False) -> tuple[list[Hit], int]:
        """The hits of a text that weigh anything (``places``: with their code points), and the number of its tokens."""
        if not self.model.terms or not text:
            return [], 0
        tokens = text.split()
        kinds = set(tokens)
        if len(self.seen) + len(kinds) > WORDS:
            self._clear()
        new = kinds.difference(self.seen)
        self.hot |= self._learn(new)
        self.seen |= new
        hot = {t: self.hot[t] for t in kinds.intersection(self.hot)} if len(kinds) < len(self.hot) else {t: f for t, f in self.hot.items() if t in kinds}
        if not hot:
            return [], len(tokens)
        starts = [m.start() for m in re.finditer(r"\S+", text)] if places else None
        out = []
        for i in [i for i, t in enumerate(tokens) if t in hot]:
            token = tokens[i]
            for start, end, term, errors in hot[token]:
                if errors and not self.model.weights:  # contexts are learned from exact hits
                    out.append(Hit(start, end, term, errors, []))
                    continue
                ahead = " ".join([*tokens[max(0, i - AROUND) : i], token[:start]])
                behind = " ".join([token[end:], *tokens[i + 1 : i + 1 + AROUND]])
                near = [[w.strip(ENDS).lower() for w in WORD.findall(part)] for part in (ahead, behind)]
                around = {*near[0], *near[1], *[f"<{w}" for w in near[0][-1:]], *[f">{w}" for w in near[1][:1]]} - {"", "<", ">"}
                if any(c in ahead for c in MARKS) and any(c in behind for c in MARKS):
                    around.add(QUOTED)
                at = starts[i] if places else 0
                out.append(Hit(at + start, at + end, term, errors, sorted(around)))
        if len(text) > LONG:
            self._clear()
        return out, len(tokens)

    def leaning(self, hit: Hit) -> float:
        """Above 0 the words around speak for abuse, below 0 for quotation."""
        return max(-4.0, min(4.0, sum(self.model.context.get(w, 0.0) for w in hit.around)))

    def features(self, text: str, places: bool = False) -> tuple[list[float], list[Hit]]:
        hits, n = self.hits(text, places)
        if not hits:
            return [0.0] * 7 + [math.log1p(n)], hits
        weights = [self.model.weights[h.term][h.errors] for h in hits]
        lean_ = [self.leaning(h) for h in hits]
        abuse = sum(w / (1 + math.exp(-x)) for w, x in zip(weights, lean_))
        quoted = sum(w / (1 + math.exp(x)) for w, x in zip(weights, lean_))
        kinds = len({h.term for h in hits})
        dense = math.log1p(100 * len(hits) / n)
        return [math.log1p(abuse), math.log1p(quoted), max(weights), max(lean_), math.log1p(len(hits)), dense, math.log1p(kinds), math.log1p(n)], hits


def log_odds(pos: float, neg: float, toxic: int, clean: int) -> tuple[float, float]:
    """The logarithm of the odds ratio (half a row added to each cell), and it over its standard error."""
    a, b, c, d = pos + 0.5, toxic - pos + 0.5, neg + 0.5, clean - neg + 0.5
    value = math.log(a / b) - math.log(c / d)
    return value, value / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def _log_odds(toxic: int, clean: int) -> tuple[Column, Column]:
    a, b = F.col("pos") + 0.5, toxic - F.col("pos") + 0.5
    c, d = F.col("neg") + 0.5, clean - F.col("neg") + 0.5
    value = F.log(a / b) - F.log(c / d)
    return value, value / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def _counts(rows: DataFrame, keys_of) -> DataFrame:
    """``key, pos, neg``: in how many toxic and other rows of ``t, y`` each key of ``keys_of()(text)`` is.

    Tasks add up to ``COUNTS`` keys before they hand them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = keys_of(), (Counter(), Counter())

        def pack():
            every = list(counts[0].keys() | counts[1].keys())
            out = {"key": pa.array(every, pa.string())}
            for name, i in (("pos", 1), ("neg", 0)):
                out[name] = pa.array([counts[i][k] for k in every], pa.int64())
                counts[i].clear()
            return pa.RecordBatch.from_pydict(out)

        for whole in batches:
            for start, n in parts_by_bytes(whole.column("t"), PIECE):
                part = whole.slice(start, n)
                for text, y in zip(part.column("t").to_pylist(), part.column("y").to_pylist()):
                    counts[y].update(keys(text))
                    if len(counts[0]) + len(counts[1]) > COUNTS:
                        yield pack()
        yield pack()

    return rows.mapInArrow(lean(run), "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_terms(rows: list[tuple[str, int]], most: int, part: float = 0.6) -> list[str]:
    """The terms, from what can be a term and its number of toxic rows, best first.

    A beginning stands for its longest continuation that holds ``part`` of its toxic rows, since
    misspellings reach that one anyway; what begins with a term chosen before is left out.
    """
    chosen: dict[str, None] = {}
    pos = dict(rows)
    longer: dict[str, list[str]] = {}
    for key in pos:
        for k in range(STEMS[0], len(key)):
            longer.setdefault(key[:k], []).append(key)
    for begun, n in rows:
        if len(chosen) == most:
            break
        key = max([begun, *(k for k in longer.get(begun, ()) if pos[k] >= part * n)], key=lambda k: (len(k), pos[k], k))
        if not any(key[:k] in chosen for k in range(STEMS[0], len(key))):
            chosen[key] = None
    return list(chosen)


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised columns."""
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta, keep = np.zeros(z.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * w[:, None]).T @ z + keep, z.T @ (y - p) - keep @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
    terms: int = 1000, contexts: int = 1000, sample: int = 20_000, share: float = 0.002,
) -> Model:
    """The model of all rows of ``docs`` with a label; pass only rows that may be learned from.

    Lexicon, weights and contexts are counted over all of them. A term is in ``share`` of the toxic
    rows at least; the lexicon has at most ``terms`` terms (of at most 50 times as many candidates) and
    ``contexts`` context words, which bounds what is broadcast, and the regression is fitted on
    about ``sample`` labelled rows at most, chosen by hash (documented bounds).
    A document with several labels is toxic if one says so; null labels and ids do not count, a null
    text is empty. Without rows of both kinds every score is the share of toxic rows, 0 without rows.
    """
    y = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows, path = materialize_at(texts.join(y.hint("merge"), "_id").select("_id", "t", "y"), "labelled-texts")
    shares = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = shares.get(1, 0), shares.get(0, 0)
    model = Model(share=toxic / max(1, toxic + clean))
    if not toxic or not clean:
        return model
    several = _counts(rows.filter("y = 1"), lambda: lambda t: forms_of(words_in(t))).filter(F.col("pos") >= max(3, toxic * share))
    common = {r.key: r.pos for r in several.orderBy(F.desc("pos"), F.desc(F.length("key")), "key").limit(50 * terms).collect()}
    least = docs.sparkSession.sparkContext.broadcast(frozenset(common))
    seen = _counts(rows.filter("y = 0"), lambda: lambda t: forms_of(words_in(t)) & least.value)
    clear = dict.fromkeys(common, 0) | {r.key: r.neg for r in seen.collect()}
    odds = {k: log_odds(common[k], clear[k], toxic, clean) for k in common}
    best = sorted((k for k, (value, z) in odds.items() if value >= 1 and z >= 4.5), key=lambda k: (-round(odds[k][1], 9), -len(k), k))
    model.terms = choose_terms([(k, common[k]) for k in best], terms)

    def keys(t: str, reader: Reader):
        hits = reader.hits(t)[0]
        sure = [h for h in hits if not h.errors]
        return {*(f"{h.term} {h.errors}" for h in hits), *(f"\t{w}" for h in sure for w in h.around), *["\t"] * bool(sure)}

    met = materialize(_counts(rows, _with(model, keys)), "toxic-hits")
    found = {tuple(map(int, r.key.split())): (r.pos, r.neg) for r in met.filter(~F.col("key").startswith("\t")).collect()}
    for i in range(len(model.terms)):
        exact = log_odds(*found.get((i, 0), (0, 0)), toxic, clean)[0]
        line = [exact]
        for e in (1, 2):
            pos, neg = found.get((i, e), (0, 0))
            line.append(log_odds(pos, neg, toxic, clean)[0] if pos + neg >= 3 else exact / 2)
        model.weights.append([w if w >= LEAST else 0.0 for w in line])
    every = met.filter(F.col("key") == "\t").first()
    if every is not None:
        value, z = _log_odds(every.pos, every.neg)
        some = met.filter(F.col("key").startswith("\t") & (F.col("key") != "\t") & (F.abs(z) >= 3)).orderBy(F.desc(F.abs(z)), "key").limit(contexts)
        model.context = {r.key[1:]: log_odds(r.pos, r.neg, every.pos, every.neg)[0] for r in some.collect()}
    drawn = rows.filter(F.pmod(F.xxhash64("_id", "t"), F.lit(1 << 30)) < int(min(1.0, sample / (toxic + clean)) * (1 << 30)))
    fitted = _read(drawn.select("t", "y"), model, ["y"], "t", False).select("x", "y").collect()
    x, y = np.array([r.x for r in fitted]), np.array([r.y for r in fitted], float)
    if 0 < y.sum() < len(y):
        model.mean, model.scale, model.beta = _fit(x, y)
    discard(docs.sparkSession, path)
    return model


def _with(model: Model, keys):
    """A maker of key functions with a reader of their own."""

    def make():
        reader = Reader(model)
        return lambda text: keys(text, reader)

    return make


SPAN = "array<struct<start:long,end:long,term:string,errors:int,quoted:boolean>>"


def _read(df: DataFrame, model: Model, inner: list[str], body: str, spans: bool) -> DataFrame:
    """``inner`` columns with features ``x``, score ``p`` and spans ``s`` of the texts in ``body``."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("errors", pa.int32()), ("quoted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(pickle.loads(shared.value))
        for whole in batches:
            for start, n in parts_by_bytes(whole.column(body), PIECE):
                part = whole.slice(start, n)
                found = [reader.features(t or "", spans) for t in part.column(body).to_pylist()]
                x = np.array([f for f, _ in found]).reshape(-1, 8)
                columns = {c: part.column(c) for c in inner}
                columns["x"] = pa.array(x.tolist(), pa.list_(pa.float64()))
                columns["p"] = pa.array(reader.model.probability(x), pa.float64())
                if spans:
                    terms = reader.model.terms
                    rows = [
                        [{"start": h.start, "end": h.end, "term": terms[h.term].strip(), "errors": h.errors, "quoted": reader.leaning(h) < 0} for h in hits]
                        for _, hits in found
                    ]
                    columns["s"] = pa.array(rows, pa.list_(span))
                yield pa.RecordBatch.from_pydict(columns)

    more = "x array<double>, p double" + f", s {SPAN}" * spans
    fields = T.StructType([df.schema[c] for c in inner] + list(T._parse_datatype_string(more).fields))
    return df.mapInArrow(lean(run), fields)


def score_toxicity(
    df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, spans: bool = False, level: float = LEVEL
) -> DataFrame:
    """The rows of ``df`` with ``score`` (0 to 1), ``predicted`` (1 from ``level`` on) and, on request, ``toxic_spans``.

    Only the text decides, so equal texts score alike. Null and empty texts score like a text
    without hits. Spans are code points of the hits that weigh anything, ``quoted`` where the
    context speaks for quotation. An empty table gives no rows. Columns named like a result are replaced.
    """
    results = ("score", "predicted", "toxic_spans")
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in results]
    inner = [f"c{i}" for i in range(len(carry))]
    carried = text in carry
    body = inner[carry.index(text)] if carried else "_body"
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(carry, inner)], *[F.col(f"`{text}`").alias(body)] * (not carried))
    out = _read(rows, model, inner, body, spans)
    found = [F.col("p").alias("score"), (F.col("p") >= level).cast("int").alias("predicted")] + [F.col("s").alias("toxic_spans")] * spans
    return out.select(*[F.col(a).alias(c) for c, a in zip(carry, inner)], *found)


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 4; rows with 2 are held out of training."""
    return crc32_mod(doc_id, 4)
