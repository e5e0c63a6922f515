"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Training reads a bounded sample of labelled documents (``Sample``), picked by the hash of their id.
Spark counts in how many toxic and other documents of the sample a word form (a word, or its first
four to six letters) occurs; forms that are typical of toxic documents label the tokens of those
documents.  A two-state chain with one weight per kept form is then fitted to a smaller part of the
sample by forward-backward gradients.

Scoring runs forward-backward over every whole text.  The marginals of the toxic state give the
offending offsets, and a logistic function of the largest and the summed marginal gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from journeyloom.llm.common import prepare_workers, table, tidy, word_codes
from journeyloom.llm.hmm_lm import Lockstep, remainder

_TRIM = ".,;:!?\"'()[]{}<>|*&%$#@~`_-+=/\\"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Sample:
    """Bounds of what training reads."""

    toxic: int = 3000
    other: int = 6000
    fit_each: int = 600  # of either kind, for the weights of the chain
    fit_chars: int = 20_000  # longer documents count for the forms, but do not fit the chain
    forms: int = 4000
    telling: float = 16.0  # least log-likelihood ratio of a form


def forms_of(word: str) -> list[str]:
    """The forms of a word: itself without punctuation around it, and its beginnings."""
    bare = word.strip(_TRIM).lower()
    return [bare, *[f"{bare[:k]}^" for k in (4, 5, 6) if len(bare) > k]] if bare else []


@dataclass
class Chain:
    """Weights of a two-state chain: state 1 is toxic, a token's score is that of state 1."""

    weights: dict[str, float]
    bias: float
    move: np.ndarray  # 2 x 2, logarithms
    start: np.ndarray
    document: np.ndarray  # weights of document_inputs

    def word_score(self, word: str) -> float:
        return self.bias + sum([self.weights.get(f, 0.0) for f in forms_of(word)])

    def score(self, largest: np.ndarray, summed: np.ndarray, evidence: np.ndarray, size: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(document_inputs(largest, summed, evidence, size) @ self.document)))


def document_inputs(largest: np.ndarray, summed: np.ndarray, evidence: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of the largest and the summed marginal, the summed positive form weights, and the number of tokens."""
    held = np.clip(largest, 1e-6, 1 - 1e-6)
    return np.stack(
        [np.ones_like(held), np.log(held / (1 - held)), np.log(summed + 1e-2), np.log1p(evidence), np.log(size), (evidence / size) ** 0.5], 1
    )


def marginals(lanes: Lockstep, scores: np.ndarray, start: np.ndarray, move: np.ndarray):
    """Forward-backward over tokens in ``lanes.flat`` order: P(toxic) per token, pair and start sums, log Z."""
    emit = np.stack([np.ones_like(scores), np.exp(np.clip(scores, -40, 40))], 1)
    go, ahead, scales, ones = np.exp(move), [], [], np.ones(2)
    log_z, state = 0.0, None
    for t in range(lanes.steps):
        n = lanes.running[t]
        state = (np.exp(start) if t == 0 else state[:n] @ go) * emit[lanes.starts[:n] + t]
        scale = state @ ones
        state = state / scale[:, None]
        log_z += np.log(scale).sum()
        ahead.append(state)
        scales.append(scale)
    toxic, pairs, back = np.empty(len(scores)), np.zeros((2, 2)), None
    for t in range(lanes.steps - 1, -1, -1):
        n = lanes.running[t]
        now = np.ones((n, 2))
        if t + 1 < lanes.steps:
            later = lanes.running[t + 1]
            seen = emit[lanes.starts[:later] + t + 1] * back / scales[t + 1][:, None]
            pairs += ahead[t][:later].T @ seen
            now[:later] = seen @ go.T
        back = now
        share = ahead[t] * back
        toxic[lanes.starts[:n] + t] = share[:, 1]
    return toxic, pairs * go, share.sum(0), log_z


def fit_chain(texts: list[str], toxic: list[int], odds: dict[str, float], steps: int = 60) -> Chain:
    """Maximum likelihood of the token labels under a small quadratic penalty, by Adam steps."""
    names = list(odds)
    place = {f: k for k, f in enumerate(names)}
    tokens = [_TOKEN.findall(t) or [""] for t in texts]
    lanes = Lockstep([np.zeros(len(t), np.int8) for t in tokens])
    at, form, label, k = [], [], [], 0
    strong = np.log(20)
    for words, bad in zip(tokens, toxic):
        for word in words:
            hit = [f for f in forms_of(word) if f in place]
            at += [k] * len(hit)
            form += [place[f] for f in hit]
            label.append(int(bool(bad) and any(odds[f] >= strong for f in hit)))
            k += 1
    at, form, label = np.array(at, np.int64), np.array(form, np.int64), np.array(label)
    first = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))[:-1]
    inner = np.setdiff1d(np.arange(1, k), first)
    seen_pairs = np.bincount(2 * label[inner - 1] + label[inner], minlength=4).reshape(2, 2)
    seen_start = np.bincount(label[first], minlength=2)
    seen_forms = np.bincount(form, label[at], len(names))
    x = np.concatenate((np.zeros(len(names)), [-3.0], np.zeros(6)))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        scores = np.bincount(at, x[form], k) + x[len(names)]
        p, pairs, start, _ = marginals(lanes, scores, x[-2:], x[-6:-2].reshape(2, 2))
        up = np.concatenate(
            (seen_forms - np.bincount(form, p[at], len(names)), [label.sum() - p.sum()], (seen_pairs - pairs).ravel(), seen_start - start)
        ) - 0.05 * x
        m, v = 0.9 * m + 0.1 * up, 0.99 * v + 0.01 * up * up
        x = x + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    scores = np.bincount(at, x[form], k) + x[len(names)]
    p = marginals(lanes, scores, x[-2:], x[-6:-2].reshape(2, 2))[0]
    size = np.diff(np.append(first, k)).astype(float)
    evidence = np.add.reduceat(np.maximum(scores - x[len(names)], 0), first)
    inputs = document_inputs(np.maximum.reduceat(p, first), np.add.reduceat(p, first), evidence, size)
    document = logistic(inputs, np.array(toxic, float))
    return Chain(dict(zip(names, x[: len(names)].tolist())), float(x[len(names)]), x[-6:-2].reshape(2, 2), x[-2:], document)


def logistic(inputs: np.ndarray, label: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Newton steps; the label 1 has a quarter of the weight, so a clean document is the safer guess."""
    w = np.zeros(inputs.shape[1])
    weight = np.where(label > 0, 0.25 / max(label.sum(), 1), 0.75 / max((1 - label).sum(), 1)) * len(label)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(inputs @ w, -30, 30)))
        curve = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, inputs.T @ (weight * (label - p)) - penalty * w)
        w = w + np.clip(step, -5, 5)
    return w


class Neutral:
    """Marginals of a text whose tokens all have the bias alone: they depend on its length only."""

    def __init__(self, chain: Chain):
        self.chain, self.ahead, self.behind = chain, np.zeros((0, 2)), np.zeros((0, 2))

    def of(self, n: int) -> tuple[float, float]:
        if n > len(self.ahead):
            self._extend(max(n, 2 * len(self.ahead), 4096))
        both = self.ahead[:n] * self.behind[:n][::-1]
        p = both[:, 1] / both.sum(1)
        return float(p.max()), float(p.sum())

    def _extend(self, size: int) -> None:
        go, emit = np.exp(self.chain.move), np.array([1.0, np.exp(self.chain.bias)])
        a, b = np.exp(self.chain.start) * emit, np.ones(2)
        ahead, behind = [], []
        for _ in range(size):
            ahead.append(a / a.sum())
            behind.append(b / b.sum())
            a, b = (ahead[-1] @ go) * emit, go @ (emit * behind[-1])
        self.ahead, self.behind = np.array(ahead), np.array(behind)


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Chain:
    """Fit on labelled rows (doc_id, toxic); all of them may be used, the caller holds rows out."""
    prepare_workers(docs.sparkSession)
    kinds = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = None
    for kind, most in ((1, sample.toxic), (0, sample.other)):
        one = kinds.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most)
        picked = one if picked is None else picked.unionByName(one)
    # At most sample.toxic + sample.other rows.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for text, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for form in {f for w in set(_TOKEN.findall(text or "")) for f in forms_of(w)}:
                    tally.setdefault(form, [0, 0])[bad] += 1
            rows = [(f, n[1], n[0]) for f, n in tally.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]], ["form", "bad", "good"]
            )

    counted = texts.select("text", "toxic").mapInArrow(tidy(count), "form string, bad bigint, good bigint").groupBy("form").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sizes = {r["toxic"]: r["n"] for r in picked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    odds = F.log((F.col("bad") + 0.1) / n_bad) - F.log((F.col("good") + 0.5) / n_good)
    # Log-likelihood ratio against an even spread: chance finds among many forms stay out.
    even = (F.col("bad") + F.col("good")) * n_bad / (n_bad + n_good)
    telling = 2 * F.col("bad") * F.log(F.col("bad") / even)
    kept = counted.where("bad > 0").where(telling >= sample.telling).withColumn("odds", odds).where(F.col("odds") > np.log(4))
    found = {r["form"]: r["odds"] for r in kept.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "form").limit(sample.forms).collect()}
    fit = None
    for kind in (1, 0):
        one = texts.where((F.col("toxic") == kind) & (F.length("text") <= sample.fit_chars)).orderBy(order, "doc_id", "text").limit(sample.fit_each)
        fit = one if fit is None else fit.unionByName(one)
    rows = fit.select("text", "toxic").collect()  # at most 2 * fit_each texts of fit_chars
    if not rows:
        return Chain({}, -5.0, np.zeros((2, 2)), np.zeros(2), np.array([-5.0, 0.0, 0.0, 0.0, 0.0, 0.0]))
    return fit_chain([r["text"] for r in rows], [r["toxic"] for r in rows], found)


SCORED = "score double, toxic_tokens int, spans string"


def score_texts(docs: DataFrame, chain: Chain, group: int = 400_000) -> DataFrame:
    """All columns of ``docs`` (none of them named like the new ones) and score, toxic_tokens, spans.

    Null and empty texts have one empty token, which gives their score.  ``spans`` lists character
    ranges ``from-to`` whose tokens are toxic with a marginal of at least one half.
    """
    prepare_workers(docs.sparkSession)
    names = docs.columns
    ship = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = ship.value
        neutral = Neutral(chain)
        for batch in batches:
            text = batch.column(names.index("text"))
            codes, words, starts = word_codes(text)
            own = np.array([chain.word_score(w) for w in words]) if words else np.zeros(0)
            n, hot = batch.num_rows, (own != chain.bias)[codes]
            hits = np.add.reduceat(np.append(hot, False), starts[:-1]) * (np.diff(starts) > 0) if n else np.zeros(0)
            largest, summed, evidence, marked = np.zeros(n), np.zeros(n), np.zeros(n), [None] * n
            above = np.maximum(own - chain.bias, 0)
            todo = np.flatnonzero(hits)
            for d in np.flatnonzero(hits == 0):
                largest[d], summed[d] = neutral.of(max(1, starts[d + 1] - starts[d]))
            size, held = 0, []
            for d in [*todo, None]:
                if d is not None:
                    held.append(d)
                    size += starts[d + 1] - starts[d]
                if held and (d is None or size >= group):
                    tokens = [codes[starts[x] : starts[x + 1]] for x in held]
                    lanes = Lockstep(tokens)
                    p = marginals(lanes, own[lanes.flat], chain.start, chain.move)[0]
                    cuts = np.concatenate(([0], np.cumsum([len(x) for x in tokens])))
                    for x, a, b in zip(held, cuts[:-1], cuts[1:]):
                        largest[x], summed[x] = p[a:b].max(), p[a:b].sum()
                        evidence[x] = above[codes[starts[x] : starts[x + 1]]].sum()
                        bad = np.flatnonzero(p[a:b] >= 0.5)
                        if len(bad):
                            marked[x] = _ranges(text[int(x)].as_py(), bad)
                    size, held = 0, []
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(chain.score(largest, summed, evidence, np.maximum(np.diff(starts), 1))),
                    pa.array([x[0] if x else 0 for x in marked], pa.int32()),
                    pa.array([x[1] if x else "" for x in marked], pa.string()),
                ],
                [*names, "score", "toxic_tokens", "spans"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{kinds}, {SCORED}")


def _ranges(text: str, bad: np.ndarray) -> tuple[int, str]:
    """Number of toxic tokens, and the ranges of neighbouring ones."""
    wanted, spans, last = set(bad.tolist()), [], -2
    for k, token in enumerate(_TOKEN.finditer(text)):
        if k in wanted:
            if last == k - 1:
                spans[-1][1] = token.end()
            else:
                spans.append([token.start(), token.end()])
            last = k
    return len(wanted), ";".join(f"{a}-{b}" for a, b in spans)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    scored = score_texts(docs.withColumn("held_out", remainder("doc_id", 5) == 0), train(docs, labels))
    return scored.select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "toxic_tokens", "spans"
    )
