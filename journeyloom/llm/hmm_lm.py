"""Hidden Markov language model over an open vocabulary.

Words are counted exactly over all training texts.  An emission is a class and a word in it: the
``own_classes`` most frequent words are classes of their own, every other word falls into a class by
its ending, where it has the share (count + 1) / (class count + class words + 1).  So the table that
Baum-Welch trains has a fixed size, while the word probabilities rest on the count of every word.

Counts of the ``known_words`` most frequent words (a fixed bound) travel to the tasks; all other words
of a text meet their counts in a shuffle join.  Each training round runs forward-backward over all
training texts, sums the expected counts per task, and sums those by Spark in two steps.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from journeyloom.llm.common import prepare_workers, summed_arrays, table, word_codes
from journeyloom.sources.workspace import settle

END = "\n"  # no word holds white space
STATES, ROUNDS, ENDINGS = 8, 5, 256
OWN_CLASSES, KNOWN_WORDS = 8191, 65_536
SEGMENT, GROUP_TOKENS = 256, 150_000


def remainder(column: str, base: int) -> Column:
    """crc32 of an id as text modulo ``base``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % base


def ending_class(word: str) -> int:
    return zlib.crc32(word[-3:].encode()) % ENDINGS


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a frame with one text column: its words, A-Z folded, and one end per text."""
    prepare_workers(texts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, words, _ = word_codes(batch.column(0), lower=True)
            n = np.bincount(codes, minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*words, END], pa.string()), pa.array([*n.tolist(), batch.num_rows], pa.int64())], ["word", "n"]
            )

    return texts.mapInArrow(run, "word string, n bigint").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What tasks need to know of the words: bounded by KNOWN_WORDS and ENDINGS.

    Classes: 0 is the end, then the most frequent words, then the endings.
    """

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).first()
        self.tokens, self.words = total["tokens"] or 0, total["words"]
        top = counts.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).collect()
        self.count = {r["word"]: r["n"] for r in top}
        own = [w for w in self.count if w != END][:OWN_CLASSES]
        self.own = {w: k + 1 for k, w in enumerate(own)}
        self.first_ending = len(own) + 1
        self.classes = self.first_ending + ENDINGS
        ending = F.crc32(F.right("word", F.lit(3)).cast("binary")) % ENDINGS
        sums = counts.where(F.col("word") != END).groupBy(ending.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        n, v = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for r in sums:
            n[r["k"]], v[r["k"]] = r["n"], r["v"]
        for w in own:  # these left their endings
            n[ending_class(w)] -= self.count[w]
            v[ending_class(w)] -= 1
        self.share_log = np.log10(n + v + 1)
        self.base_log = math.log10(self.tokens + self.words + 1)
        mass = np.concatenate(([self.count.get(END, 0)], [self.count[w] for w in own], n)) + 0.5
        self.unigram = mass / mass.sum()


ENCODED = (
    "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, inside double, "
    "classes binary, rare array<string>, rare_n array<int>"
)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per document: its classes, what is known of its frequent words, and its other words."""
    prepare_workers(docs.sparkSession, "6m")
    ship = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc: Vocabulary = ship.value
        uid = TaskContext.get().partitionId() << 36
        end_n = voc.count.get(END, 0)
        for batch in batches:
            codes, words, starts = word_codes(batch.column(1), lower=True)
            own = np.fromiter((voc.own.get(w, -1) for w in words), np.int32, len(words))
            ending = np.fromiter((ending_class(w) for w in words), np.int32, len(words))
            n = np.fromiter((voc.count.get(w, -1) for w in words), np.int64, len(words))
            classes = np.where(own >= 0, own, voc.first_ending + ending).astype("<u2")
            plus = np.log10(np.maximum(n, 0) + 1)
            inside = np.where(own >= 0, 0.0, plus - voc.share_log[ending])
            is_rare = n < 0
            # Sums per text: differences of running sums would lose digits, so reduce per text.
            sizes = np.diff(starts)
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            add = lambda per_word: np.bincount(doc, per_word[codes], batch.num_rows)
            at = np.flatnonzero(is_rare[codes])
            pair, often = np.unique(doc[at] * len(words) + codes[at], return_counts=True)
            cuts = np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(words)).astype(np.int32)
            rare = pa.ListArray.from_arrays(cuts, pa.array(words, pa.string()).take(pa.array(pair % max(len(words), 1))))
            rare_n = pa.ListArray.from_arrays(cuts, pa.array(often.astype(np.int32)))
            body = classes[codes]
            ended = np.zeros((), "<u2").tobytes()
            columns = [
                pa.array(uid + np.arange(batch.num_rows)),
                batch.column(0).cast(pa.int64()),
                batch.column(2),
                pa.array((sizes + 1).astype(np.int64)),
                pa.array((add((n > 0).astype(float)) + (end_n > 0)).astype(np.int64)),
                pa.array(add(plus) + math.log10(end_n + 1)),
                pa.array(add(inside)),
                pa.array([body[a:b].tobytes() + ended for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
                rare,
                rare_n,
            ]
            uid += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ENCODED.split(", ")])

    chosen = docs.select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    return chosen.mapInArrow(run, ENCODED)


class Model:
    """Start, transition and emission (classes x states) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def initial(unigram: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * rng.lognormal(0.0, 0.7, (len(unigram), states))
        move = np.full((states, states), 0.2 / max(states - 1, 1)) + np.eye(states) * 0.7
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Lockstep:
    """Sequences side by side, longest first, so that the ones still running are a prefix."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(x) for x in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        self.flat = np.concatenate(sequences)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1][self.order]
        sizes = sizes[self.order]
        self.steps = int(sizes[0])
        self.running = np.searchsorted(-sizes, -np.arange(self.steps + 1), side="left")

    def at(self, step: int) -> np.ndarray:
        return self.flat[self.starts[: self.running[step]] + step]


def log10_likelihood(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """Scaled forward recursion over whole sequences (each at least one symbol long)."""
    lanes, ones = Lockstep(sequences), np.ones(len(model.start))
    out = np.zeros(len(sequences))
    state = None
    for t in range(lanes.steps):
        n = lanes.running[t]
        state = (model.start if t == 0 else state[:n] @ model.move) * model.emit[lanes.at(t)]
        scale = state @ ones
        state /= scale[:, None]
        out[:n] += np.log10(scale)
    back = np.empty_like(out)
    back[lanes.order] = out
    return back


def expected_counts(sequences: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: expected starts, transitions and emissions."""
    lanes, states = Lockstep(sequences), len(model.start)
    ones, ahead, scales = np.ones(states), [], []
    state = None
    for t in range(lanes.steps):
        n = lanes.running[t]
        state = (model.start if t == 0 else state[:n] @ model.move) * model.emit[lanes.at(t)]
        scale = state @ ones
        state = state / scale[:, None]
        ahead.append(state)
        scales.append(scale)
    moves, symbols, shares = np.zeros((states, states)), [], []
    back = np.ones((0, states))
    for t in range(lanes.steps - 1, -1, -1):
        n, later = lanes.running[t], lanes.running[t + 1] if t + 1 < lanes.steps else 0
        now = np.ones((n, states))
        if later:
            seen = model.emit[lanes.at(t + 1)] * back / scales[t + 1][:, None]
            moves += ahead[t][:later].T @ seen
            now[:later] = seen @ model.move.T
        back = now
        symbols.append(lanes.at(t))
        shares.append(ahead[t] * back)
    symbol, share = np.concatenate(symbols), np.concatenate(shares)
    emits = np.stack([np.bincount(symbol, share[:, k], len(model.emit)) for k in range(states)], 1)
    return shares[-1].sum(0), moves * model.move, emits


def _groups(batches: Iterable[pa.RecordBatch], segment: int | None) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(row keys, class sequences) of about GROUP_TOKENS symbols; ``segment`` cuts long ones."""
    keys, held, size = [], [], 0
    for batch in batches:
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            symbols = np.frombuffer(body, "<u2")
            step = segment or len(symbols)
            for a in range(0, len(symbols), step):
                keys.append(key)
                held.append(symbols[a : a + step])
            size += len(symbols)
            if size >= GROUP_TOKENS:
                yield keys, held
                keys, held, size = [], [], 0
    if held:
        yield keys, held


def train_round(encoded: DataFrame, model: Model, unigram: np.ndarray) -> Model:
    """One Baum-Welch step over all training documents.

    For the expected counts only, texts are cut into segments of SEGMENT symbols, each starting from
    the model's own state shares; the cut bounds memory, nothing is left out.
    """
    states, classes = len(model.start), len(model.emit)
    ship = encoded.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*ship.value)
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        for _, held in _groups(batches, SEGMENT):
            a, b, c = expected_counts(held, model)
            start, move, emit = start + a, move + b, emit + c
        lane = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays(
            [pa.array([lane] * 3), pa.array([0, 1, 2]), pa.array([x.ravel().tolist() for x in (start, move, emit)], pa.list_(pa.float64()))],
            ["lane", "part", "counts"],
        )

    kind = "lane bigint, part bigint, counts array<double>"
    each = encoded.where("not held_out").select("uid", "classes").mapInArrow(run, kind)
    got = summed_arrays(each)
    start, move, emit = got[0] + 1.0, got[1].reshape(states, states) + 1.0, got[2].reshape(classes, states)
    # Half a count per class over all states, as in the unigram shares, and a hundredth of those in every state.
    emit = emit + 0.5 / states + 0.01 * emit.sum(0) * unigram[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row (starts jobs).

    Null and empty texts are one end token.  A null doc_id counts as empty text for the split.
    Repeated rows are scored alike, other columns are ignored; without training texts all counts are 0.
    """
    texts = docs.where(remainder("doc_id", 7) != 2).select("text")
    counts = settle(word_counts(texts), "word_counts")
    vocabulary = Vocabulary(counts)
    encoded = settle(encode(docs, vocabulary), "encoded_texts")
    model = Model.initial(vocabulary.unigram, states)
    if vocabulary.tokens:
        for _ in range(rounds):
            model = train_round(encoded, model, vocabulary.unigram)
    ship = docs.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*ship.value)
        for keys, held in _groups(batches, None):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(log10_likelihood(held, model))], ["uid", "hmm"])

    hmm = encoded.select("uid", "classes").mapInArrow(forward, "uid bigint, hmm double")
    places = encoded.where(F.size("rare") > 0).select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("_r"))
    found = (
        places.select("uid", F.col("_r.rare").alias("word"), F.col("_r.rare_n").alias("often"))
        .join(counts.where(F.col("n") <= _least(vocabulary)), "word", "left")
        .groupBy("uid")
        .agg(
            F.sum(F.col("often") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_log"),
            F.sum(F.when(F.col("n") > 0, F.col("often")).otherwise(0)).alias("rare_known"),
        )
    )
    rest = F.coalesce("rare_log", F.lit(0.0))
    return (
        encoded.drop("classes", "rare", "rare_n")
        .join(hmm, "uid")
        .join(found, "uid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") + rest - F.col("n_tokens") * vocabulary.base_log).alias("base_score"),
            (F.col("hmm") + F.col("inside") + rest).alias("score"),
        )
    )


def _least(vocabulary: Vocabulary) -> int:
    """No word outside the known ones is more frequent than the rarest of them."""
    return min(vocabulary.count.values(), default=0)


def op6_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


