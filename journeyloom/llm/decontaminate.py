"""Benchmark decontamination by latent semantic retrieval.

Texts become streams of word hashes (A-Z folded, no punctuation around words), written down once.
Their passages, weighted by TF-IDF over hashed terms, go through a randomised singular value
decomposition: the sketch (terms x rank, a fixed size) is multiplied task by task and summed by Spark.
In the latent space, with all directions scaled alike, every passage of every document is compared
with every passage of the benchmark.  Pairs above a cosine are candidates, and so are places where three
words of an item follow each other (all of its words, if it has fewer), so that an item word for word
is never missed; the longest common subsequence of the item and the text around, and of its answer (its last sentence), decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from journeyloom.llm.common import prepare_workers, summed_arrays, table, tidy, word_codes
from journeyloom.sources.workspace import settle

_TRIM = ".,;:!?\"'()[]{}<>|*&%$#@~`_-+=/\\"


@dataclass(frozen=True)
class Retrieval:
    terms: int = 2048
    rank: int = 64
    oversample: int = 8
    passage: int = 64  # words of a passage in the decomposition
    window: int = 32  # words of a passage in the search, which moves by half of it
    cosine: float = 0.42
    overlap: float = 0.6  # of the item's words, in order
    answer: float = 0.5  # of the answer's words, in order
    certain: float = 0.85  # overlap from which the answer does not matter
    item_block: int = 5000
    seed: int = 5


def word_hash(word: str) -> int:
    return xxhash.xxh32_intdigest(word.strip(_TRIM).lower())


def hashed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, words): 32-bit hashes of the words of every text, in order."""
    prepare_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, words, starts = word_codes(batch.column(1))
            stream = np.fromiter(map(word_hash, words), "<u4", len(words))[codes]
            rows = [stream[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "words"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, words binary")


def _passages(batches: Iterable[pa.RecordBatch], r: Retrieval, most: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of each passage, and the term of every word; what is left at the end of a text is a passage."""
    sizes, held = [], []
    for batch in batches:
        for body in batch.column(batch.num_columns - 1).to_pylist():
            stream = np.frombuffer(body, "<u4")
            for a in range(0, len(stream), r.passage * most):
                part = stream[a : a + r.passage * most]
                held.append(part)
                whole, rest = divmod(len(part), r.passage)
                sizes += [r.passage] * whole + [rest] * (rest > 0)
                if len(sizes) >= most:
                    yield np.array(sizes), _terms(np.concatenate(held), r)
                    sizes, held = [], []
    if sizes:
        yield np.array(sizes), _terms(np.concatenate(held), r)


def _terms(words: np.ndarray, r: Retrieval) -> np.ndarray:
    return (words % np.uint32(r.terms)).astype(np.int64)


def _cells(sizes: np.ndarray, term: np.ndarray, r: Retrieval) -> np.ndarray:
    """Per word its cell in a (passages x terms) table."""
    return np.repeat(np.arange(len(sizes)), sizes) * r.terms + term


def _row_sums(values: np.ndarray, sizes: np.ndarray, rows: np.ndarray, longest: int) -> np.ndarray:
    """Sums of consecutive rows of ``values``, ``sizes`` of them each; the last row has to be zero.

    Goes by the place inside a sum, so each step adds whole tables of ``rows`` looked up.
    """
    places = np.full((len(sizes), longest), len(values) - 1)
    places[np.arange(longest) < sizes[:, None]] = rows
    places = np.ascontiguousarray(places.T)
    total = values[places[0]]
    held = np.empty_like(total)
    for at in places[1:]:
        total += np.take(values, at, axis=0, out=held, mode="clip")
    return total


def _with_zero(values: np.ndarray) -> np.ndarray:
    return np.vstack([values, np.zeros((1, values.shape[1]), values.dtype)])


def _emit(lane_arrays: list[np.ndarray]) -> pa.RecordBatch:
    lane = TaskContext.get().partitionId() % 64
    return pa.RecordBatch.from_arrays(
        [pa.array([lane] * len(lane_arrays), pa.int64()), pa.array(range(len(lane_arrays)), pa.int64()), pa.array([x.ravel().tolist() for x in lane_arrays], pa.list_(pa.float64()))],
        ["lane", "part", "counts"],
    )


def inverse_frequency(streams: DataFrame, r: Retrieval) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(r.terms), 0
        for sizes, term in _passages(batches, r):
            seen = np.zeros(len(sizes) * r.terms, bool)
            seen[_cells(sizes, term, r)] = True
            found += seen.reshape(-1, r.terms).sum(0)
            n += len(sizes)
        yield _emit([np.append(found, n)])

    got = summed_arrays(streams.select("words").mapInArrow(tidy(run), "lane bigint, part bigint, counts array<double>")).get(0, np.zeros(r.terms + 1))
    return np.log((got[-1] + 1) / (got[:-1] + 1)) + 0.1


def latent_space(streams: DataFrame, r: Retrieval) -> np.ndarray:
    """Terms x rank: weighted terms to latent coordinates of equal scale.

    Randomised subspace iteration on the Gram matrix of the passages: a Gaussian sketch, one product
    to find the range, one for the values inside it.
    """
    weight = inverse_frequency(streams, r).astype(np.float32)

    def product(basis: np.ndarray) -> np.ndarray:
        basis = basis.astype(np.float32)
        weighted = _with_zero(weight[:, None] * basis)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(basis.shape)
            for sizes, term in _passages(batches, r):
                a = np.zeros(len(sizes) * r.terms, np.float32)
                np.add.at(a, _cells(sizes, term, r), weight[term])
                a = a.reshape(-1, r.terms)
                # A passage has few of the terms, so its product with the basis is a sum of rows.
                square = np.maximum(np.einsum("ij,ij->i", a, a), np.float32(1e-18))
                total += a.T @ (_row_sums(weighted, sizes, term, r.passage) / square[:, None])
            yield _emit([total])

        got = summed_arrays(streams.select("words").mapInArrow(tidy(run), "lane bigint, part bigint, counts array<double>"))
        return got[0].reshape(basis.shape) if got else np.zeros(basis.shape)

    sketch = np.random.default_rng(r.seed).standard_normal((r.terms, r.rank + r.oversample))
    span = np.linalg.qr(product(sketch))[0]
    inner = span.T @ product(span)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    top = np.argsort(-values)[: r.rank]
    scale = np.sqrt(np.maximum(values[top], values.max(initial=0) * 1e-9 + 1e-12))
    return (weight[:, None] * (span @ turn[:, top]) / scale).astype(np.float32)


def common_length(bits: dict[int, int], size: int, words: Iterable[int]) -> int:
    """Longest common subsequence with a pattern given as bit masks per word."""
    full, row = (1 << size) - 1, (1 << size) - 1
    for w in words:
        hit = row & bits.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _bits(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of every n words in a row; equal keys of different words cost a check only."""
    key = words[: max(0, len(words) - n + 1)].astype(np.uint64)
    for k in range(1, n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(key)]
    return key


_SIEVE = 20


def _sieve_place(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _SIEVE)


class Items:
    """A block of benchmark items: word hashes, answers, and latent vectors of their windows."""

    def __init__(self, rows: list, space: np.ndarray, r: Retrieval):
        self.ids, self.words, self.answers, vectors, self.owner, self.shift = [], [], [], [], [], []
        self.first, grams = [], {}
        for item_id, text in rows:
            words = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
            if not words:
                continue
            sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
            # Words of wider white space alone make no sentence: the whole item is its answer then.
            answer = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", sentences[-1])] if sentences else words
            self.first.append(len(self.owner))
            n = min(3, len(words))
            keys = _grams(np.array(words, np.uint32), n)
            grams.setdefault(n, []).append((keys, np.full(len(keys), len(self.ids)), np.arange(len(keys))))
            for at in range(0, max(1, len(words) - r.window + r.window // 2), r.window // 2):
                part = np.array(words[at : at + r.window], np.uint32)
                vectors.append(space[part % np.uint32(r.terms)].sum(0))
                self.owner.append(len(self.ids))
                self.shift.append(at)
            self.ids.append(item_id)
            self.words.append(words)
            self.answers.append(answer)
        stacked = np.array(vectors, np.float32).reshape(-1, space.shape[1])
        self.vectors = stacked / np.maximum(np.linalg.norm(stacked, axis=1, keepdims=True), 1e-9)
        # Per length the keys in order, and the item and the place in it of each.
        self.grams = {}
        for n, parts in grams.items():
            keys, item, place = map(np.concatenate, zip(*parts))
            order = np.argsort(keys, kind="stable")
            self.grams[n] = keys[order], item[order], place[order]
        self.sieves = {}
        for n, (keys, _, _) in self.grams.items():
            self.sieves[n] = np.zeros(1 << _SIEVE, bool)
            self.sieves[n][_sieve_place(keys)] = True
        self.last = [*self.first[1:], len(self.owner)]
        self.bits = [_bits(w) for w in self.words]
        self.answer_bits = [_bits(w) for w in self.answers]


HIT = "doc_id bigint, item_id bigint, overlap double, answer double, cosine double"


def search(streams: DataFrame, items: Items, space: np.ndarray, r: Retrieval) -> DataFrame:
    """(doc_id, item_id, overlap, answer, cosine) of contaminated documents; copies of a row repeat."""
    half = r.window // 2
    state, places = items.__dict__, _with_zero(space)

    def judge(stream: list[int], item: int, at: int) -> tuple[float, float]:
        words, reach = state["words"][item], len(state["words"][item]) // 2 + half
        span = stream[max(0, at - reach) : at + len(words) + reach]
        bits = state["bits"][item]
        # No other word is in a common subsequence, and none is longer than their number.
        shared = list(filter(bits.__contains__, span))
        if len(shared) < r.overlap * len(words):
            return 0.0, 0.0
        overlap = common_length(bits, len(words), shared) / len(words)
        if overlap < r.overlap:
            return overlap, 0.0
        answer = state["answers"][item]
        return overlap, common_length(state["answer_bits"][item], len(answer), span) / len(answer)

    lengths = np.array([len(w) for w in items.words], np.int64)

    def word_places(words: np.ndarray) -> np.ndarray:
        return (words * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)

    def promising(flat: np.ndarray, table: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of the spans low to high may share enough words with their items: none is lost, some are kept in vain."""
        size, kept, at = high - low, [], 0
        ends, place = np.cumsum(size), word_places(flat)
        while at < len(size):
            # About a million words at once.
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000)))
            n = size[at:to]
            first = np.cumsum(n) - n
            spot = np.arange(n.sum()) + np.repeat(low[at:to] - first, n)
            shared = np.add.reduceat(table[np.repeat(item[at:to], n), place[spot]].astype(np.int64), first)
            kept.append(shared >= r.overlap * lengths[item[at:to]])
            at = to
        return np.concatenate(kept) if kept else np.zeros(0, bool)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        table = np.zeros((len(lengths), 1 << 12), bool)
        for k, words in enumerate(state["words"]):
            table[k, word_places(np.array(words, np.uint32))] = True
        for batch in batches:
            docs, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held, size = [], 0
            for k, body in enumerate([*bodies, None]):
                if body:
                    held.append((k, np.frombuffer(body, "<u4")))
                    size += len(held[-1][1])
                if held and (body is None and k == len(bodies) or size >= 100_000):
                    rows += compare([(docs[d], stream) for d, stream in held], table)
                    held, size = [], 0
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in HIT.split(", ")])
            rows = []

    def shared_grams(flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in ``flat``, items and places in them where both have the same words in a row."""
        for n, (keys, item, place) in state["grams"].items():
            own = _grams(flat, n)
            # Most keys are told by a few of their bits; the others are looked up.
            hit = np.flatnonzero(state["sieves"][n][_sieve_place(own)])
            low = np.searchsorted(keys, own[hit])
            same = keys[np.minimum(low, len(keys) - 1)] == own[hit]
            hit, low = hit[same], low[same]
            times = np.searchsorted(keys, own[hit], side="right") - low
            which = np.arange(times.sum()) + np.repeat(low - (np.cumsum(times) - times), times)
            yield np.repeat(hit, times), item[which], place[which]

    def compare(texts: list[tuple], table: np.ndarray) -> list[tuple]:
        owner, place = [], []
        flat = np.concatenate([s for _, s in texts])
        sizes, at, begins, rows_at = [], 0, [], []
        for n, (_, stream) in enumerate(texts):
            cuts = range(0, len(stream), half)
            begins.append(at)
            rows_at.append(len(sizes))
            sizes += [min(half, len(stream) - c) for c in cuts]
            owner += [n] * len(cuts)
            place += list(cuts)
            at += len(stream)
        blocks = _row_sums(places, np.array(sizes), _terms(flat, r), half)
        owner, place = np.array(owner), np.array(place)
        joined = blocks.copy()
        same = np.flatnonzero(owner[:-1] == owner[1:])
        joined[same] += blocks[same + 1]
        joined /= np.maximum(np.linalg.norm(joined, axis=1, keepdims=True), 1e-9)
        best: dict[tuple[int, int], tuple] = {}
        cos = joined @ state["vectors"].T
        first, last, owners, shift, begins, rows_at = (np.array(x, np.int64) for x in (*map(state.get, ("first", "last", "owner", "shift")), begins, rows_at))
        # Candidates: text, item, place in the text where the item would begin, row and column of the cosine.
        row, column = np.divmod(np.flatnonzero(cos >= r.cosine), max(1, cos.shape[1]))
        parts = [(owner[row], owners[column], np.maximum(0, place[row] - shift[column]), row, column)]
        for spot, item, inside in shared_grams(flat):
            text = np.searchsorted(begins, spot, side="right") - 1
            local = spot - begins[text]
            column = np.minimum(first[item] + inside // half, last[item] - 1)
            parts.append((text, item, np.maximum(0, local - inside), rows_at[text] + local // half, column))
        text, item, begin, row, column = (np.concatenate(x) for x in zip(*parts))
        # The first of those that begin close to each other.
        order = np.lexsort((begin // half, item, text))
        at = np.stack([text, item, begin // half])[:, order]
        one = np.sort(order[np.append(True, (at[:, 1:] != at[:, :-1]).any(0))[: len(order)]])
        text, item, begin, row, column = (x[one] for x in (text, item, begin, row, column))
        reach, sizes = lengths[item] // 2 + half, np.array([len(stream) for _, stream in texts])
        low, high = np.maximum(0, begin - reach), np.minimum(sizes[text], begin + lengths[item] + reach)
        kept = promising(flat, table, item, begins[text] + low, begins[text] + high)
        lists: dict[int, list[int]] = {}
        for n, i, from_, p, q in zip(*(x[kept].tolist() for x in (text, item, begin, row, column))):
            if n not in lists:
                lists[n] = texts[n][1].tolist()
            overlap, answer = judge(lists[n], i, from_)
            if overlap >= r.certain or overlap >= r.overlap and answer >= r.answer:
                best[n, i] = max(best.get((n, i), (0.0,)), (overlap, answer, float(cos[p, q])))
        return [(texts[n][0], state["ids"][item], *found) for (n, item), found in best.items()]

    return streams.select("doc_id", "words").mapInArrow(tidy(run), HIT)


def contaminated(docs: DataFrame, benchmark: DataFrame, r: Retrieval = Retrieval()) -> DataFrame:
    """Pairs (doc_id, item_id) with overlap, answer and cosine; one row per pair (starts jobs).

    Null and empty texts and items are in no pair; rows that share a doc_id are one document, and a
    null doc_id stays null.  Items go through in blocks, each against all passages.
    """
    spark = docs.sparkSession
    streams = settle(hashed_words(docs), "word_streams")
    space = latent_space(streams, r)
    found, block = None, []

    def extend(found: DataFrame | None, block: list) -> DataFrame:
        one = search(streams, Items(block, space, r), space, r)
        return one if found is None else found.unionByName(one)

    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        if len(block) == r.item_block:
            found, block = extend(found, block), []
    if block:
        found = extend(found, block)
    if found is None:
        return spark.createDataFrame([], HIT)
    numbers = [F.round(F.max(c), 6).alias(c) for c in ("overlap", "answer", "cosine")]
    return found.groupBy("doc_id", "item_id").agg(*numbers)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
