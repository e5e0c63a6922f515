"""Best-fit packing by minimum bin slack.

Documents become token ids plus one end id; only those longer than a sequence are cut.  Packing
needs nothing but the lengths, so the plan is made on their histogram: at most ``capacity``
distinct lengths, however many documents there are.  The largest length left opens a bin, a bitset
subset-sum over the lengths left finds the fullest feasible combination, and that combination is
removed as often as the counts allow before the next one is searched.  Each search uses up at least
one length, so the driver's work is bounded by the capacity as well.

The rows meet the plan by their rank within their length.  Ranks come from bucket counts plus a
window inside a bucket, so a length that holds a large part of all rows is spread like any other.
"""

from __future__ import annotations

import math
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from journeyloom.llm.common import prepare_workers, slices, spread, table, tidy, word_codes
from journeyloom.sources.workspace import settle

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
# Text whose words, ids and places are in memory at once, beside the remembered words; results do not depend on it.
SLICE_BYTES = 2 << 20
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _tokenizers(path: str):
    """The whole tokenizer and its merges alone; a worker reads the file once for all of its tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    merges = Tokenizer(whole.model)
    merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return whole, merges


class WordIds:
    """Token ids of distinct words as little-endian 32-bit words, remembered between batches.

    The tokenizer drops white space and never joins characters across it, so the ids of a text are
    those of its words one after the other.  A word of letters with full stops or commas behind it
    is two steps of the tokenizer's own split; its letters go straight to the merges when folding
    and composition leave nothing to do.  Every other word takes the whole tokenizer.  Words are
    remembered up to ``known_bytes``; then the memory begins anew.
    """

    # What one remembered word costs besides its characters and ids, and words the tokenizer gets at once:
    # its own result of a word is some hundred times the ids.
    ENTRY_BYTES, AT_ONCE = 240, 4_000

    def __init__(self, path: str, known_bytes: int = 160 << 20):
        self.whole, self.merges = _tokenizers(path)
        self.known_bytes, self.held, self.known = known_bytes, 0, {}

    def of(self, words: list[str]) -> list[bytes]:
        if self.held > self.known_bytes:
            self.known, self.held = {}, 0
        known = self.known
        out = list(map(known.get, words))
        open_at = [k for k, ids in enumerate(out) if ids is None]
        parts: list[tuple[int, str, str]] = []
        plain, odd = set(), set()
        for k in open_at:
            word = words[k]
            stem = word.rstrip(".,")
            tail, head = word[len(stem) :], stem.lower()
            direct = stem.isalpha() and head.isalpha() and (stem.isascii() or _settled_form(stem))
            if not direct:
                head, tail = word, ""
            (plain if direct else odd).add(head)
            if tail:
                odd.add(tail)
            parts.append((k, head, tail))
        fresh = {"": b""}
        for todo, coder in ((plain, self.merges), (odd, self.whole)):
            fresh |= {head: known[head] for head in todo if head in known}
            left = [head for head in todo if head not in fresh]
            for at in range(0, len(left), self.AT_ONCE):
                some = left[at : at + self.AT_ONCE]
                for head, got in zip(some, coder.encode_batch_fast(some, add_special_tokens=False)):
                    fresh[head] = array("I", got.ids).tobytes()
        for k, head, tail in parts:
            out[k] = known[words[k]] = ids = fresh[head] + fresh[tail]
            self.held += self.ENTRY_BYTES + 4 * len(words[k]) + len(ids)
        return out


def _settled_form(stem: str) -> bool:
    """Composed already, and lower case does not depend on what stands around a letter."""
    return unicodedata.is_normalized("NFC", stem) and "\u03a3" not in stem


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece of every document: ids, the end id, cut every ``capacity`` ids.

    A null text counts as empty and is the end id alone; a null doc_id stays null; repeated rows are
    pieces of their own; further columns are dropped.
    """
    prepare_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(path or tokenizer_path())
        for batch in batches:
            for first, last in slices(batch.column(1), SLICE_BYTES):
                texts = batch.slice(first, last - first)
                codes, words, starts = word_codes(texts.column(1))
                flat, at = spread(codes, ids.of(words))
                ends = at[starts]
                rows: list[tuple] = []
                for doc, a, b in zip(texts.column(0).to_pylist(), ends[:-1], ends[1:]):
                    body = np.append(flat[a:b], np.uint32(END_ID)).astype("<u4")
                    for k, begin in enumerate(range(0, len(body), capacity)):
                        cut = body[begin : begin + capacity]
                        rows.append((doc, k, begin, len(cut), zlib.crc32(cut)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PIECES)


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths (``order``: descending) whose sum comes closest to ``room``."""
    inside, steps = (1 << (room + 1)) - 1, []
    reach = 1
    for length in order:
        left = min(counts[length], room // length) if length <= room else 0
        block = 1
        while left > 0:
            take = min(block, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & inside
            left -= take
            block *= 2
        if reach >> room:
            break
    target, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            target -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def minimum_slack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Bins for a histogram of lengths.

    Rows (length, first rank, copies per bin, bins, first bin, offset in the bin): the pieces of this
    length with the ranks from ``first rank`` on fill ``bins`` bins with ``copies per bin`` each.
    """
    counts = {k: n for k, n in histogram.items() if n > 0}
    order = sorted(counts, reverse=True)
    given = dict.fromkeys(counts, 0)
    plan, bin_id, head = [], 0, 0
    while head < len(order):
        top = order[head]
        if not counts[top]:
            head += 1
            continue
        counts[top] -= 1
        free = [x for x in order[head:] if counts[x] and x <= capacity - top]
        chosen = dict(fullest(counts, free, capacity - top)) if free else {}
        counts[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        bins, offset = min(counts[x] // k for x, k in chosen.items()), 0
        for x, k in sorted(chosen.items(), reverse=True):
            plan.append((x, given[x], k, bins, bin_id, offset))
            given[x] += k * bins
            counts[x] -= k * bins
            offset += k * x
        bin_id += bins
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...; length 1 to capacity) with sequence_id and offset.

    Starts jobs: pieces are written once, as ranks and plan must see the same rows.  Equal pieces take
    any of the places for their length.  An empty frame gives an empty frame.
    """
    spark = pieces.sparkSession
    pieces = settle(pieces, "pieces")
    # One row per length: at most `capacity` of them.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = minimum_slack_plan(histogram, capacity)
    plan = spark.createDataFrame(
        rows, "length bigint, first bigint, copies bigint, bins bigint, bin bigint, place bigint"
    )
    # Still at most one row per length, with the few combinations it occurs in.
    steps = plan.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first", "copies", "bins", "bin", "place"))).alias("_steps")
    )
    # As many buckets as a bucket of the most frequent length may have rows.
    buckets = 1 + math.isqrt(sum(histogram.values()))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")
    ranked = (
        keyed.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_at"))
    )
    last = lambda s: s["first"] + s["copies"] * s["bins"]
    found = F.filter("_steps", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < last(s)))[0]
    placed = ranked.join(F.broadcast(steps), "length").withColumn("_step", found)
    nth = F.col("_rank") - F.col("_step.first")
    return placed.select(
        *pieces.columns,
        (F.col("_step.bin") + F.floor(nth / F.col("_step.copies"))).cast("bigint").alias("sequence_id"),
        (F.col("_step.place") + nth % F.col("_step.copies") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(token_pieces(docs, capacity, path), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
