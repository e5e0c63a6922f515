"""Runs: stretches of words that repeat with a short period.

The words of a text are appended one after the other.  Every completed block of a power of two words
is a catcher: it waits for its own return between one and two block lengths later.  An appended word
completes one window per block size, and exactly one catcher waits for that window, so a word costs one
comparison per size.  A catch opens a comparison of the text with itself, shifted by the period; it is
led back to the first word it holds for and goes on with every appended word until one differs.  Squares
of one period that overlap are thereby one stretch, the run.

Any stretch of three periods or more holds a whole block of at most one period together with its
return, so no such run is missed.  Words are appended in slices to let arrays do the comparing; how a
text is cut into slices does not change the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from journeyloom.llm.common import prepare_workers, table, word_codes

MIN_LENGTH, MIN_EXPONENT = 6, 4
SLICE = 1 << 14
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of double windows from the names of their halves; equal windows have equal names."""
    with np.errstate(over="ignore"):
        mixed = left * _ODD[0] + (right ^ (right >> np.uint64(31))) * _ODD[1]
    return mixed ^ (mixed >> np.uint64(29))


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays of one length."""
    at, step = 0, 64
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at += step
        step *= 4
    return len(a)


class SquareCatchers:
    """Runs of one text while its words (as integer codes) are appended."""

    def __init__(self, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT):
        if min_exponent < 3:
            raise ValueError("blocks catch runs of three periods and more")
        self.min_length, self.min_exponent = min_length, min_exponent
        self.n = 0
        self._words = np.empty(0, np.int64)
        # Per block size 2**k: the first window still kept, and the names of all windows from there on.
        self._names: list[tuple[int, np.ndarray]] = []
        self._open: dict[int, int] = {}
        self._last: dict[int, tuple[int, int]] = {}
        self._found: dict[tuple[int, int], int] = {}

    def append(self, codes: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(codes)
        if self.n > len(self._words):
            grown = np.empty(max(self.n, 2 * len(self._words)), np.int64)
            grown[:old] = self._words[:old]
            self._words = grown
        self._words[old : self.n] = codes
        self._advance(old)
        size, level = 1, 0
        while size <= self.n:
            self._complete(level, size, old)
            size, level = 2 * size, level + 1
        for k, (first, names) in enumerate(self._names):
            # What the next appended words still need: two block lengths.
            if (spare := len(names) - (2 << k)) > (4 << k):
                self._names[k] = first + spare, names[spare:].copy()

    def _complete(self, level: int, size: int, old: int) -> None:
        """Names of the windows of ``size`` words that the words from ``old`` on complete, and their catches."""
        begin, end = max(0, old - size + 1), self.n - size + 1
        if level == 0:
            fresh = self._words[old : self.n].astype(np.uint64)
        else:
            first, halves = self._names[level - 1]
            a, b, half = begin - first, end - first, size // 2
            fresh = _joined(halves[a:b], halves[a + half : b + half])
        if level == len(self._names):
            self._names.append((0, fresh))
        else:
            first, names = self._names[level]
            self._names[level] = first, np.concatenate((names, fresh))
        begin = max(begin, size)
        if begin >= end:
            return
        first, names = self._names[level]
        catcher = (begin // size - 1) * size
        waiting = np.repeat(names[catcher - first : end - size - first : size], size)[begin - size - catcher :][: end - begin]
        caught = begin + np.flatnonzero(names[begin - first : end - first] == waiting)
        if not len(caught):
            return
        blocks = (caught // size - 1) * size
        for period, start, stop in self._stretches():
            if len(caught) and period < size:
                # Inside a run a multiple of its period says nothing new.
                new = ((caught - blocks) % period != 0) | (blocks < start) | (caught + size > stop)
                caught, blocks = caught[new], blocks[new]
        for at, block in zip(caught.tolist(), blocks.tolist()):
            self._compare(block, at - block, size)

    def _stretches(self) -> list[tuple[int, int, int]]:
        known = [(p, *ends) for p, ends in self._last.items() if p in self._open]
        return known + [(p, *ends) for ends, p in self._found.items()]

    def _compare(self, block: int, period: int, size: int) -> None:
        start, stop = self._last.get(period, (0, 0))
        if start <= block and block + period + size <= stop:
            return
        words = self._words[: self.n]
        ahead = _agreeing(words[block : self.n - period], words[block + period :])
        if ahead < size:
            return  # equal names of different words
        back = _agreeing(words[:block][::-1], words[period : block + period][::-1])
        start, stop = block - back, block + period + ahead
        self._last[period] = start, stop
        if stop == self.n:
            self._open[period] = start
        else:
            self._close(period, start, stop)

    def _advance(self, old: int) -> None:
        """Every open comparison goes on over the appended words."""
        words = self._words
        for period, start in list(self._open.items()):
            stop = old + _agreeing(words[old - period : self.n - period], words[old : self.n])
            self._last[period] = start, stop
            if stop < self.n:
                del self._open[period]
                self._close(period, start, stop)

    def _close(self, period: int, start: int, stop: int) -> None:
        if stop - start >= self.min_exponent * period:
            # A multiple of the period holds for the same stretch.
            known = self._found.get((start, stop), period)
            self._found[start, stop] = min(known, period)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs of the words so far, by start, then period."""
        found = dict(self._found)
        for period, start in self._open.items():
            if self.n - start >= self.min_exponent * period:
                found[start, self.n] = min(found.get((start, self.n), period), period)
        return sorted((a, b - a, p) for (a, b), p in found.items() if b - a >= self.min_length)


def runs_of(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    catchers = SquareCatchers(min_length, min_exponent)
    for at in range(0, len(codes), SLICE):
        catchers.append(codes[at : at + SLICE])
    return catchers.runs()


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text per row.

    Words are runs of anything but U+0020 and U+0009 to U+000D.  A run is reported with its smallest
    period if it has at least ``min_length`` words and ``min_exponent`` periods.  The collapsed text has
    all words, joined by one blank, but those that lie in a run behind its first period.  A null text is
    empty: no words, no runs, collapsed to the empty string.  A null doc_id stays null, repeated rows are
    rows of their own, further columns are left out.
    """
    prepare_workers(docs.sparkSession, "4m")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, words, starts = word_codes(batch.column(1))
            kept = np.ones(len(codes), bool)
            found: list[list[dict]] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                runs = runs_of(codes[a:b], min_length, min_exponent)
                for start, length, period in runs:
                    kept[a + start + period : a + start + length] = False
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            left = np.concatenate(([0], np.cumsum(kept)))[starts]
            texts = pa.array(words, pa.string()).take(pa.array(codes[kept])) if words else pa.array([], pa.string())
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), texts), " ")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(starts), pa.int64()), pa.array(found, pa.list_(RUN)), collapsed],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    added = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    out = StructType([docs.schema["doc_id"], *StructType.fromDDL(added)])
    return docs.select("doc_id", "text").mapInArrow(run, out)


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in the texts whose crc32(doc_id as text) is divisible by ten.

    With h that checksum, g = h div 10 and n words, words from a = g mod n on repeat the first
    1 + (n - a) div (3 + g mod 8) of them.  Texts without words and rows without doc_id stay.
    """
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g, a, p = (F.col(c) for c in ("_n", "_g", "_a", "_p"))
    shaped = (
        docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), F.floor(h / 10).alias("_g"))
        .withColumn("_n", F.size("_words").cast("bigint"))
        .withColumn("_a", F.when(n > 0, g % n).cast("int"))
        .withColumn("_p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    )
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", a + 1, p), times)), F.lit(1), (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), a), tail), " ")
    return shaped.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(looped(table(spark, sf_dir, "documents")))
    ordered = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("early"), (-r["period"]).alias("short")))
    best = F.col("_best")
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("_best", F.array_max(ordered)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-best["early"]).alias("start"),
        best["length"].alias("length"),
        (-best["short"]).alias("period"),
        F.floor(1000 * best["length"] / -best["short"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
