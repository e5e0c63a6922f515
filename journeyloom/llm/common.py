"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare_workers(spark: SparkSession, size: str = "8m") -> None:
    """Call before Python runs on executors.

    Arrow batches are cut by bytes, so very long texts do not pile up in one; and workers on this
    machine find the package where the driver found it (a cluster gets it by --py-files).
    """
    spark.conf.set(BATCH_BYTES, size)
    env = spark.sparkContext.environment
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH")) if x)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, which hands free memory back to the system when its partition is done.

    Workers are kept for later tasks; what their allocators hold back would count against the executor
    while other stages run.
    """

    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library than glibc

    return tidied


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words of all texts as codes into a list of distinct words, and where each text's words begin.

    Words are runs without ASCII white space (U+0020, U+0009 to U+000D); ``lower`` folds A-Z only.
    The offsets have one entry more than there are texts.
    """
    filled = pc.fill_null(texts, "")
    if lower:
        filled = pc.ascii_lower(filled)
    lists = pc.ascii_split_whitespace(filled.cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    if "" in (blank := dict.fromkeys(words)):
        # White space at either end of a text leaves an empty word there.
        none = list(blank).index("")
        kept = codes != none
        starts = np.concatenate(([0], np.cumsum(kept)))[starts]
        codes = codes[kept]
    return codes, words, starts


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column with about ``size`` bytes each, at least one row."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    bucket = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(column)]
    return ((a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a < b)


def spread(codes: np.ndarray, pieces: list[bytes], width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of 32-bit words, one per distinct code, laid out in the order of ``codes``.

    Returns the words and, for each code and the end, where its piece begins.
    """
    flat = np.frombuffer(b"".join(pieces), dtype="<u4")
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // width
    begins = np.concatenate(([0], np.cumsum(sizes)))
    each = sizes[codes]
    at = np.concatenate(([0], np.cumsum(each)))
    # Added in place: these arrays are the largest ones of a slice.
    index = np.repeat(begins[codes] - at[:-1], each)
    index += np.arange(at[-1])
    return flat[index], at


def summed_arrays(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums arrays of one length per ``part`` over all tasks: (lane, part, counts array<float or double>).

    Two rounds of adding leave eight lanes at most, whose arrays of fixed size come to the driver.
    """
    kind = "lane bigint, part bigint, counts array<double>"

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            cuts = batch.column(2).offsets.to_numpy()
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            for lane, part, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), cuts[:-1] - cuts[0], cuts[1:] - cuts[0]):
                key = (lane % 8, part)
                sums[key] = sums.get(key, 0.0) + values[a:b].astype(np.float64)
        for (lane, part), v in sums.items():
            flat = pa.ListArray.from_arrays(np.array([0, len(v)], np.int32), pa.array(v))
            yield pa.RecordBatch.from_arrays([pa.array([lane]), pa.array([part]), flat], ["lane", "part", "counts"])

    lanes = parts.repartition(64, "lane", "part").mapInArrow(add, kind).repartition(8, "lane").mapInArrow(add, kind)
    out: dict[int, np.ndarray] = {}
    for r in lanes.toLocalIterator():
        out[r["part"]] = out.get(r["part"], 0.0) + np.array(r["counts"])
    return out
