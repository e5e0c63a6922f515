"""Jaccard join of word shingles by chosen paths.

Equal shingle sets are one class with one representative.  A set is known by its min-hash tokens
(coordinate, smallest hash).  A run sends every set down a tree: a node picks a few coordinates by a
hash of its path, and a set goes to the child of each token it has there.  Small nodes are compared
all against all on the signatures, crowded ones are split again, and what is still crowded at the
last level is compared in pairs of blocks.  Runs repeat until the chance to meet reaches ``recall``.

Nodes yield a forest of likely pairs, never the pairs.  Its connected parts are then verified on the
whole shingle sets, every set in one part once; parts too large for a task go in pairs of blocks.
Links are counted where they are verified; only counts and a forest leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from journeyloom.llm.common import prepare_workers, table, tidy, word_codes
from journeyloom.sources.workspace import settle


@dataclass(frozen=True)
class Join:
    words: int = 5
    similarity: float = 0.8
    recall: float = 0.995
    coordinates: int = 64
    picks: int = 2  # coordinates a node picks
    levels: int = 3
    node_rows: int = 512  # compared all against all
    slack: float = 0.15  # a pair is likely if that much less than ``similarity`` of the signature agrees

    @property
    def runs(self) -> int:
        meet = 1.0
        for _ in range(self.levels):
            meet = 1 - (1 - self.similarity * meet) ** self.picks
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - meet)))


_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every bit depends on every other."""
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 48-bit hashes of the runs of ``words`` words (A-Z folded); shorter texts are one run."""
    codes, vocabulary, starts = word_codes(texts, lower=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))[codes]
    n = len(hashes)
    runs = np.zeros(n, np.uint64)
    for k in range(words):
        factor = mixed(np.array([k + 1], np.uint64))[0] | np.uint64(1)
        runs[: max(n - k, 0)] += mixed(hashes[k:] ^ factor) * factor
    runs = mixed(runs) >> np.uint64(16)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            short = mixed(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes())], np.uint64))
            out.append(short >> np.uint64(16))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pack_set(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_set(body: bytes) -> np.ndarray:
    wide = np.zeros((len(body) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Min-hash values (32 bits) per set and coordinate; empty sets have the largest value throughout."""
    out = np.full((len(sets), coordinates), 0xFFFFFFFF, np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full])
        cuts = np.concatenate(([0], np.cumsum([len(sets[k]) for k in full])))[:-1]
        seeds = mixed(np.arange(1, coordinates + 1, dtype=np.uint64))
        for c in range(coordinates):
            hashed = (flat ^ seeds[c]) * (_C1 + np.uint64(2 * c))
            out[full, c] = np.minimum.reduceat((hashed >> np.uint64(32)).astype(np.uint32) ^ (hashed >> np.uint64(13)).astype(np.uint32), cuts)
    return out


SETS = "uid bigint, doc_id bigint, k1 bigint, k2 bigint, n int, signature binary, body binary"


def described(docs: DataFrame, join: Join) -> DataFrame:
    """One row per document: a row id, the key of its shingle set, signature and set."""
    prepare_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingle_sets(batch.column(1), join.words)
                signed = signatures(sets, join.coordinates)
                key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16) for s in sets]
                number = lambda part: [int.from_bytes(k[part : part + 8], "little", signed=True) for k in key]
                columns = [
                    pa.array(uid + np.arange(batch.num_rows)),
                    batch.column(0).cast(pa.int64()),
                    pa.array(number(0), pa.int64()),
                    pa.array(number(8), pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([row.tobytes() for row in signed], pa.binary()),
                    pa.array([pack_set(s) for s in sets], pa.binary()),
                ]
                uid += batch.num_rows
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SETS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SETS)


def descend(nodes: DataFrame, join: Join) -> DataFrame:
    """(uid, signature, path) to the children of each node: ``path`` of every token at the picked coordinates."""
    size, picks = join.coordinates, join.picks

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, size)
            path = batch.column(2).to_numpy().view(np.uint64)
            rows, paths = np.arange(batch.num_rows), []
            for k in range(picks):
                # Picks of a node differ: they lie in different parts of the coordinates.
                wide = size // picks
                at = k * wide + (mixed(path + np.uint64(k + 1)) % np.uint64(wide)).astype(np.int64)
                token = (at.astype(np.uint64) << np.uint64(32)) | signed[rows, at].astype(np.uint64)
                paths.append(mixed(path ^ mixed(token)).view(np.int64))
            again = np.tile(rows, picks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(again)), batch.column(1).take(pa.array(again)), pa.array(np.concatenate(paths))], ["uid", "signature", "path"]
            )

    return nodes.select("uid", "signature", "path").mapInArrow(tidy(run), "uid bigint, signature binary, path bigint")


def by_group(work: Callable[[list[tuple[list, ...]]], list[tuple]], kinds: list[pa.DataType], names: list[str]):
    """Streams rows sorted by their first column and hands over one whole group after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [], []

        def table_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != last:
                    if len(held) > 1:
                        out += work(held)
                    last, held = row[0], []
                held.append(row)
            if len(out) > 20_000:
                yield table_of()
                out.clear()
        if len(held) > 1:
            out += work(held)
        if out:
            yield table_of()

    return run


def parts_of(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each row's connected part, for a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def paired_blocks(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of a crowded ``key`` in pairs of blocks (``_group``, ``_side``: first, second or both); others in one group."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    dealt = rows.join(sizes, key).withColumn("_blocks", F.ceil(F.col("_n") / most).cast("int"))
    mine = F.pmod(F.xxhash64("uid", F.lit(1)), F.col("_blocks")).cast("int")
    dealt = dealt.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    side = F.when(F.col("_mine") == F.col("_other"), 0).when(F.col("_mine") < F.col("_other"), 1).otherwise(2)
    return dealt.withColumn("_group", F.concat_ws("/", F.col(key).cast("string"), low, high)).withColumn("_side", side)


def likely_forest(representatives: DataFrame, join: Join) -> DataFrame:
    """(a, b): edges of forests over pairs whose signatures mostly agree, from all runs and nodes."""
    least = math.ceil((join.similarity - join.slack) * join.coordinates)
    roots = F.array(*[F.lit(1_000_003 * (r + 1)).cast("bigint") for r in range(join.runs)])
    nodes = descend(representatives.where("n > 0").select("uid", "signature", F.explode(roots).alias("path")), join)
    ready = None
    for level in range(1, join.levels + 1):
        nodes = settle(nodes, "nodes")
        last = level == join.levels
        sizes = nodes.groupBy("path").agg(F.count("*").alias("_n")).where("_n > 1")
        if not last:
            crowded = settle(sizes.where(F.col("_n") > join.node_rows).select("path"), "crowded_nodes")
            small = nodes.join(crowded, "path", "left_anti")
        else:
            small = nodes
        ready = small if ready is None else ready.unionByName(small)
        if last or crowded.isEmpty():
            break
        nodes = descend(nodes.join(crowded, "path"), join)

    def compare(rows: list[tuple]) -> list[tuple]:
        uid, side = [r[1] for r in rows], np.array([r[2] for r in rows])
        signed = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(len(rows), -1)
        if len(rows) == 2:
            return [(uid[0], uid[1])] if (signed[0] == signed[1]).sum() >= least and side[0] + side[1] in (0, 3) else []
        agree = np.zeros((len(rows), len(rows)), np.uint8)
        for c in range(signed.shape[1]):
            agree += signed[:, c][:, None] == signed[:, c][None, :]
        linked = (agree >= least) & ((side[:, None] + side[None, :] == 3) | ((side[:, None] == 0) & (side[None, :] == 0)))
        label = parts_of(linked)
        return [(uid[k], uid[p]) for k, p in enumerate(label.tolist()) if p != k]

    grouped = paired_blocks(ready, "path", join.node_rows).select("_group", "uid", "_side", "signature")
    stream = grouped.repartition("_group").sortWithinPartitions("_group")
    return stream.mapInArrow(by_group(compare, [pa.int64(), pa.int64()], ["a", "b"]), "a bigint, b bigint").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(uid, part): smallest id reachable over ``edges`` (a, b), for every id that has one."""
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = settle(both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.col("a")).alias("part")), "labels")
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("uid").alias("b"), "part"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("part").alias("near"))
        low = label.join(near, "uid").select("uid", "part", F.least("part", "near").alias("low"))
        jump = label.select(F.col("uid").alias("low"), F.col("part").alias("further"))
        new = settle(low.join(jump, "low").select("uid", F.least("low", "further").alias("part"), (F.col("part") != F.least("low", "further")).alias("moved")), "labels")
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def _verify(join: Join):
    """Rows (group, uid, side, copies, body): links per row, and a forest of the links."""
    share = join.similarity

    def links(rows: list[tuple]) -> list[tuple]:
        uid, side, copies = [r[1] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        sets = [unpack_set(r[4]) for r in rows]
        size = np.array([len(s) for s in sets])
        common = np.zeros((len(rows), len(rows)))
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(rows)), size)
        _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
        seen = np.flatnonzero(often > 1)  # others are common to none
        place = np.full(len(often), -1)
        place[seen] = np.arange(len(seen))
        column = place[code]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for low in range(0, len(seen), 4096):
            a, b = np.searchsorted(column, (low, low + 4096))
            held = np.zeros((len(rows), min(4096, len(seen) - low)), np.float32)
            held[owner[a:b], column[a:b] - low] = 1
            common += held @ held.T
        # |A and B| >= s |A or B| without a division
        near = common * (1 + share) >= share * (size[:, None] + size[None, :]) - 1e-9
        np.fill_diagonal(near, False)
        near &= (side[:, None] + side[None, :] == 3) | ((side[:, None] == 0) & (side[None, :] == 0))
        label = parts_of(near)
        count, docs = near.sum(1), near @ copies
        return [(u, int(c), int(d), uid[p]) for u, c, d, p in zip(uid, count, docs, label.tolist()) if c]

    return by_group(links, [pa.int64()] * 4, ["uid", "links", "linked_docs", "parent"])


def jaccard_join(docs: DataFrame, join: Join = Join(), block_rows: int = 256) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, class_docs, n_links, n_linked_docs, group_id (starts jobs).

    A class holds the documents with equal shingle sets and is named by its smallest doc_id; texts
    without words are one class without links.  ``n_links`` counts other classes of at least
    ``similarity``, ``n_linked_docs`` their documents.  Groups are connected by links and named like
    classes.  Repeated rows are members of their class; a null doc_id stays null and names nothing
    unless its class has no other.  Further columns are ignored.
    """
    rows = settle(described(docs, join), "shingle_sets")
    named = rows.groupBy("k1", "k2").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("class_id"), F.count("*").alias("class_docs"))
    classes = settle(named, "classes")
    representatives = rows.select("uid", "n", "signature").join(classes.select("uid"), "uid", "left_semi")
    forest = settle(likely_forest(representatives, join), "likely_forest")
    likely = components(forest)
    members = rows.select("uid", "body").join(likely, "uid").join(classes.select("uid", F.col("class_docs").alias("copies")), "uid")
    grouped = paired_blocks(members, "part", block_rows).select("_group", "uid", "_side", "copies", "body")
    stream = grouped.repartition("_group").sortWithinPartitions("_group")
    verified = settle(stream.mapInArrow(_verify(join), "uid bigint, links bigint, linked_docs bigint, parent bigint"), "verified")
    counted = verified.groupBy("uid").agg(F.sum("links").alias("n_links"), F.sum("linked_docs").alias("n_linked_docs"))
    group = components(verified.where("uid <> parent").select(F.col("uid").alias("a"), F.col("parent").alias("b")))
    held = classes.join(counted, "uid", "left").join(group, "uid", "left").withColumn("part", F.coalesce("part", "uid"))
    names = held.groupBy("part").agg(F.min("class_id").alias("group_id"))
    facts = held.join(names, "part").select(
        "k1", "k2", "class_id", "class_docs", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_linked_docs", F.lit(0)).alias("n_linked_docs"), "group_id"
    )
    return rows.select("doc_id", "k1", "k2").join(facts, ["k1", "k2"]).drop("k1", "k2")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
