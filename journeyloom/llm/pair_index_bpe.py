"""Byte-pair encoding by an index of pair occurrences, and decoding.

The tokenizer file gives vocabulary, merges and special tokens.  A text is cut into words at white
space, which the tokenizer drops; a slice of texts has each distinct word once.  All words of a
slice lie in one chain of symbols with breaks between them, and every pair that has a rank is mapped to
all of its places in the chain.  Active ranks are applied in ascending order: a rank is merged
at all of its places, the pairs around them leave the chain, and the new pairs enter their own lists.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from journeyloom.llm.common import prepare_workers, slices, spread, table, word_codes

TOKENIZER = "word_bpe_49k.json"
SLICE_BYTES = 8 << 20
KNOWN_BYTES = 24 << 20
# What one remembered word costs besides its characters and ids.
_ENTRY_BYTES = 240


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is visible, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]


class PairIndex:
    """Merges of a vocabulary, applied to many words at once."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """``merges``: (left, right, product) by rank.  No product may take part in an earlier merge."""
        made: dict[int, int] = {}
        for rank, (left, right, product) in enumerate(merges):
            if product in made:
                raise ValueError(f"two merges make symbol {product}")
            made[product] = rank
        if any(made.get(side, -1) >= rank for rank, m in enumerate(merges) for side in m[:2]):
            raise ValueError("a product takes part in an earlier merge")
        self.merges = merges
        keys = np.array([left << 32 | right for left, right, _ in merges], np.int64)
        self._rank = np.argsort(keys)
        self._keys = keys[self._rank]

    def ranks(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """Ranks of pairs, -1 where there is none."""
        keys = left << 32 | right
        if not len(self._keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._rank[at], -1)

    def merge(self, symbol: np.ndarray) -> np.ndarray:
        """The final symbols of a chain of words, -1 behind each word; ``symbol`` is used up."""
        size = len(symbol)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        # A break makes the key negative, which no pair has.
        first = self.ranks(symbol[:-1], np.where(symbol[1:] < 0, -1, symbol[1:]))
        places: dict[int, list] = {}
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        groups = np.split(order, np.flatnonzero(np.diff(first[order])) + 1) if len(order) else []
        for group in groups:
            places[int(first[group[0]])] = [group]
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, product = self.merges[rank]
            lists = places.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            if left == right:
                at = np.unique(at)
            # Where another merge took one of the two, the pair is gone.
            at = at[symbol[at] == left]
            then = after[at]
            there = symbol[then] == right
            at, then = at[there], then[there]
            if left == right and len(at) > 1 and (at[1:] == then[:-1]).any():
                alone = _first_of_overlapping(at.tolist(), then.tolist())
                at, then = at[alone], then[alone]
            if not len(at):
                continue
            follows = after[then]
            symbol[at], symbol[then] = product, -2
            after[at], before[follows] = follows, at
            leads = before[at]
            right_of, left_of = symbol[follows], np.where(leads >= 0, symbol[leads], -1)
            fresh = np.concatenate((self.ranks(product, right_of), self.ranks(left_of, product)))
            found = np.flatnonzero(fresh >= 0)
            if not len(found):
                continue
            spots, fresh = np.concatenate((at, leads))[found], fresh[found]
            order = np.argsort(fresh, kind="stable")
            spots, fresh = spots[order], fresh[order]
            cuts = [0, *(np.flatnonzero(np.diff(fresh)) + 1).tolist(), len(fresh)]
            for rank, a, b in zip(fresh[cuts[:-1]].tolist(), cuts[:-1], cuts[1:]):
                if rank in places:
                    places[rank].append(spots[a:b])
                else:
                    places[rank] = [spots[a:b]]
                    heapq.heappush(active, rank)
        return symbol[symbol != -2]


def _first_of_overlapping(at: list[int], then: list[int]) -> list[int]:
    """Of pairs that share a symbol, the first one of two neighbours (as the merge goes from the left)."""
    kept, taken = [], -1
    for k, (a, b) in enumerate(zip(at, then)):
        if a != taken:
            kept.append(k)
            taken = b
    return kept


class WordEncoder:
    """Token ids of words without white space, as little-endian 32-bit numbers.

    A word of letters with full stops, commas and the like behind it is two steps of the
    tokenizer's own cut; every other word is brought into form and cut by the tokenizer's normalizer and
    pre-tokenizer.  Words are remembered up to ``known_bytes``; then the memory begins anew.
    """

    PLAIN_TAIL = ".,;:!?"

    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.index = PairIndex([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters])
        self.last = np.array([vocab[c + self.end] for c in letters])
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens are matched as they are")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.known_bytes, self.held, self.known = known_bytes, 0, {}

    def parts(self, word: str) -> list[bytes | int]:
        """UTF-8 of the pieces the tokenizer cuts a word into; special tokens by their id."""
        stem = word.rstrip(self.PLAIN_TAIL)
        tail, head = word[len(stem) :], stem.lower()
        # U+03A3 is folded by what stands around it in one library and not in the other.
        settled = stem.isascii() or (unicodedata.is_normalized("NFC", stem) and "Σ" not in stem)
        if stem.isalpha() and head.isalpha() and settled:
            return [head.encode(), tail.encode()] if tail else [head.encode()]
        out: list[bytes | int] = []
        for piece in self.cut.split(word) if self.special else [word]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                cut = self.split(self.normalize(piece))
                out += [bytes(self.byte_of[c] for c in letters) for letters, _ in cut if letters]
        return out

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, merged all together."""
        if not pieces:
            return []
        flat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        symbol = self.inner[flat]
        symbol[ends - 1] = self.last[flat[ends - 1]]
        symbol[ends] = -1
        done = self.index.merge(symbol)
        stops = np.flatnonzero(done < 0)
        ids, cuts = done[done >= 0].astype("<u4").tobytes(), (4 * (stops - np.arange(len(stops)))).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def of(self, words: list[str]) -> list[bytes]:
        if self.held > self.known_bytes:
            self.known, self.held = {}, 0
        out = list(map(self.known.get, words))
        open_at = [k for k, ids in enumerate(out) if ids is None]
        cuts = [self.parts(words[k]) for k in open_at]
        pieces = list(dict.fromkeys(p for cut in cuts for p in cut if isinstance(p, bytes)))
        coded = dict(zip(pieces, self._merged(pieces)))
        for k, cut in zip(open_at, cuts):
            out[k] = ids = b"".join(coded[p] if isinstance(p, bytes) else array("I", [p]).tobytes() for p in cut)
            self.known[words[k]] = ids
            self.held += _ENTRY_BYTES + 4 * len(words[k]) + len(ids)
        return out


@lru_cache(maxsize=1)
def _pieces(path: str) -> pa.Array:
    """The string of every id, null where there is none."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    strings = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    if spec["decoder"] is not None:
        raise ValueError("only tokenizers without a decoder are decoded")
    return pa.array([strings.get(i) for i in range(max(strings) + 1)], pa.string())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) per row, as the tokenizer gives them without special tokens around.

    Special tokens that stand in a text are tokens, as in the tokenizer.  A null text is empty, and
    a text without words has no ids.  A null doc_id stays null, repeated rows are rows of their own,
    further columns are left out.
    """
    prepare_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path or tokenizer_path())
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                codes, words, starts = word_codes(batch.column(1).slice(a, b - a))
                flat, at = spread(codes, encoder.of(words))
                ids = pa.ListArray.from_arrays(pa.array(at[starts], pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["doc_id", "ids"])

    out = StructType([docs.schema["doc_id"], *StructType.fromDDL("ids array<int>")])
    return docs.select("doc_id", "text").mapInArrow(run, out)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text per row of (doc_id, ids).

    The file has no decoder, so a text is the strings of its tokens with one blank between them, special
    tokens included.  Ids the vocabulary lacks and null ids are passed over; null ids lists give
    the empty text.
    """
    prepare_workers(encoded.sparkSession, "4m")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _pieces(path or tokenizer_path())
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.array([[]], pa.list_(pa.int32()))[0])
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = lists.flatten()
            known = pc.fill_null(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(strings))), False)
            names = strings.take(pc.if_else(known, ids, None))
            kept = names.is_valid().to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.cumsum(kept)))[starts]
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), names.drop_null()), " ")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], text], ["doc_id", "ids", "text"])

    out = StructType([*encoded.select("doc_id", "ids").schema, *StructType.fromDDL("text string")])
    return encoded.select("doc_id", "ids").mapInArrow(run, out)


def op12_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
