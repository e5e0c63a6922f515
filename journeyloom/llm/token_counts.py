"""Token counts of a unigram tokenizer without its tokens.

Every blank is a word mark, and a text that does not begin with one gets one; a segment is a mark and what
follows up to the next.  All other white space stays in its segment.  Aho-Corasick lists the
vocabulary entries that end at each place of a word; dynamic programming keeps, per place, the best
score and the number of pieces on the way there.  Rules as in the tokenizer itself: scores add up
from the left in double precision; of equal scores the entry that starts first (the longest) stays; a
character without an entry of its own is unknown, at the least score minus ten, and counts its UTF-8
bytes where bytes are entries, else neighbouring unknown characters count as one piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from journeyloom.llm.common import prepare_workers, slices, table

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
MARK = "▁"
SLICE_BYTES = 4 << 20


def load_vocabulary(path: str | None = None) -> tuple[list[tuple[str, float]], int]:
    """Pieces with their scores, and the id of the unknown piece, of a model file."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())], model.unk_id()


class PieceCounter:
    """Counts pieces per segment; segments are remembered up to ``known_bytes``, then the memory begins anew."""

    # What one remembered segment costs besides its characters.
    ENTRY_BYTES = 160

    def __init__(self, pieces: list[tuple[str, float]], unknown: int, byte_fallback: bool = True, known_bytes: int = 48 << 20):
        import ahocorasick

        self.entries = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(pieces):
            if piece:
                self.entries.add_word(piece, (len(piece), score, k == unknown))
        self.entries.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.known_bytes, self.held, self.known = known_bytes, 0, {}

    def count(self, word: str) -> int:
        n = len(word)
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        reached = [False] * (n + 1)
        reached[0] = True
        ends: list[list[tuple[int, float, bool]]] = [[] for _ in range(n + 1)]
        for end, found in self.entries.iter(word):
            ends[end + 1].append(found)
        for end in range(1, n + 1):
            single = False
            for size, score, is_unknown in sorted(ends[end], key=lambda x: -x[0]):
                start = end - size
                single |= size == 1
                total = score + best[start]
                if not reached[end] or total > best[end]:
                    reached[end], best[end], unknown[end] = True, total, is_unknown
                    pieces[end] = pieces[start] + self._unknown_pieces(word[start:end], unknown[start]) if is_unknown else pieces[start] + 1
            if not single:
                total = self.unknown + best[end - 1]
                if not reached[end] or total > best[end]:
                    reached[end], best[end], unknown[end] = True, total, True
                    pieces[end] = pieces[end - 1] + self._unknown_pieces(word[end - 1], unknown[end - 1])
        return pieces[n]

    def _unknown_pieces(self, text: str, after_unknown: bool) -> int:
        return len(text.encode()) if self.bytes else int(not after_unknown)

    def of(self, segments: list[str]) -> np.ndarray:
        """Pieces of each segment, given without its mark."""
        if self.held > self.known_bytes:
            self.known, self.held = {}, 0
        out = [self.known.get(s) for s in segments]
        for k, n in enumerate(out):
            if n is None:
                segment = segments[k]
                out[k] = self.known[segment] = self.count(MARK + segment)
                self.held += self.ENTRY_BYTES + 4 * len(segment)
        return np.array(out, np.int64)


def _segments(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Segments of all texts as codes into a list of distinct ones, and where each text's segments begin."""
    lists = pc.split_pattern(pc.replace_substring(texts, MARK, " ").cast(pa.large_string()), " ")
    coded = lists.flatten().dictionary_encode()
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    # A text that begins with a blank begins with its own mark; an empty text has nothing.
    kept = np.ones(len(codes), bool)
    leading = starts[:-1][np.diff(starts) > 0]
    if "" in words:
        kept[leading[codes[leading] == words.index("")]] = False
    return codes[kept], words, np.concatenate(([0], np.cumsum(kept)))[starts]


def count_tokens(docs: DataFrame, path: str | None = None, byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_words, n_tokens per row; null and empty texts have none, repeated rows count alike.

    Words are runs of anything but U+0020 and U+0009 to U+000D; tokens are those of the whole text.  A null
    doc_id stays null, further columns are left out.
    """
    prepare_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(*load_vocabulary(path), byte_fallback)
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                texts = pc.fill_null(batch.column(1).slice(a, b - a), "")
                codes, segments, starts = _segments(texts)
                sums = np.concatenate(([0], np.cumsum(counter.of(segments)[codes])))
                n_words = pc.count_substring_regex(texts, r"[^\x20\x09-\x0D]+").cast(pa.int64())
                columns = [batch.column(0).slice(a, b - a), n_words, pa.array(np.diff(sums[starts]), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    out = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_words bigint, n_tokens bigint")])
    return docs.select("doc_id", "text").mapInArrow(run, out)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
