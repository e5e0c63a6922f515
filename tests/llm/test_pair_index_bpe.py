"""Own merges and decoding against the tokenizer library on the same file."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from journeyloom.llm import pair_index_bpe as bpe
from journeyloom.llm.common import slices, word_codes

STRANGE = [
    None, "", " \n\t ", "aaaa aaaaaaaaa aaa", "Hello, World's it's 'll THE <|endoftext|>x<|startoftext|> y12 don't're …!?!",
    "<|EndOfText|> <|endoftext|><|endoftext|>", "３ naïve Σας ΟΔΟΣ İstanbul ﬁ ½ é é ǅ ß ſ 日本語。テスト",
    "\x00\x1c\x1f a b​ ́x  y　z", "x" * 50_000, "word, " * 20_000, "🙂🙃 👩‍👩‍👧",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def random_text(rng):
    letters = "abcdeTHEthe  .,'!12\n\té́ñΣσß 日本<|>-" + chr(rng.randrange(0x20, 0x3000))
    return "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))


def merged_one_by_one(ranks, word):
    """The lowest rank of a word first, of equal ranks the leftmost."""
    word = list(word)
    while True:
        best = min(((ranks[p][0], k) for k, p in enumerate(zip(word, word[1:])) if p in ranks), default=None)
        if best is None:
            return word
        k = best[1]
        word[k : k + 2] = [ranks[word[k], word[k + 1]][1]]


def test_merges_equal_the_rule_applied_one_by_one():
    rng = random.Random(2)
    for _ in range(200):
        symbols, merges = [0, 1, 2], []
        for product in range(3, rng.randint(4, 14)):
            left, right = rng.choice(symbols), rng.choice(symbols)
            if all(m[:2] != (left, right) for m in merges):
                merges.append((left, right, product))
                symbols.append(product)
        ranks = {m[:2]: (r, m[2]) for r, m in enumerate(merges)}
        words = [[rng.randrange(3) for _ in range(rng.randint(1, 20))] for _ in range(20)]
        chain = np.array([s for w in words for s in [*w, -1]])
        expected = [s for w in words for s in [*merged_one_by_one(ranks, w), -1]]
        assert bpe.PairIndex(merges).merge(chain).tolist() == expected


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.PairIndex([(5, 0, 6), (0, 1, 5)])
    with pytest.raises(ValueError):
        bpe.PairIndex([(0, 1, 5), (1, 0, 5)])


def test_words_equal_the_library(library):
    rng = random.Random(4)
    encoder = bpe.WordEncoder(bpe.tokenizer_path(), known_bytes=100_000)
    for text in [t or "" for t in STRANGE] + [random_text(rng) for _ in range(3_000)]:
        codes, words, _ = word_codes(pa.array([text]))
        ids = encoder.of(words)
        flat = np.frombuffer(b"".join(ids[c] for c in codes), "<u4").tolist()
        assert flat == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.held <= 2_000_000


def test_query_equals_the_library(spark, tmp_path, library):
    rng = random.Random(6)
    texts = [(k, t) for k, t in enumerate(STRANGE)] + [(None, "no id"), (3, "again"), (3, "again")]
    texts += [(k, random_text(rng)) for k in range(100, 400)]
    rows = [(i, t, ["clash"], 7) for i, t in texts]
    ddl = "doc_id int, text string, ids array<string>, n_tokens int"
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/none/documents.parquet")
    expected = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        expected.append((doc_id, len(ids), *sha))
    got = [tuple(r) for r in bpe.op12_bpe_encoding(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert bpe.op12_bpe_encoding(spark, f"{tmp_path}/none").count() == 0


def test_decoding_passes_over_unknown_ids(spark, library):
    ids = library.encode("two words", add_special_tokens=False).ids
    rows = [(1, [ids[0], None, 49_408, -1, *ids[1:]]), (2, None), (3, [])]
    got = {r.doc_id: (r.ids, r.text) for r in bpe.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>")).collect()}
    assert got[1][1] == library.decode([ids[0], 49_408, *ids[1:]], skip_special_tokens=False) and got[2] == (None, "") and got[3] == ([], "")


def test_slices_cover_all_rows():
    column = pa.array(["a" * n for n in (5, 5, 0, 30, 1, 1)] + [None])
    cuts = list(slices(column, 10))
    assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and cuts[0][0] == 0 and cuts[-1][1] == 7 and len(cuts) > 2
    assert list(slices(pa.array([], pa.string()), 10)) == []
