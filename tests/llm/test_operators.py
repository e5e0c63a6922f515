"""Corpus operators against brute force, round trips and planted cases, and on awkward rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from journeyloom.llm import decontaminate, hmm_lm, jaccard_join, line_dedup, near_vectors, packing, token_counts, toxicity, url_filters, warc_bundles

WORDS = [a + b for a in ("sun", "tor", "mel", "ka", "rid", "pon") for b in ("da", "fel", "gor", "it", "umb", "es", "ola")]
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, words: int) -> str:
    out = []
    for k in range(words):
        word = rng.choice(WORDS) + rng.choice(("", "", rng.choice(WORDS)))
        out.append(word + rng.choice(("", "", "", ",", ".")) + ("\n" if rng.random() < 0.05 else " "))
    return "".join(out).strip()


def frame(spark, texts):
    rows = [(i, t, "xx", "s", len(t) if t is not None else None) for i, t in texts]
    return spark.createDataFrame(rows, DOC)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id at all here"), (4, "one"), (4, "one"), (5, "\u0001\u0002 \u0001x\u0003 \x1c a b"), (6, "word " * 30000)]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- 1 ------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a/", "x" * 10), (2, None, "x" * 10), (7, "http://b/\r\nX: 1", "é" * 3_000_000), (3, "u", None), (4, "u", ""), (None, "u", "x" * 10)],
        "page_id bigint, url string, html string",
    )
    layout = warc_bundles.BundleLayout(frame_bytes=50, bundle_bytes=60)
    index = warc_bundles.archive_pages(pages, f"file://{tmp_path}/w", layout)
    got = {r["record_id"]: r for r in warc_bundles.read_records(index).collect()}
    assert {k: (v["record_type"], v["refers_to"]) for k, v in got.items()} == {
        "1": ("revisit", "2"), "2": ("response", None), "": ("revisit", "2"), "7": ("response", None), "3": ("revisit", "4"), "4": ("response", None),
    }
    body = ("é" * 3_000_000).encode()
    assert bytes(got["7"]["payload"]) == body and got["7"]["payload_bytes"] == len(body)
    assert got["7"]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert got["1"]["payload_bytes"] == 10 and got["1"]["payload"] is None
    # Any record through the seek table alone, and every bundle as one plain stream.
    for r in index.collect():
        frame_ = warc_bundles.BundleReader(r["bundle"]).frame(r["frame"])
        assert frame_[r["offset"] :].startswith(b"WARC/1.1") and len(frame_) >= r["offset"] + r["length"]
    assert warc_bundles.read_records(warc_bundles.archive_pages(pages.where("false"), f"file://{tmp_path}/e")).count() == 0


# ---- 2 ------------------------------------------------------------------------------------------


def test_decontamination_finds_exact_and_paraphrased_items(spark):
    rng = random.Random(3)
    items = [(k, prose(rng, rng.randint(20, 50)).replace("\n", " ") + ".") for k in range(12)]
    texts = [(k, prose(rng, rng.randint(60, 400))) for k in range(120)]
    texts += [(1000 + k, f"{prose(rng, 100)} {items[k][1]} {prose(rng, 80)}") for k in range(12)]
    soft = []
    for k in range(12):
        words = items[k][1].split()
        for at in range(4, len(words) - 3, 8):
            words[at] = "changed"
        soft.append((2000 + k, f"{prose(rng, 70)} {' '.join(words)} {prose(rng, 90)}"))
    docs = frame(spark, texts + soft + [r for r in AWKWARD if r[0] != 6])
    bench = spark.createDataFrame(items + [(50, None), (51, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1000 + k, k) for k in range(12)} | {(2000 + k, k) for k in range(12)}
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_decontamination_does_not_hang_on_the_cosine(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, n).replace("\n", " ")) for k, n in enumerate((1, 2, 3, 9, 17, 22, 31, 70))]
    items[0], items[1] = (0, "solitary"), (1, "two together")
    docs = frame(spark, [(k, f"{prose(rng, 57)} {item} {prose(rng, 61)}") for k, item in items] + [(90, prose(rng, 200)), (91, None)])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contaminated(docs, bench, decontaminate.Retrieval(cosine=1.1)).collect()
    assert {(k, k, 1.0) for k, _ in items} <= {(r["doc_id"], r["item_id"], r["overlap"]) for r in found}
    assert not {90, 91} & {r["doc_id"] for r in found}


def test_common_length():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 20))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common_length(decontaminate._bits(a), len(a), b) == best[-1][-1]


class Streams:
    """Stands for a frame of word streams; what would run in tasks is kept."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_search_follows_only_words_an_item_has(monkeypatch):
    rng = random.Random(8)
    r, streams = decontaminate.Retrieval(), Streams()
    space = np.random.default_rng(8).standard_normal((r.terms, r.rank)).astype(np.float32)
    item = [f"item{k}" for k in range(40)]
    text = [f"text{rng.randrange(10**6)}" for _ in range(400)]
    text[100:160] = [w for k, w in enumerate(item) for w in ([w, "between"] if k % 2 else [w])]
    words = np.array([decontaminate.word_hash(w) for w in text], "<u4")
    items = decontaminate.Items([(1, " ".join(item)), (2, " \t"), (3, None)], space, r)
    decontaminate.search(streams, items, space, r)
    followed, plain = [], decontaminate.common_length
    monkeypatch.setattr(decontaminate, "common_length", lambda bits, size, words: followed.append((bits, list(words))) or plain(bits, size, words))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([words.tobytes(), b""], pa.binary())], ["doc_id", "words"])
    found = [(x["doc_id"], x["item_id"], x["overlap"]) for b in streams.run([batch]) for x in b.to_pylist()]
    assert found == [(7, 1, 1.0)]
    assert all(w in bits for bits, words in followed[::2] for w in words)
    decontaminate.search(streams, decontaminate.Items([(2, None)], space, r), space, r)
    assert sum(b.num_rows for b in streams.run([batch])) == 0


def test_row_sums():
    values = np.vstack([np.random.default_rng(0).random((9, 3)), np.zeros((1, 3))])
    sizes, rows = np.array([2, 4, 1]), np.array([3, 3, 0, 8, 1, 5, 7])
    want = [values[rows[a:b]].sum(0) for a, b in ((0, 2), (2, 6), (6, 7))]
    assert np.allclose(decontaminate._row_sums(values, sizes, rows, 4), want)


# ---- 3 ------------------------------------------------------------------------------------------


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("node_rows,block_rows", [(512, 256), (6, 5)])
def test_jaccard_join_equals_brute_force(spark, node_rows, block_rows):
    rng = random.Random(5)
    texts = [(k, prose(rng, rng.randint(1, 120))) for k in range(60)]
    base = prose(rng, 150).split()
    for k in range(30):  # a group of near copies at all distances
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "other"
        texts.append((100 + k, " ".join(words)))
    texts += [(200, texts[0][1]), (201, texts[0][1].upper()), (202, "")] + [r for r in AWKWARD if r[0] is not None]
    docs = frame(spark, texts).withColumnRenamed("lang", "uid")
    join = jaccard_join.Join(recall=0.9999, node_rows=node_rows)
    got = {(r["doc_id"], r["class_id"], r["n_links"], r["n_linked_docs"], r["class_docs"]) for r in jaccard_join.jaccard_join(docs, join, block_rows).collect()}
    classes = collections.defaultdict(list)
    for d, t in texts:
        classes[shingles(t)].append(d)
    links = {a: [b for b in classes if a and b and a != b and len(a & b) / len(a | b) >= 0.8] for a in classes}
    assert got == {(d, min(classes[s]), len(links[s]), sum(len(classes[b]) for b in links[s]), len(classes[s])) for d, t in texts for s in [shingles(t)]}
    assert jaccard_join.jaccard_join(docs.where("false")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 101)], "a bigint, b bigint")
    got = {r["uid"]: r["part"] for r in jaccard_join.components(edges).collect()}
    assert got == {k: 0 for k in range(21)} | {100: 100, 101: 100}


# ---- 4 ------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for k in range(400):
        words, bad = prose(rng, rng.randint(20, 120)).split(), k % 4 == 0
        if bad:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(("blarg", "Snork!", "zwibsen", "zwibster")))
        texts.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs = frame(spark, texts + [(10_001, None), (10_002, ""), (10_003, "fine " * 20000), (10_004, "you blarg, blarg snork")])
    held = [d for d, _ in texts if zlib.crc32(str(d).encode()) % 5 == 0]
    table = spark.createDataFrame([x for x in labels if x[0] not in held] + [(3, None)], "doc_id bigint, toxic int")
    chain = toxicity.train(docs, table)
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs.select("doc_id", "text"), chain).collect()}
    truth = dict(labels)
    assert sum((got[d]["score"] >= 0.5) == bool(truth[d]) for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[10_001]["score"] == got[10_002]["score"] < 0.5
    assert got[10_003]["score"] < 0.5 <= got[10_004]["score"]
    a, b = map(int, got[10_004]["spans"].split(";")[0].split("-"))
    assert got[10_004]["text"][a:b] == "blarg, blarg snork"
    nothing = toxicity.train(docs, table.where("false"))
    assert toxicity.score_texts(docs.select("doc_id", "text"), nothing).where("score >= 0.5").count() == 0


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    move, start, scores = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=7)
    lanes = hmm_lm.Lockstep([np.arange(3), np.arange(4)])
    p, _, _, log_z = toxicity.marginals(lanes, scores, start, move)
    want, total = [], 0.0
    for part in (scores[:3], scores[3:]):
        z, share = 0.0, np.zeros(len(part))
        for y in itertools.product((0, 1), repeat=len(part)):
            w = math.exp(start[y[0]] + sum(s for s, v in zip(part, y) if v) + sum(move[a, b] for a, b in zip(y, y[1:])))
            z += w
            share += w * np.array(y)
        want += (share / z).tolist()
        total += math.log(z)
    assert np.allclose(p, want) and math.isclose(log_z, total)
    neutral = toxicity.Neutral(toxicity.Chain({}, 0.3, move, start, np.zeros(6)))
    flat = toxicity.marginals(hmm_lm.Lockstep([np.arange(5)]), np.full(5, 0.3), start, move)[0]
    assert np.allclose(neutral.of(5), (flat.max(), flat.sum()))


# ---- 5 ------------------------------------------------------------------------------------------


def test_url_filter(spark):
    pages = [
        (1, "http://A.example.org/es/x?q", ""), (2, "https://example.org", None), (3, "http://notexample.org/es/", ""), (4, None, "x"), (5, "mailto:a", "x"),
        (6, "http://bad.net/p", '<a href="http://x.example.org/es/1">'), (7, "http://good.net#/fr/", "see HTTP://q"), (8, "http://s.org/", '<a href="//good.net/1"> and bad.com'),
        (9, "http://x.example.org/es/1", ""), (10, "http://x.com/de/1", ""), (11, "http://x.com/fr/1", ""), (9, "http://x.example.org/es/1", ""),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumnsRenamed({}).selectExpr("*", "1 AS host", "2 AS rule")
    got = {r["page_id"]: r for r in url_filters.judge_pages(df).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2]["host"], got[2]["path"], got[2]["rule"], got[2]["verdict"]) == ("example.org", "", None, "allow")
    assert got[3]["rule"] == "org/" and got[3]["verdict"] == "allow"
    assert (got[4]["host"], got[4]["path"], got[5]["host"]) == ("", "", "") and got[4]["verdict"] == "allow"
    assert got[6]["verdict"] == "block" and got[6]["distrust"] > 0  # it links to a blocked host
    assert (got[7]["path"], got[7]["verdict"]) == ("", "allow") and got[7]["trust"] > 0
    assert got[10]["rule"] == "com/de/" and got[11]["rule"] == "com/fr/"
    assert url_filters.judge_pages(df.where("false")).count() == 0
    plan = url_filters.judge_pages(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 6 ------------------------------------------------------------------------------------------


def test_language_model_counts_and_likelihood(spark):
    rng = random.Random(4)
    # Two languages that share no word: something for states to find, which single words are not.
    texts = [(k, prose(rng, rng.randint(1, 80))) for k in range(200)]
    texts = [(k, re.sub(r"\b(?=\w)", "q", t) if k % 2 else t) for k, t in texts] + AWKWARD[:-1]
    out = hmm_lm.score_documents(frame(spark, texts), states=3, rounds=5).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\n"]) for d, t in texts]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    count = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    want = collections.Counter(
        (d, held(d), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in tokens
    )
    assert collections.Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in out) == want
    mine, base = (sum(r[c] for r in out if r["held_out"]) for c in ("score", "base_score"))
    assert all(r["score"] < 0 for r in out) and mine > base
    assert hmm_lm.score_documents(frame(spark, texts).where("false")).count() == 0
    none = hmm_lm.score_documents(frame(spark, [(d, t) for d, t in texts if held(d)])).collect()
    assert none and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)


def test_forward_recursion_and_expected_counts_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    unigram = rng.random(9)
    model = hmm_lm.Model.initial(unigram / unigram.sum(), 3)
    sequences = [rng.integers(0, 9, n) for n in (1, 4, 3, 6, 1)]
    moves, logs = np.zeros((3, 3)), []
    for s in sequences:
        total, part = 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=len(s)):
            w = model.start[path[0]] * model.emit[s[0], path[0]]
            for k in range(1, len(s)):
                w *= model.move[path[k - 1], path[k]] * model.emit[s[k], path[k]]
            total += w
            for a, b in zip(path, path[1:]):
                part[a, b] += w
        logs.append(math.log10(total))
        moves += part / total
    assert np.allclose(hmm_lm.log10_likelihood(sequences, model), logs)
    better = model
    for _ in range(4):  # plain Baum-Welch steps never lose likelihood
        a, b, c = hmm_lm.expected_counts(sequences, better)
        new = hmm_lm.Model(a / a.sum(), b / b.sum(1, keepdims=True), c / c.sum(0))
        assert hmm_lm.log10_likelihood(sequences, new).sum() >= hmm_lm.log10_likelihood(sequences, better).sum() - 1e-9
        better = new
    start, got, emits = hmm_lm.expected_counts(sequences, model)
    assert np.allclose(got, moves) and math.isclose(start.sum(), 5) and math.isclose(emits.sum(), 15)


# ---- 7 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_equal_the_tokenizer(spark, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, unknown = token_counts.load_vocabulary()
    exact = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=fallback))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    rng = random.Random(8)
    texts = [(k, prose(rng, 60)) for k in range(30)] + AWKWARD + [(92, "a\nb  c\td"), (93, "  x\r\n\n y "), (94, "▁"), (95, " ▁ "), (90, "日本語 🎉🎉x a\x00b ▁▁x <unk> <s> <0x41> ​" + "z" * 5000)]
    clash = [(i, t, 7, "n") for i, t in texts]
    docs = spark.createDataFrame(clash, "doc_id int, text string, n_tokens int, n_words string")
    rows = token_counts.count_tokens(docs, byte_fallback=fallback).collect()
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in rows)
    assert {(r["doc_id"] or -1, r["n_words"]) for r in rows} == {(d or -1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t in texts}
    assert got == sorted((d or -1, len(exact.encode(t or "").ids)) for d, t in texts)
    assert token_counts.count_tokens(docs.where("false")).count() == 0


# ---- 8 ------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(2)
    texts = [(k, prose(rng, rng.randint(1, 300))) for k in range(80)] + AWKWARD + [(91, "don't ΣΑΣ. İi é́., <|endoftext|> a.,b 12ab,")]
    pieces = packing.pack_documents(frame(spark, texts), capacity=256).collect()
    want = collections.Counter()
    for d, t in texts:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            cut = ids[at : at + 256]
            want[d, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in pieces) == want
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *[n for _, n in held]])[:-1].tolist() and sum(n for _, n in held) <= 256
    assert len(bins) <= -(-sum(r["length"] for r in pieces) // 256) + 1
    assert packing.pack_documents(frame(spark, texts).where("false")).count() == 0


def test_packing_holds_little_of_a_batch_at_once():
    import tracemalloc

    from journeyloom.llm.common import spread

    pieces = [np.arange(k % 5, dtype="<u4").tobytes() for k in range(1000)]
    codes = np.arange(2_000_000, dtype=np.int32) % 1000
    tracemalloc.start()
    flat, at = spread(codes, pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert flat[:10].tolist() == [0, 0, 1, 0, 1, 2, 0, 1, 2, 3] and at[-1] == len(flat) == 4_000_000
    # 96 MB; 112 MB were held here when a third list was made of two.
    assert peak < 26 * len(flat)
    # Words and ids of a batch of 8 MB are not all held at once.
    assert packing.SLICE_BYTES * 4 <= 8 << 20


def test_fullest_combination_is_the_best_one():
    import itertools

    rng = random.Random(6)
    for _ in range(40):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room, order = rng.randint(1, 60), sorted(counts, reverse=True)
        best = max(s for s in (sum(x * k for x, k in zip(order, c)) for c in itertools.product(*[range(counts[x] + 1) for x in order])) if s <= room)
        chosen = packing.fullest(counts, order, room)
        assert sum(x * k for x, k in chosen) == best and all(k <= counts[x] for x, k in chosen)


# ---- 9 ------------------------------------------------------------------------------------------


def plain_chunks(text: str | None) -> list[str]:
    """The cut into chunks, written once more in plain Python."""
    lines = [u for u in re.split(r"(?<=\n)|(?<=[.!?,;:|] )", (text or "").replace("\u0001", "\u0001\u0003")) if u]
    hashes = [xxhash.xxh64_intdigest(u.encode(), 42) for u in lines]
    octets = lambda h: h.to_bytes(8, "little")
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    roll = [signed(xxhash.xxh64_intdigest(octets(h), xxhash.xxh64_intdigest(octets(hashes[k - 1]), 42) if k else 42)) for k, h in enumerate(hashes)]
    chunks: list[str] = []
    for k, line in enumerate(lines):
        low = k > 0 and roll[k] < min(roll[k - 1 : k] + roll[k + 1 : k + 2])
        if k == 0 or low or len(lines[k - 1].encode()) >= 16 or len(line.encode()) >= 48:
            chunks.append("")
        chunks[-1] += line
    return chunks


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(12)
    passage = prose(rng, 120)
    texts = [(k, f"{prose(rng, 80)}\n{passage}\n{prose(rng, 60)}" if k % 3 == 0 else prose(rng, 150)) for k in range(30)]
    texts += [(40, texts[1][1])] + AWKWARD
    docs = frame(spark, texts).withColumnRenamed("source", "_chunks")
    clean = line_dedup.dedup_lines(docs)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    plan = clean._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    cut = line_dedup.chunks_of(frame(spark, texts)).select("doc_id", "text", "_chunks").collect()
    free = lambda c: c.replace("\u0001\u0003", "\u0001")
    assert all("".join(map(free, r["_chunks"])) == (r["text"] or "") for r in cut)
    key = lambda d: 2**63 - 1 if d is None else d
    assert all(r["_chunks"] == plain_chunks(r["text"]) for r in cut)
    places = collections.defaultdict(set)
    number = collections.Counter()
    for r in cut:
        for k, c in enumerate(r["_chunks"]):
            places[c].add((key(r["doc_id"]), k))
            number[c] += 1
    want = collections.Counter()
    for r in cut:
        out, run = [], []
        for k, c in enumerate([*r["_chunks"], None]):
            if c is not None and number[c] > 1 and (key(r["doc_id"]), k) != min(places[c]):
                run.append(c)
                continue
            joined = "".join(run)
            out += [joined] if len(joined.split()) < 20 else []
            out += [c] if c is not None else []
            run = []
        want[r["doc_id"], None if r["text"] is None else free("".join(out))] += 1
    got = collections.Counter((r["doc_id"], r["text"]) for r in clean.collect())
    nulls = lambda c: collections.Counter({(d, t or ""): n for (d, t), n in c.items()})
    assert nulls(got) == nulls(want)
    windows = collections.Counter(tuple(t.split()[k : k + 60]) for (_, t) in got if t for k in range(len(t.split()) - 59) if "word" not in t)
    assert all(n == 1 for n in windows.values())
    assert (1, texts[1][1]) in got
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_line_dedup_cuts_texts_once(spark):
    rng = random.Random(13)
    passage = prose(rng, 120)
    texts = [(k, f"{prose(rng, 40)}\n{passage}\n") for k in range(6)] + [(6, None), (7, "")]
    docs = frame(spark, texts).selectExpr("n_chars as `a.b`", "text", "named_struct('x', source, 'y', array(doc_id)) as _rest", "doc_id")
    clean = line_dedup.dedup_lines(docs)
    # What is left to do reads the chunks: no text is split into lines again, none travels beside its chunks.
    plan = clean._jdf.queryExecution().toString()
    assert "(?<=" not in plan and "_text" not in plan
    assert clean.schema.simpleString() == docs.schema.simpleString()
    others = lambda rows: sorted((r["doc_id"], r["a.b"], r["_rest"]) for r in rows)
    rows = clean.collect()
    assert others(rows) == others(docs.collect())
    got = {r["doc_id"]: r["text"] for r in rows}
    assert got[0] == texts[0][1] and got[6] is None and got[7] == ""
    assert all(len(got[k]) < len(texts[k][1]) - len(passage) // 2 for k in range(1, 6))


@pytest.mark.parametrize("own_lines", [True, False])
def test_line_dedup_finds_passages_of_51_to_100_words(spark, own_lines):
    rng = random.Random(31)
    number = iter(range(10**6))

    def text(words: int) -> str:  # all words distinct; a line every six words
        return "".join(f"w{next(number)}" + (rng.choice((",", ".")) if k % 6 == 5 else "") + " " for k in range(words)).strip()

    texts, sizes = [], {}
    for k in range(400):
        passage, gap = text(rng.randint(51, 100)), ".\n" if own_lines else " "
        texts += [(2 * k + c, gap.join((text(rng.randint(20, 90)), passage, text(rng.randint(20, 90))))) for c in (0, 1)]
        sizes[2 * k + 1] = len(passage.split())
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    for doc, before in texts:
        lost = len(before.split()) - len(got[doc].split())
        assert lost == 0 if doc not in sizes else sizes[doc] - 20 <= lost <= sizes[doc], (doc, lost)


# ---- 10 -----------------------------------------------------------------------------------------


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = centres[rng.integers(0, 12, 1500)] + 0.5 * rng.normal(size=(1500, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(2000 + k, rows[40][1]) for k in range(60)] + [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [1.0, None]), (None, rows[0][1]), (3080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    import pyspark.sql.functions as F

    got = collections.defaultdict(list)
    for r in near_vectors.search_vectors(df, "vec_id", "embedding", F.col("id") % 20 == 0, near_vectors.Search(block_rows=40)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([i for i, v in rows if i is not None and i < 3000])
    matrix = np.array([v for i, v in rows if i is not None and i < 3000])
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        scores = (matrix * matrix[ids == q]).sum(1)
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))][:20]
        mine = sorted(got[q])
        assert [k for k, _, _ in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        assert all(math.isclose(s, scores[ids == i][0], rel_tol=1e-12) for _, i, s in mine)
        hit, total = hit + len(set(best) & {i for _, i, _ in mine}), total + 20
    assert set(got) == set(ids[ids % 20 == 0].tolist()) and hit >= 0.9 * total
    few = near_vectors.search_vectors(df.where("vec_id < 5"), "vec_id", "embedding", F.col("id") % 20 == 0).collect()
    assert len(few) == 4
    assert near_vectors.search_vectors(df.where("false"), "vec_id", "embedding", F.col("id") % 20 == 0).count() == 0


def test_near_vectors_come_once_to_a_lane(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))]
    search = near_vectors.Search(block_rows=40, lane_rows=100)
    sent, plain = spark.sparkContext.accumulator(0), near_vectors._rank_lanes

    def counting(k):
        run = plain(k)

        def counted(batches):
            def seen():
                for batch in batches:
                    sent.add(sum(batch.column(1).to_pylist()))
                    yield batch

            yield from run(seen())

        return counted

    monkeypatch.setattr(near_vectors, "_rank_lanes", counting)
    got = near_vectors.search_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding", F.col("id") % 20 == 0, search)
    assert got.count() == 15 * 20
    lanes = (1 + 300 // search.lane_rows) * search.tables
    assert 15 <= sent.value <= 15 * lanes


def test_probes_are_the_likeliest_buckets():
    h = near_vectors.Hashing(near_vectors.Search(), 6, 1000, 1.0)
    h.spread, h.success = 0.5, 0.97
    projection = h.project(np.random.default_rng(2).standard_normal((1, 6)), True)[0]
    width, got = h.search.width * h.spread, iter(h.probes(projection).tolist())
    for t in range(h.tables):
        buckets = [(1.0, int(h.base[t]))]
        for f in range(t * h.functions, (t + 1) * h.functions):
            below = lambda c: 0.5 * (1 + math.erf(((c - h.shift[f]) * width - projection[f]) / h.noise / math.sqrt(2)))  # noqa: B023, E731
            near = [math.floor((projection[f] + side * 4 * h.noise) / width + h.shift[f]) for side in (-1, 1)]
            buckets = [(p * (below(c + 1) - below(c)), code + c * int(h.mix[f])) for p, code in buckets for c in range(near[0], near[1] + 1)]
        total = 0.0
        for p, code in sorted(buckets, reverse=True):
            if total >= h.success:
                break
            total += p
            assert (code - next(got)) % 2**64 == 0
    assert next(got, None) is None
    # The same cells are another bucket in each table.
    h.directions, h.shift = np.zeros_like(h.directions), np.zeros_like(h.shift)
    assert len(set(h.keys(np.ones((1, 6)) / 9)[0].tolist())) == h.tables


def test_near_vectors_with_ties_and_copies(spark):
    """199 different vectors with one inner product, and few vectors with copies."""
    import pyspark.sql.functions as F

    rows = [(0, [1.0] + [0.0] * 9)] + [(k, [0.5] + [0.0] * (k % 9) + [float(k)] + [0.0] * (8 - k % 9)) for k in range(1, 200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = near_vectors.search_vectors(df, "vec_id", "embedding", F.col("id") == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(k, k, 0.5) for k in range(1, 21)]
    copies = [(2 * k + c, [float(k + 1), 1.0, float(-k)]) for k in range(15) for c in range(2)]
    df = spark.createDataFrame(copies, "vec_id bigint, embedding array<double>")
    got = near_vectors.search_vectors(df, "vec_id", "embedding", F.col("id") % 20 == 0).collect()
    for q in (0, 20):
        own = dict(copies)[q]
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in copies if i != q)[:20]
        assert [(r["rank"], r["vec_id"]) for r in sorted(got) if r["query_id"] == q] == [(k, i) for k, (_, i) in enumerate(best, 1)]


def test_items_without_a_sentence_do_not_end_the_search(spark):
    docs = frame(spark, [(1, "some words and nothing else of note here"), (2, "\u00a0 \u00a0")])
    items = spark.createDataFrame([(1, "\u00a0"), (2, "\u001c \u00a0"), (3, None)], "item_id bigint, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert all(r["doc_id"] == 2 for r in found)


def test_bundles_are_read_back_by_many_tasks(spark, tmp_path):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(concat('x', id), 30) AS html")
    index = warc_bundles.archive_pages(pages, f"file://{tmp_path}/w", warc_bundles.BundleLayout(frame_bytes=200, bundle_bytes=4_000))
    frames = index.select("bundle", "frame").distinct().count()
    records = warc_bundles.read_records(index)
    assert records.count() == 400
    assert frames > 64 and records.rdd.getNumPartitions() == 1 + frames // warc_bundles.FRAMES_A_TASK
