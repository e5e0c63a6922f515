"""The pipeline's stages on planted cases, and the registration of the corpus queries."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from test_operators import DOC, prose


def _planted(spark, folder):
    rng = random.Random(17)
    items = [prose(rng, 40).replace("\n", " ") + "." for _ in range(3)]
    passage = prose(rng, 90)
    texts = {k: prose(rng, rng.randint(40, 160)) for k in range(160)}
    toxic = set(range(0, 160, 8))
    for k in toxic:
        words = texts[k].split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(("blarg", "snork", "zwibsen")))
        texts[k] = " ".join(words)
    near = {200: texts[1].split(), 201: texts[1].split()}
    near[200][10] = "swapped"
    near[201][-5] = "altered"
    texts |= {k: " ".join(w) for k, w in near.items()}
    texts |= {210: f"{prose(rng, 50)}\n{passage}\n{prose(rng, 60)}", 211: f"{prose(rng, 70)}\n{passage}\n{prose(rng, 30)}"}
    texts |= {220 + k: f"{prose(rng, 60)} {item} {prose(rng, 60)}" for k, item in enumerate(items)}
    texts |= {230: None, 231: "", 232: "blarg snork, zwibsen you blarg"}
    rows = [(k, t, "xx", "s", None if t is None else len(t)) for k, t in texts.items()] + [(None, "a text without an id", "xx", "s", 20)]
    spark.createDataFrame(rows, DOC).withColumn("_doc", F.lit("clash")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(160)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts, toxic, passage


def test_stages_on_planted_cases(spark, tmp_path):
    folder = f"file://{tmp_path}"
    texts, toxic, passage = _planted(spark, folder)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {k for k in range(160) if k not in toxic}
    assert clean | {200, 201, 210, 211, 220, 221, 222, 230, 231, None} == set(kept["toxicity"])
    assert set(kept["line_dedup"]) == set(kept["toxicity"])
    held = [k for k, t in kept["line_dedup"].items() if t and passage in t]
    assert held == [210] and kept["line_dedup"][1] == texts[1] and len(kept["line_dedup"][211]) < len(texts[211]) - 300
    # A null text has no words, as an empty one: the smaller id stays.
    assert clean | {None, 210} <= set(kept["jaccard_join"]) and 231 not in kept["jaccard_join"]
    assert not {220, 221, 222} & set(kept["decontaminate"]) and clean | {None, 210, 211} <= set(kept["decontaminate"])
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, docs, folder).collect()
    assert {r["doc_id"] for r in packed} == set(kept["decontaminate"])


def test_whole_run_and_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    _planted(spark, folder)
    assert corpus_pipeline.run(spark, folder).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{folder}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
