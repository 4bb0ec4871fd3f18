"""Embeddings, components and the pipeline."""

import math
import random

import numpy as np
from llm_cases import SCHEMA, odd_rows, prose
from pyspark.sql import functions as F

from parlance.llm import embedding_dedup
from parlance.llm.components import components


def vectors_by_hand(rows):
    ok = {k: i for k, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links, root = [0] * len(rows), {i: i for i, _ in rows}
    near = []
    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                    links[a] += 1
                    links[b] += 1
                    near.append((ok[a], ok[b]))
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    return sorted((i, links[k], root[i]) for k, (i, _) in enumerate(rows))


def test_near_duplicate_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(40):
        center = rng.standard_normal(32)
        for _ in range(1 + k % 4):
            rows.append((len(rows), (center + rng.standard_normal(32) * 0.12).tolist()))
    rows += [(500 + k, v) for k, v in enumerate([None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [1.0] * 3, [1.0] * 3, [2.0] * 3, rows[0][1], rows[0][1]])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, rep string")
    want = vectors_by_hand(rows)
    for cell in (500, 8):  # one cell, and several tables
        monkeypatch.setattr(embedding_dedup, "CELL_VECTORS", cell)
        got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())
        same = sum(a == b for a, b in zip(got, want))
        assert len(got) == len(want) and same >= 0.98 * len(want)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_tiles_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 20)
    rng = np.random.default_rng(2)
    center = rng.standard_normal(16)
    rows = [(k, (center + rng.standard_normal(16) * 0.05).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == vectors_by_hand(rows)


def test_components_either_way(spark, monkeypatch):
    import parlance.llm.components as m

    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 330)] + [(7, 7), (None, 3)]
    root = {n: n for a, b in links if a is not None for n in (a, b)}
    for _ in range(40):
        for a, b in links:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(links, "a long, b long")
    for most in (2_000_000, 40):
        monkeypatch.setattr(m, "TASK_LINKS", most)
        assert {r["node"]: r["root"] for r in components(df).collect()} == {n: r for n, r in root.items() if n != r}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(9)
    item = prose(rng, 20)
    rows = odd_rows()
    rows += [(100 + k, prose(rng, 40) + (" you vile fool " if k % 3 == 0 else " my dear friend ") + prose(rng, 20), "en", "s", 1) for k in range(300)]
    rows = [(i, t and t + " my dear friend" if i in (6, 7) else t, *rest) for i, t, *rest in rows]
    rows += [(900, prose(rng, 30) + " my dear friend " + item + " " + prose(rng, 30), "en", "s", 1), (901, prose(rng, 40) + " my dear friend " + prose(rng, 20), "en", "s", 1)]
    tail = prose(rng, 30) + " my dear friend " + prose(rng, 30)
    own = " my dear friend " + prose(rng, 60)
    rows += [(910, tail, "en", "s", 1), (911, tail + own, "en", "s", 1), (911, prose(rng, 50) + " my dear friend", "en", "other", 1), (None, "my dear friend " + prose(rng, 20), "en", "s", 1), (None, None, None, None, None)]
    one, two = (prose(rng, 50) + " my dear friend " + prose(rng, 30) for _ in "ab")
    rows += [(925, one, "en", "s", 1), (925, two, "en", "s", 1), (923, two, "en", "s", 1), (929, one, "en", "s", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("kept", "cut_id", "gone", "rest", "n_removed", "component_id", "predicted", "item_id", "places", "digest", "value", "hash", "a b"):
        frame = frame.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("source"), F.lit("none"))))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + k, 1, int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.where("doc_id is null").count() == 2
        if name == "ngram_jaccard_join":
            assert {(r["doc_id"], r["text"]) for r in docs.where("doc_id between 920 and 930").collect()} == {(923, two), (925, one)}
        if name == "suffix_array_dedup":
            both = {r["source"]: (r["text"], r["kept"], r["n_chars"]) for r in docs.where("doc_id = 911").collect()}
            assert both["s"] == (own, "kept of s", len(own)) and both["other"][0].endswith("my dear friend") and both["other"][2] == 1
    assert 901 in kept["bpe"] and 900 in kept["suffix_array_dedup"] and 900 not in kept["decontamination"]
    assert 6 in kept["ngram_jaccard_join"] and 7 not in kept["ngram_jaccard_join"]
    assert p.run(spark, str(tmp_path)).count() == docs.count()
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
