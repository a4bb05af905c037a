"""The stages of the pipeline one after another on a small table with odd columns: what each must drop and keep."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, poor and toxic documents, exact and near copies, benchmark passages, and a line that many documents share."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for k in range(300):
        bad = k % 5 == 0
        rows.append((k, text(60) + (" vile filth slur" * 6 if bad else "") + "\n" + ("Share this page with your friends today" if k % 3 == 0 else text(9))))
        labels.append((k, 0 if k % 7 == 1 else 1, int(bad)))
    items = [(k, text(40)) for k in range(6)]
    one = text(80).split(" ")
    rows += [(400, " ".join(one)), (401, " ".join([*one[:7], "otherword", *one[8:]])), (402, rows[2][1] + " " + items[3][1]), (403, None), (404, ""), (405, "vile filth slur " * 20)]
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, "mine", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, Items string, n_leaks long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, columns = [{r.doc_id for r in docs.collect()}], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, folder))
        assert docs.columns == columns
        ids.append({r.doc_id for r in docs.collect()})
    start, judged, lined, single, clean = ids
    toxic = {k for k in range(0, 300, 5)} | {405}
    assert not judged & toxic and len(judged - toxic) >= 0.9 * (len(start) - len(toxic) - 2)
    assert lined == judged
    shared = docs.where(F.col("text").contains("Share this page")).count()
    assert shared <= 1
    assert {400, 401} <= judged and len({400, 401} & single) == 1 and len(lined - single) <= 3
    assert 402 not in clean and len(single - clean) == 1
    assert docs.where("not kept or Items <> 'mine' or n_leaks <> 3").count() == 0
    done = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in done.select("doc_id").collect()} == clean and done.where("n_tokens is null").count() == 0
