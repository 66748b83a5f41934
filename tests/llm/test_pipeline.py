"""Each stage of the pipeline on what the one before kept, against brute force."""

import zlib

import numpy as np
import pytest
import test_decontaminate
import test_line_dedup
import test_simhash
from pyspark.sql import functions as F
from test_tokens import one_by_one, plain

import corpus_pipeline
from pingtrail.llm import quality

SF = "/root/testdata/sf0.001"


def collected(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage_as_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, results = docs.columns, collected(docs), []
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns == columns or number == len(corpus_pipeline.STAGES) - 1
        out.write.parquet(f"{tmp_path}/{number}")
        out = spark.read.parquet(f"{tmp_path}/{number}")
        if number == 0:
            scores = quality.score(docs, quality.train(docs, labels))
            good = {r.doc_id for r in scores.where("score >= 0.3").collect()}
            want = {i: t for i, t in kept.items() if i in good}
        elif number == 1:
            gone = test_line_dedup.brute(list(kept.items()))
            want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if not gone.get((i, n))) for i, t in kept.items()}
        elif number == 2:
            one = {(i, group) for _, i, _, group in test_simhash.brute(list(kept.items()))}
            want = {i: kept[i] for i, group in one if i == group}
        elif number == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            # only items with a shingle in the document can match: keeps the brute force short
            found = set()
            for i, text in kept.items():
                own = test_decontaminate.shingles(test_decontaminate.words_of(text))
                near = [x for x in items if own & test_decontaminate.shingles(test_decontaminate.words_of(x[1]))]
                found |= {d for d, _ in test_decontaminate.brute([(i, text)], near)}
            want = {i: t for i, t in kept.items() if i not in found}
        else:
            results = out.collect()
            break
        docs, kept = out, collected(out)
        assert kept == want, name
    encode, lengths = plain("word_bpe_49k.json"), []
    assert {r.doc_id for r in results} == set(kept)
    for i, text in kept.items():
        ids = np.array([*encode(text), 1], "<u4")
        rows = sorted((r for r in results if r.doc_id == i), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in rows] == [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in rows]
        lengths += [r.length for r in rows]
    assert len({r.sequence_id for r in results}) == len(one_by_one(lengths, 4096))
    assert corpus_pipeline.run(spark, SF).count() == len(results)


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None), (None, "a b c"), (1, "a b c"), (1, "A b c"), (2, "")]])
def test_odd_rows_and_clashing_columns(spark, docs_of, rows, tmp_path):
    for table, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = docs_of([t for _, t in rows], [i for i, _ in rows]).withColumn("_id", F.lit(1)).withColumn("kept", F.lit(2))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert number == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    assert (docs.count() > 0) == bool(rows)


def test_one_row_of_each_group_stays(spark, docs_of):
    rows = [(None, "x y z"), (None, "x y z"), (5, "a b c"), (3, "A b c"), (3, "A b c"), (7, None), (9, "")]
    kept = corpus_pipeline.simhash_near_dedup(spark, docs_of([t for _, t in rows], [i for i, _ in rows]), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("3", "A b c"), ("7", None), ("None", "x y z")]
