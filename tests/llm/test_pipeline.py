"""Every stage on small planted corpora, and the registered queries' columns."""

import random

import corpus_pipeline
import test_decontamination
import test_line_dedup
import test_near_dedup
from helpers import frame, sentence
from test_tokens import check_packing, whole


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    good = [(i, "\n".join(sentence(rng, 30) for _ in range(4))) for i in range(0, 400)]
    bad = [(i, sentence(rng, 60).upper().replace(" ", "!! ")) for i in range(400, 520)]
    passage = sentence(rng, 70)
    good[50:60] = [(i, t + "\n" + passage) for i, t in good[50:60]]
    near = [(600 + i, test_near_dedup.edited(rng, good[i][1].replace("\n", " "), 0.01)) for i in range(20)]
    items = [(1, good[100][1].split("\n")[1]), (2, sentence(rng, 40))]
    rows = good + bad + near
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i in range(520)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{k}")
            out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = [(r.doc_id, r.text) for r in docs.collect()], out.collect()
        ids = {r.doc_id for r in after}
        if k == 0:
            assert ids & {i for i, _ in bad} == set() and len({i for i, _ in good} - ids) <= 2
        if k == 1:
            want = test_line_dedup.brute(before)
            assert {r.doc_id: r.text for r in after} == {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in set(want[i])) for i, t in before}
            assert sum(passage in r.text for r in after) == 1
        if k == 2:
            assert ids == {c for _, _, c in test_near_dedup.brute(before, 5)} and len(ids & {i for i, _ in near}) < 8
        if k == 3:
            assert ids == {i for i, t in before if not test_decontamination.brute(t, items)[1]} and 100 not in ids
        if k == 4:
            n, total = check_packing(before, after, whole("byte_bpe_50k.json"))
            assert n <= total / 2048 * 1.05 + 1
        docs = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_on_empty_documents(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
