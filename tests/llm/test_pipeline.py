import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import common, packing

from test_operators import brute_components, brute_repeats, texts


def documents(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit("x"))


def test_stages(spark, sf):
    docs = documents(spark)
    named = cp.identify_language(spark, docs, sf)
    assert named.columns == cp.COLUMNS
    kept = {r.doc_id: r.text for r in named.collect()}
    assert not {0, 1, 2} & set(kept) and {6, 7, 10, 14} <= set(kept)  # texts without letters go
    once = cp.drop_near_duplicates(spark, docs.where("text is not null"), sf)
    rows = [(r.doc_id, r.text) for r in docs.where("text is not null").collect()]
    assert {r.doc_id for r in once.collect()} == {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    cut = cp.cut_repeats(spark, docs, sf)
    removed = {r[0]: r[1:] for r in brute_repeats([(r.doc_id, r.text) for r in docs.collect()])}
    for r in cut.collect():
        if r.text is not None:
            assert len(r.text.encode()) - (removed[r.doc_id][0] - removed[r.doc_id][1]) in range(0, 7) and r.n_chars == len(r.text)
    masked = {r.doc_id: r.text for r in cp.mask_personal_data(spark, docs, sf).collect()}
    assert masked[19] == "mail <EMAIL> or <PHONE>, <CARD>, <IP>." and masked[0] is None
    packed = cp.pack(spark, cut, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = {r.doc_id: len(packing.ids_with_end(r.text or "")) for r in cut.collect()}
    assert {r.doc_id: r.n for r in packed} == want
    ids = {}
    for r in cp.pack(spark, cut, sf).collect():
        ids.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {i: [x for _, part in sorted(parts) for x in part] for i, parts in ids.items()} == {r.doc_id: packing.ids_with_end(r.text or "").tolist() for r in cut.collect()}


def test_run_and_empty(spark, sf, tmp_path):
    whole = cp.run(spark, sf)
    assert whole.count() > 0 and np.isin([r.context for r in whole.select("context").distinct().collect()], [1 << k for k in range(11)]).all()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    unlabelled = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in cp.identify_language(spark, unlabelled, sf).collect()} == set(range(len(texts()))) - {0, 1, 2}
    assert len(cp.STAGES) == 5 and common.shared_dir(spark)
