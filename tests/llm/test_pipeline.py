"""The pipeline's stages against brute force, and as a whole."""

import corpus_pipeline
from test_ops import brute_contamination, brute_lines, brute_near, plain


def test_stages_follow_each_other(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = plain(held)
        out = stage(spark, held, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        held = spark.read.parquet(str(tmp_path / f"s{k}"))
        after = plain(held)
        if k == 0:
            assert {i for i, t in before if t and any(c.isalpha() for c in t)} >= {i for i, _ in after}
            assert len(after) >= 0.97 * len(before)
        if k == 1:
            assert sorted(after) == sorted((r[0], r[4]) for r in brute_lines(before))
        if k == 2:
            assert sorted(i for i, _ in after) == sorted(i for i, _, c in brute_near(before) if i == c)
        if k == 3:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            bad = {r[0] for r in brute_contamination(before, items) if r[5]}
            assert sorted(i for i, _ in after) == sorted(i for i, _ in before if i not in bad)
    last = corpus_pipeline.STAGES[-1][1](spark, held, sf)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, whole.collect()))


def test_registry_matches():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_stages_take_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
