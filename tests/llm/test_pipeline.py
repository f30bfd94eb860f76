"""The pipeline's stages against brute force, each on what its predecessor kept."""

import hashlib
import random

import brute
import corpus_pipeline
import duckdb
from corpus import prose, rows, sf_small  # noqa: F401
from pyspark.sql import functions as F

from flowhelm.llm import lines, mixing
from flowhelm.session import release, stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        schema = docs.schema
        docs = stored(stage(spark, docs, sf), name)
        after = docs.collect()
        assert docs.schema == schema
        if name == "toxicity":
            gone = set(before) - {r.doc_id for r in after}
            assert gone & toxic and len(gone) <= 2 * len(toxic) + 20
        elif name == "line_dedup":
            con = duckdb.connect()
            con.execute("create table documents (doc_id bigint, text varchar)")
            con.executemany("insert into documents values (?, ?)", [(r.doc_id, r.text) for r in before.values()])
            want = {r[0]: r[3] for r in con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({lines.SQL})").fetchall()}
            assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in after} == want
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "minhash_near_dedup":
            want = brute.components({i: r.text for i, r in before.items()})
            assert {r.doc_id for r in after} == {i for i, (_, root) in want.items() if i == root}
        elif name == "decontamination":
            flat = lambda t: " ".join(brute.WORD.findall(t.translate(brute.UPPER)))
            leaking = {i for i, r in before.items() if any(flat(b) in flat(r.text) for b in benchmark)}
            gone = set(before) - {r.doc_id for r in after}
            assert leaking <= gone and len(gone - leaking) <= 0.02 * len(before)
        else:
            taken = {r.doc_id: r.copies for r in mixing.plan(spark.createDataFrame(list(before.values()), schema)).collect() if r.copies}
            counted = {}
            for r in after:
                counted[r.doc_id] = counted.get(r.doc_id, 0) + 1
                assert before[r.doc_id] == r
            assert counted == taken
    release(spark)


def test_registered_and_odd_rows(spark, sf_small, sf, tmp_path):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").withColumn("extra", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f", "en", None, 11), (None, "a b c d e f", "en", None, 11), (7, "g h i j k l", None, "s", 11), (7, "g h i j k l", None, "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, odd, sf).collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 7]  # also of rows without an id one stays


def test_null_and_repeated_ids_and_clashing_names(spark, sf, tmp_path):
    """Leaks and near copies in rows without an id go, clean rows that share an id with them stay; columns of any name pass."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rng = random.Random(1)
    one, two, three = (prose(rng, 80) for _ in range(3))
    rows = [(None, f"so {item} it is"), (1, f"and {item}"), (1, one), (None, two), (None, two + " more"), (None, three), (2, one)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _doc long, _lost string, _n_lines long, _at double, _size long, _turn int, _row_key long, _c0 string, n_lines long, size long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 5, "l", 6, 0.5, 7, 8, k, "c", 9, 10) for k, (i, t) in enumerate(rows)], schema)
    folder = tmp_path / "tables"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["decontamination"](spark, docs, str(folder))
    assert left.columns == docs.columns and sorted(r._row_key for r in left.collect()) == [2, 3, 4, 5, 6]
    left = stages["minhash_near_dedup"](spark, left, str(folder))
    assert left.columns == docs.columns and sorted(r._row_key for r in left.collect()) == [2, 3, 5]
    cut = stages["line_dedup"](spark, docs, str(folder))
    assert cut.columns == docs.columns and {r._row_key: (r._doc, r._lost, r._n_lines, r.n_lines) for r in cut.collect()} == {k: (5, "l", 6, 9) for k in range(7)}
    mixed = stages["mixing"](spark, docs, str(folder))
    assert mixed.columns == docs.columns and {(r._at, r._size, r.size) for r in mixed.collect()} == {(0.5, 7, 10)}
    assert stages["toxicity"](spark, docs, str(folder)).columns == docs.columns


def test_a_run_leaves_one_table(spark, sf):
    import os

    from flowhelm import session

    release(spark)
    folder = session.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    result = corpus_pipeline.run(spark, sf)
    new = {x for x in set(os.listdir(folder)) - before if not x.startswith(".")}
    assert len(new) == 1 and next(iter(new)).startswith("mixing-") and result.count() > 0
    release(spark)
    assert set(os.listdir(folder)) - before == set()
