"""Sources, sinks and the streaming operators."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from strata.operators import metrics
from strata.sources import tables
from strata.streaming import scored_stream


def test_read_dataset_csv_quoted_multiline(spark, tmp_path):
    p = os.path.join(tmp_path, "dataset.csv")
    with open(p, "w") as f:
        f.write('File,Project,Class,Code,LOC,CC,Long method,God class,Feature envy,Data class\n')
        f.write('a.java,p,A,"int x;\nreturn ""y"";",10,2.5,1,0,0,1\n')
        f.write('b.java,p,B,,20,1.0,0,1,0,0\n')
    df = tables.read_dataset_csv(spark, p)
    rows = df.orderBy("File").collect()
    assert len(rows) == 2
    assert rows[0]["Code"] == 'int x;\nreturn "y";'
    assert rows[1]["Code"] is None
    from strata.operators.prep import numeric_columns

    feats = numeric_columns(df, ["File", "Project", "Class", "Code", "Long method", "God class", "Feature envy", "Data class"])
    assert feats == ["LOC", "CC"]


def test_resolve_path(tmp_path):
    real = tmp_path / "x.csv"
    real.write_text("a\n")
    assert tables.resolve_path(["/nonexistent/mnt/data.csv", str(real)]) == str(real)
    with pytest.raises(FileNotFoundError):
        tables.resolve_path(["/nonexistent/a", "/nonexistent/b"])


def test_split_cache_validation(spark, tmp_path):
    base = str(tmp_path)
    good = spark.createDataFrame(
        [(1, "train", [1.0, 2.0]), (2, "val", [1.0, 2.0]), (3, "test", [3.0, 4.0])], "k long, split string, features array<double>"
    )
    tables.write_split_cache(good, os.path.join(base, "good"))
    assert tables.read_split_cache(spark, os.path.join(base, "good")).count() == 3
    tables.write_split_cache(good.where("split != 'test'"), os.path.join(base, "missing"))
    with pytest.raises(ValueError, match="missing splits"):
        tables.read_split_cache(spark, os.path.join(base, "missing"))
    ragged = spark.createDataFrame(
        [(1, "train", [1.0, 2.0]), (2, "val", [1.0]), (3, "test", [3.0, 4.0])], "k long, split string, features array<double>"
    )
    tables.write_split_cache(ragged, os.path.join(base, "ragged"))
    with pytest.raises(ValueError, match="widths"):
        tables.read_split_cache(spark, os.path.join(base, "ragged"))


def test_metric_log_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "log")
    records = lambda rows: spark.createDataFrame(rows, tables.LOG_SCHEMA)
    read = lambda: sorted(map(tuple, tables.read_metric_log(spark, path).collect()), key=str)
    assert read() == []
    killed = tables.write_metric_records(records([(1, 7, 0, "loss", 9.0)]), path)  # ends before its commit
    assert read() == []
    first = [(1, 7, 0, "loss", 1.0), (1, 7, 1, "loss", 0.5), (1, 7, 1, "loss", 0.5), (2, 7, 0, "loss", 3.0), (None, 7, 0, "loss", 4.0)]
    tables.write_metric_log(records(first), path)
    assert read() == sorted(first, key=str)
    again = [(1, 7, 0, "loss", 2.0)]  # a repeated run may have fewer epochs
    tables.write_metric_log(records(again), path)
    tables.write_metric_records(records([(2, 7, 0, "loss", 8.0)]), path)
    want = sorted(again + first[3:], key=str)
    assert read() == want
    tables.write_metric_log(records(again), path)
    tables.write_metric_log(records([]), path)
    assert read() == want
    tables.commit_metric_records(spark, path, killed)  # a restarted driver may still commit what it wrote
    assert read() == sorted([(1, 7, 0, "loss", 9.0)] + first[3:], key=str)


def test_stream_confusion_equals_batch(spark, tmp_path):
    base = str(tmp_path)
    rows = [(i % 3, int(i % 5 == 0), (i % 97) / 97.0) for i in range(600)]
    scored = spark.createDataFrame(rows, "label int, y int, prob double")
    scored.repartition(6).write.parquet(os.path.join(base, "in"))
    stream = scored_stream.read_scored_stream(spark, os.path.join(base, "in"), scored.schema, max_files_per_trigger=2)
    out = scored_stream.run_to_table(scored_stream.running_confusion(stream), os.path.join(base, "out"),
                                     checkpoint=os.path.join(base, "ckpt"))
    got = {r["label"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in spark.read.parquet(out).collect()}
    ref = {r["label"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in metrics.confusion(scored).collect()}
    assert got == ref
    # three batches ran; readers find the last, and only it and the one before are kept
    assert out == scored_stream.latest_batch(spark, os.path.join(base, "out"))
    assert sorted(x for x in os.listdir(os.path.join(base, "out"))) == ["batch-000000000001", "batch-000000000002"]
    with pytest.raises(FileNotFoundError):
        scored_stream.latest_batch(spark, os.path.join(base, "nothing"))


def test_stream_loss(spark, tmp_path):
    base = str(tmp_path)
    rows = [(0, 1, 0.8, 1.3862943611198906), (0, 0, 0.2, -1.3862943611198906)]
    df = spark.createDataFrame(rows, "label int, y int, prob double, logit double")
    df.write.parquet(os.path.join(base, "in"))
    stream = scored_stream.read_scored_stream(spark, os.path.join(base, "in"), df.schema)
    out = scored_stream.run_to_table(scored_stream.running_loss(stream), os.path.join(base, "out"))
    r = spark.read.parquet(out).first()
    assert r["n"] == 2 and r["loss_sum"] == pytest.approx(-2 * __import__("math").log(0.8))


def test_write_shared_table_roundtrip_and_pruning(spark):
    from pyspark.sql import functions as F

    from strata.session import ensure_checkpoint_dir

    df = spark.createDataFrame([(i, ["train", "val", "test"][i % 3], float(i)) for i in range(30)], "k long, split string, v double")
    back = tables.write_shared_table(df, "unit", ["split"])
    folder = ensure_checkpoint_dir(spark).removeprefix("file:").lstrip("/")
    assert all(f.removeprefix("file:").lstrip("/").startswith(folder + "/strata-tables/unit-") for f in back.inputFiles())
    assert sorted(tuple(r) for r in back.select("k", "split", "v").collect()) == sorted(tuple(r) for r in df.collect())
    val = back.where(F.col("split") == "val")
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split" in plan
    assert val.count() == 10


def test_no_folder_of_one_machine_on_a_cluster(tmp_path):
    from strata.session import local_fallback

    for master in ("local", "local[4]", "local[*]", "local[2, 3]"):
        assert os.path.isdir(local_fallback(master))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="shared folder"):
            local_fallback(master)


def test_queries_leave_no_folder(spark):
    """Everything that a query writes under the shared folder is recorded and can be dropped."""
    from strata.plans import catalog
    from strata.session import ensure_checkpoint_dir

    tables.drop_shared_tables(spark)
    for name in ("dataset_csv_roundtrip", "embedding_cache_roundtrip", "metric_log_sink", "stream_confusion", "loss_by_batch"):
        catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert os.listdir(os.path.join(base, "strata-tables"))
    tables.drop_shared_tables(spark)
    assert not [f for _, _, files in os.walk(os.path.join(base, "strata-tables")) for f in files]


def test_drop_shared_tables(spark):
    import os

    df = spark.createDataFrame([(1, "a")], "k long, s string")
    back = tables.write_shared_table(df, "unit-drop")
    path = back.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path)
    assert tables.drop_shared_tables(spark) >= 1
    assert not os.path.exists(path)


def test_bucketed_join_has_no_exchange(spark):
    left = spark.range(1000).select((F.col("id") * 3).alias("k"), F.col("id").alias("a"))
    right = spark.range(1500).select((F.col("id") * 2).alias("k"), F.array(F.col("id").cast("float")).alias("v"))
    a, b = tables.write_bucketed(left, "left", "k", 6), tables.write_bucketed(right, "right", "k", 6)
    joined = tables.bucketed_join(spark.table(a), spark.table(b), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(r.k for r in joined.collect()) == list(range(0, 3000, 6))
    assert spark.table(a).select(F.input_file_name()).distinct().count() == 6  # one file a bucket
    tables.drop_shared_tables(spark)
    assert not spark.catalog.tableExists(a) and not spark.catalog.tableExists(b)


def test_vector_store_encodes_each_text_once(spark, tmp_path):
    import numpy as np

    from strata.operators import embed, vector_store

    store, seen = str(tmp_path / "store"), str(tmp_path / "seen")
    os.mkdir(seen)

    def encoder(texts):
        for t in texts:
            with open(os.path.join(seen, t.encode().hex() or "empty"), "a") as f:
                f.write("x")
        return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

    counts = lambda: {n: os.path.getsize(os.path.join(seen, n)) for n in os.listdir(seen)}
    texts = ["a", "banana", None, "", "a", "x y", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(4)
    vector_store.encode_unseen(df.where("k < 3"), "text", store, encoder, 2)
    assert set(counts().values()) == {1} and len(counts()) == 3
    vector_store.encode_unseen(df, "text", store, encoder, 2)
    vector_store.encode_unseen(df, "text", store, encoder, 2)
    assert set(counts().values()) == {1} and len(counts()) == 4
    got = {r.k: r.embedding for r in vector_store.stored_vectors(df, "k", "text", store).collect()}
    want = {r.k: r.embedding for r in embed.embed_text(df, "k", "text", encoder, 2).collect()}
    assert got == want and len(got) == 7
    other = spark.createDataFrame([(1, "unseen"), (2, "a")], "k long, text string")
    assert {r.k: r.embedding for r in vector_store.stored_vectors(other, "k", "text", store).collect()} == {1: None, 2: [1.0, 1.0]}
    assert vector_store.read_store(spark, str(tmp_path / "none")).count() == 0


def test_large_csv_over_many_blocks(spark, tmp_path):
    """One file of quoted line breaks, read in blocks of 2 KB that end anywhere, equals the one-task reader and the rows written."""
    import csv
    import random

    from strata.sources.large_csv import read_large_csv

    rng = random.Random(11)
    pieces = ["a", "word ", '"', '""', ",", "\n", "\n\n", "\r\n", "ä", " "]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))), f"k{i}") for i in range(2000)]
    rows[700] = (700, '"quoted"\n' * 2000, "longer than blocks")
    rows[701] = (701, "x" * 9000 + "\n" * 9000, "z")
    path = str(tmp_path / "one.csv")
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["id", "text", "tail"])
        out.writerows(rows)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 50
        got = read_large_csv(spark, path, "id long, text string, tail string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted(map(tuple, got)) == rows
    folder = str(tmp_path / "folder")
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "two\nlines", None), (4, ' "sp" ', "c")], "id long, text string, tail string")
    tables.write_dataset_csv(df, folder, rows_per_file=2)
    plain = tables.read_dataset_csv(spark, folder, df.schema).collect()
    assert sorted(map(tuple, read_large_csv(spark, folder, df.schema).collect()), key=str) == sorted(map(tuple, plain), key=str)
    crlf = str(tmp_path / "crlf.csv")
    with open(crlf, "w", newline="") as f:
        f.write('id,text\r\n1,"a\r\nb"\r\n\r\n2,c\r\n')
    assert sorted(map(tuple, read_large_csv(spark, crlf, "id long, text string").collect())) == [(1, "a\r\nb"), (2, "c")]
