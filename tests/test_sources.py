"""Files: salvage against the CSV library itself, round trips, metric files, encrypted columns."""

import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywise.operators.scratch import scratch_path, scratch_root
from tallywise.plans import catalog
from tallywise.sources import letters, runs, salvage, sealed


def longest_clean_prefix(text: str):
    """Drop lines from the end until the library reads the rest: (rows, lines removed), or None."""
    lines = text.splitlines(keepends=True)
    for removed in range(len(lines)):
        try:
            rows = len(pd.read_csv(io.StringIO("".join(lines[: len(lines) - removed])), lineterminator="\n"))
            return rows, removed
        except pd.errors.ParserError:
            continue
    return None


def random_csv(rng: random.Random) -> str:
    header, first = "a,b,c", "1,2,3"
    pieces = ["x", "yz", '""', '"', ",", ",", "\n", "\n", " ", '"p,q"', '"m\nn"', '"o""k"', '""""']
    body = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
    return f"{header}\n{first}\n{body}" + rng.choice(["", "\n"])


FIXED = [
    "a,b\n1,2\n3,4\n",
    "a,b\n1,2\n3,4,5\n6,7\n",
    'a,b\n1,2\n3,"x\n5,6\n',
    'a,b\n1,"x\ny"\n3,4\n5,"z\n\n',
    'a,b\n1,2\n3\n\n4,"q, ""r"""\n',
    'a,b\n1,x"y\n2,z\n',
    'a,b\n1,2\n3,"x"tail"\n4,5\n',
    '"a\nb",c\n1,2\n3,"4\n5',
    "a,b\n",
    "\na,b\n1,2\n1,2,3\n",
    'a,b\n1,2\n "x,\n3,4\n',
]


def test_salvage_agrees_with_the_csv_library(spark, tmp_path):
    rng = random.Random(5)
    texts = FIXED + [random_csv(rng) for _ in range(120)]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i:03d}.csv").write_text(text)
    report = salvage.salvage_report(spark, str(tmp_path)).collect()
    got = {int(r.file[-7:-4]): (r.rows_kept, r.lines_removed) for r in report}
    wrong = [(t, got[i], longest_clean_prefix(t)) for i, t in enumerate(texts) if got[i] != longest_clean_prefix(t)]
    assert not wrong, wrong[:3]


def test_salvage_over_many_blocks(spark, tmp_path):
    """The same cut when a file is read in many small blocks."""
    rows = ['%d,"line %d\nmore, text %d"' % (i, i, i) for i in range(400)]
    text = "id,body\n" + "\n".join(rows[:300]) + "\n1,2,3\n" + "\n".join(rows[300:]) + "\n"
    (tmp_path / "big.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        blocks = salvage.read_lines(spark, str(tmp_path)).select("block").distinct().count()
        report = salvage.salvage_report(spark, str(tmp_path)).first()
        kept = salvage.salvaged_lines(spark, str(tmp_path)).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 10
    assert (report.rows_kept, report.lines_removed, report.aborted) == (300, 201, False)
    assert "\n".join(r.line for r in kept) == "id,body\n" + "\n".join(rows[:300])


def test_salvage_aborts_without_a_clean_header(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('a,"b\n1,2\n')
    row = salvage.salvage_report(spark, str(tmp_path)).first()
    assert (row.rows_kept, row.aborted) == (0, True)
    assert longest_clean_prefix('a,"b\n1,2\n') is None
    assert salvage.salvaged_lines(spark, str(tmp_path)).count() == 2


def test_write_salvaged(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text('a,b\n1,"u\nv"\n2,"cut\n')
    salvage.write_salvaged(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    back = spark.read.options(header="true", multiLine="true").csv(str(tmp_path / "out" / "name=x.csv"))
    assert [tuple(r) for r in back.collect()] == [("1", "u\nv")]


def test_csv_keeps_text(spark):
    texts = ['plain', ' padded ', 'two\nlines', 'quo"te, "x"', "back\\slash", 'end"', None]
    df = spark.createDataFrame([(i, t, "P", "en", "web", None) for i, t in enumerate(texts)], letters.LETTER_SCHEMA)
    path = scratch_path(spark, "t")
    letters.write_csv(df, path)
    back = letters.read_letters(spark, path).orderBy("row_id").collect()
    assert [r.input_text for r in back] == texts
    with pytest.raises(ValueError):
        letters.read_letters(spark, path, fmt="xlsx")


def test_encrypted_columns(spark, monkeypatch):
    key, wrong = "00" * 16, "11" * 16
    path = scratch_path(spark, "t")
    df = spark.createDataFrame([(1, "séance", 3), (2, None, None)], "row_id int, input_text string, label int")
    letters.write_encrypted(df, path, key, ["input_text", "label"])
    columns = {"input_text": "string", "label": "int"}
    assert sorted(map(tuple, letters.read_encrypted(spark, path, key, columns).collect())) == [(1, "séance", 3), (2, None, None)]
    plain = letters.read_encrypted(spark, path, "0123456789abcdef" * 2, columns)
    assert "0123456789abcdef" not in plain._jdf.queryExecution().toString().lower()
    assert letters.read_encrypted(spark, path, wrong, columns).where("input_text is not null").count() == 0
    assert spark.read.parquet(path).where("input_text like '%ance%'").count() == 0
    monkeypatch.setenv("LETTER_KEY", key)
    assert letters.key_from_environment("LETTER_KEY") == key
    with pytest.raises(KeyError):
        letters.key_from_environment("NO_SUCH_KEY")


def test_sealed_tables_show_tampering(spark):
    key, other = "01" * 16, "02" * 16
    rows = [(1, "one", 3, "a"), (2, "two", None, "b"), (3, "two", 3, None), (None, "x", 1, "c")]
    df = spark.createDataFrame(rows, "row_id int, input_text string, label int, open string")
    path = scratch_path(spark, "t")
    sealed.write_sealed(df, path, key, ["input_text", "label"])
    columns = {"input_text": "string", "label": "int"}
    back = sealed.read_sealed(spark, path, key, columns)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert sealed.verify_sealed(spark, path, key).first() == (4, 4, True)
    assert sealed.verify_sealed(spark, path, other).first() == (4, 4, False)
    assert sealed.damaged_cells(spark, path, key, list(columns)).count() == 0
    stored = spark.read.parquet(path)
    assert len({r.input_text for r in stored.collect()}) == 4

    def tampered(table):
        where = scratch_path(spark, "t")
        table.write.parquet(where)
        spark.read.parquet(f"{path}/_seal").write.parquet(f"{where}/_seal")
        cells = sealed.damaged_cells(spark, where, key, list(columns)).collect()
        return sealed.verify_sealed(spark, where, key).first().whole, sorted(map(tuple, cells))

    columns_moved = stored.withColumn("label", F.when(F.col("row_id") == 1, F.col("input_text")).otherwise(F.col("label")))
    renumbered = stored.withColumn("row_id", F.when(F.col("row_id") == 2, 3).when(F.col("row_id") == 3, 2).otherwise(F.col("row_id")))
    assert tampered(stored.repartition(3)) == (True, [])
    assert tampered(stored.where("row_id != 2")) == (False, [])
    assert tampered(stored.union(stored)) == (False, [])
    assert tampered(stored.withColumn("open", F.lit("z"))) == (False, [])
    assert tampered(columns_moved) == (False, [(1, "label")])
    assert tampered(renumbered) == (False, [(2, "input_text"), (2, "label"), (3, "input_text")])
    empty = scratch_path(spark, "t")
    sealed.write_sealed(df.limit(0), empty, key, ["label"])
    assert sealed.verify_sealed(spark, empty, key).first() == (0, 0, True)


def test_sealed_files_and_traded_texts_are_small(spark):
    path = scratch_path(spark, "t")
    df = spark.range(300).select(F.col("id").alias("row_id"), F.repeat(F.md5(F.col("id").cast("string")), 50).alias("input_text"))
    sealed.write_sealed(df, path, "01" * 16, ["input_text"])
    stored = spark.read.parquet(path)
    files = stored.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0]
    assert files < 0.85 * stored.agg(F.sum(F.length("input_text"))).first()[0]  # base64 holds six bits a character

    ids = [0, 1, 1, 2, 3, 3, 5, 6, 7, 7, -1, -2, None, None]
    rows = [(i, None if n in (5, 7) else f"t{n}", n) for n, i in enumerate(ids)]
    odd = spark.createDataFrame(rows, "row_id long, input_text string, n int")
    found = catalog.traded_texts(odd)
    given = {k: [t for i, t, _ in rows if i is not None and i ^ 1 == k] for k in ids if k is not None}
    wanted = [(i, t if x is None else x, n) for i, t, n in rows for x in given.get(i) or [None]]
    assert found.columns == odd.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)


def test_results_overwrite_only_their_own_run(spark):
    path = scratch_path(spark, "t")
    one = spark.createDataFrame([("m-GGUF", "Q4", 1), ("m-AWQ", "Q4", 2)], "model string, quant_scheme string, v int")
    runs.write_results(one, path, "stub")
    runs.write_results(one.where("v = 1").withColumn("v", F.lit(7)), path, "stub")
    back = runs.read_results(spark, path).select("backend", "guided", "model", "quant_scheme", "v")
    assert sorted(map(tuple, back.collect())) == [
        ("stub", "free", "m-AWQ", "no_quant_scheme", 2),
        ("stub", "free", "m-GGUF", "Q4", 7),
    ]


def test_consensus_and_reports(spark, tmp_path):
    assert runs.consensus_path("a/b.csv") == "a/b_data_with_predictions.csv"
    assert runs.consensus_path("a/b") == "a/b_data_with_predictions.csv"
    df = spark.createDataFrame([(i, "x, y") for i in range(9)], "row_id int, text string").repartition(3)
    path = runs.write_consensus(df, str(tmp_path / "r.csv"))
    assert letters.read_letters(spark, path, "row_id int, text string").count() == 9
    letters.write_report(df, str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("*.csv"))) == 1


def test_metric_files(spark, tmp_path):
    good = '{"Error Rate\\n(single model)": {"values": [0.25], "unit": "%"}, "VRAM param usage": {"values": [2.0]}, '
    good += '"Number of params": {"values": ["8"]}, "Bits/param": {"values": [8]}, "y_true": {"single": [1, 2]}, '
    good += '"y_pred": {"single": [1, 3], "maj_3": [2, 3]}}'
    for name, body in (("a-FP8", good), ("b", good), ("c", '{"Error'), ("d", good.replace("[2.0]", '["x"]')), ("e", good + " x"), ("f", good * 2)):
        (tmp_path / f"{name}.json").write_text(body)
    files = runs.read_metric_files(spark, str(tmp_path))
    assert sorted(r.path[-6:] for r in runs.damaged_files(files).collect()) == ["c.json", "e.json", "f.json"]
    name = F.regexp_extract("path", r"([^/]+)\.json", 1)
    pooled = {r.model: r for r in runs.pooled_results(files, name).collect()}
    assert set(pooled) == {"a-FP8", "b"}  # d has no usable memory value, c cannot be read
    assert (pooled["b"].vram, pooled["b"].nbits, pooled["b"].error_single, pooled["b"].error_all) == (2.0, 8.0, 0.25, None)
    assert (pooled["a-FP8"].vram, pooled["a-FP8"].nbits, pooled["a-FP8"].marker_size) == (4.0, 16.0, 200.0)

    one = tmp_path / "one"
    one.mkdir()
    (one / "run=m").mkdir()
    (one / "run=m" / "x.json").write_text(good)
    arrays = runs.prediction_arrays(spark, str(one))
    table = spark.createDataFrame([("k2",), ("k1",)], "k string")
    joined = runs.attach_prediction_arrays(table, "k", arrays, ["m-single", "m-maj_3", "m-maj_5"], F.col("run"))
    got = {r.k: (r["m-single"], r["m-maj_3"], r["m-maj_5"]) for r in joined.collect()}
    assert got == {"k1": (1, 2, None), "k2": (3, 3, None)}
    with pytest.raises(ValueError, match="the table has 3 rows"):
        runs.attach_prediction_arrays(table.union(table.limit(1)), "k", arrays, ["m-single"], F.col("run"))


def test_scratch_follows_the_session(spark):
    class Named:
        conf = {"spark.checkpoint.dir": "hdfs://shared/scratch/"}

    assert scratch_root(Named()) == "hdfs://shared/scratch"
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_scratch_refuses_a_local_folder_on_a_cluster():
    class Conf(dict):
        pass

    class Context:
        @staticmethod
        def getConf():
            return Conf({"spark.master": "spark://host:7077"})

    class Cluster:
        conf, sparkContext = {}, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Cluster())


def test_durable_compares_counts_and_release_deletes(spark, monkeypatch, tmp_path):
    from pyspark.sql import DataFrameWriter

    from tallywise.operators import scratch

    monkeypatch.setattr(spark, "_tallywise_paths", [], raising=False)
    kept = scratch.durable(spark.range(100), "kept")
    assert kept.count() == 100
    empty = scratch.durable(spark.range(0), "empty")
    assert empty.count() == 0
    write = DataFrameWriter.parquet

    def partly(self, path, *args, **options):
        write(self, path, *args, **options)
        write(spark.range(7).write.mode("overwrite"), path)

    monkeypatch.setattr(DataFrameWriter, "parquet", partly)
    with pytest.raises(RuntimeError, match="100 rows were written"):
        scratch.durable(spark.range(100), "torn")
    monkeypatch.undo()
    spark._tallywise_paths = [kept.inputFiles()[0].rpartition("/")[0]]
    assert scratch.release(spark) == 1


def test_half_widths_come_from_the_file_of_the_value(spark, tmp_path):
    """Cells of the first run by path; none without labels or cells; no value, no half-width. Cells of two files add up."""

    def metric_file(name, error, cells):
        sizes = '"VRAM param usage": {"values": [1.5]}, "Number of params": {"values": [9.5]}, "Bits/param": {"values": [4]}'
        scores = f'"Error Rate\\n(single model)": {{"values": [{error}]}}, "Distance\\n(single model)": {{"values": [NaN]}}'
        held = f', "cells": {{"single model": {cells}}}' if cells else ""
        (tmp_path / name).write_text(f"{{{sizes}, {scores}{held}}}")

    metric_file("a-0", "NaN", "[[1, 1, 1000]]")
    metric_file("a-1", "0.5", "[[0, 1, 50], [1, 1, 50], [-1, 1, 700]]")
    metric_file("a-2", "0.9", "[[0, 1, 5]]")
    metric_file("b-1", "0.5", "")
    metric_file("c-1", "0.5", "[[-1, 1, 9]]")
    metric_file("d-1", "0.5", "[[0, 1, 50], ")
    files = runs.read_metric_files(spark, str(tmp_path))
    assert "cells" not in {r.metric for r in runs.flatten_metrics(files, ["path"]).collect()}
    letter = F.regexp_extract("path", r"/(\w)-\d$", 1)
    rows = {r.model: r for r in runs.pooled_results(files, letter, intervals=True).collect()}
    plain = {r.model: r for r in runs.pooled_results(files, letter).collect()}
    assert set(rows) == set(plain) == {"a", "b", "c"}
    assert all(rows[m][c] == plain[m][c] for m in rows for c in ("error_single", "distance_single", "marker_size"))
    assert 0.07 < rows["a"].error_single_err_low < 0.13 and 0.07 < rows["a"].error_single_err_high < 0.13
    assert (rows["b"].error_single_err_low, rows["c"].error_single_err_high) == (0.0, 0.0)
    assert rows["a"].distance_single_err_low is None and rows["a"].error_all_err_low is None
    added = runs.metric_cells(files.withColumn("k", F.lit(1)), ["k"])
    assert {(r.y, r.p): r.n for r in added.collect()} == {(1, 1): 1050, (0, 1): 55, (-1, 1): 709}
