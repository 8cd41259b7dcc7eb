"""Arrays in documents, over parts of files, against the parsed document."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallywise.operators.scratch import scratch_path
from tallywise.sources.arrays import read_arrays, write_arrays


def read_in_parts(spark, path, size, field=None):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], size)
    spark.conf.set(names[1], max(1, size // 4))
    try:
        return sorted((r.field, r.array, r.position, r.value) for r in read_arrays(spark, path, field).collect())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_written_arrays_come_back(spark):
    draw, path = random.Random(1), scratch_path(spark, "t")
    rows = [(a, i, draw.choice([None, 0, -1, 6])) for a, n in (("single model", 700), ("maj", 1), ("zwölf", 9000)) for i in range(n)]
    write_arrays(spark.createDataFrame(rows, "a string, p int, v int").repartition(5), path, "y_pred", "a", "p", "v")
    files = sorted(spark.read.text(path).inputFiles())
    whole = "".join(r.value + "\n" for f in files for r in spark.read.option("wholetext", "true").text(f).collect())
    assert json.loads(whole) == {"y_pred": {a: [v for b, _, v in rows if a == b] for a in {a for a, _, _ in rows}}}
    expected = sorted(("y_pred", a, i, None if v is None else str(v)) for a, i, v in rows)
    for size in (300, 4000, 1 << 20):
        assert sorted(map(str, read_in_parts(spark, path, size))) == sorted(map(str, expected))


@pytest.mark.parametrize("size", [8, 40, 1 << 20])
def test_hand_made_document(spark, tmp_path, size):
    made = {"Error": {"values": [0.5], "unit": "%"}, "y_true": {"a b": [1, None, 3], "c": []}, "y_pred": {"a b": [4, 5, 6], "d": [True]}}
    (tmp_path / "file.json").write_text(json.dumps(made, indent=2))
    expected = [
        (f, a, i, json.dumps(v))
        for f, arrays in made.items()
        for a, values in arrays.items()
        if isinstance(values, list)
        for i, v in enumerate(values)
    ]
    found = [(f, a, i, v or "null") for f, a, i, v in read_in_parts(spark, str(tmp_path), size)]
    assert sorted(found) == sorted(expected)
    assert {r[0] for r in read_in_parts(spark, str(tmp_path), size, "y_pred")} == {"y_pred"}
