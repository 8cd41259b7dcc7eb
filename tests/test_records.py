"""CSV records over parts of files against the multi-line reader, and the reader's states against a walk by character."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywise.operators.scratch import scratch_path
from tallywise.sources import letters, records

SCHEMA = "id int, a string, b string"
WHOLE = {"header": "true", "escape": '"', "multiLine": "true"}


@pytest.fixture
def parts_of(spark):
    """Sets the size of the parts that text files are read in."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], max(1, size // 4))

    yield use
    for name, value in before.items():
        spark.conf.set(name, value)


def walked(text, inside):
    """Inside quotes after ``text``, read by character from a record's start or from inside quotes."""
    at = "quoted" if inside else "start"
    for c in text:
        if at == "quoted":
            at = "closing" if c == '"' else at
        elif at == "closing" and c == '"':
            at = "quoted"
        elif c == ",":
            at = "start"
        else:
            at = "quoted" if at == "start" and c == '"' else "plain"
    return at == "quoted"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='",a é', max_size=14), min_size=1, max_size=12), st.booleans())
def test_states_of_lines(lines, start):
    outside, inside = records.line_ends(pa.array([x.encode() for x in lines]))
    assert outside.tolist() == [walked(x, False) for x in lines]
    assert inside.tolist() == [walked(x, True) for x in lines]
    expected = [start]
    for line in lines:
        expected.append(walked(line, expected[-1]))
    assert records.states(outside, inside, start).tolist() == expected


def hostile(n):
    draw = random.Random(n)
    pieces = ["a", " ", '"', "\n", "\n\n", ",", "é", "\r\n", "x" * 40, ""]
    return [(i, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 20))), draw.choice(["b", None, '"'])) for i in range(n)]


def both(spark, path):
    split = records.read_csv(spark, path, SCHEMA)
    whole = spark.read.options(**WHOLE).schema(SCHEMA).csv(path)
    assert split.dtypes == whole.dtypes
    return sorted(map(str, split.collect())), sorted(map(str, whole.collect()))


@pytest.mark.parametrize("size, files", [(300, 1), (2000, 1), (2000, 3), (1 << 20, 2)])
def test_written_csv_equals_the_whole_reader(spark, parts_of, size, files):
    path = scratch_path(spark, "t")
    letters.write_csv(spark.createDataFrame(hostile(250), SCHEMA).repartition(files), path)
    parts_of(size)
    split, whole = both(spark, path)
    assert split == whole and len(split) == 250
    if size == 300:
        assert spark.read.text(path).rdd.getNumPartitions() > 20


LOOSE = [
    'id,a,b\n1,x"y,z\n2,"q\nr",s"t\n\n3,"a ""b""\n\n c",\n',
    "id,a,b\r\n1,x,y\r\n2,\"two\r\nlines\",z\r\n",
    'id,a,b\n1,"' + "line of text\n" * 60 + '",end\n2,b,c\n',
    'id,a,b\n1,"",\n2,,""\n3,"only one"\n4,a,b,c,d\nx,not a number,1',
    "id,a,b\n",
    'id,"a\nb",b\n1,2,3\n',
]


@pytest.mark.parametrize("number", range(len(LOOSE)))
def test_loose_csv_equals_the_whole_reader(spark, parts_of, tmp_path, number):
    (tmp_path / "file.csv").write_bytes(LOOSE[number].encode())
    parts_of(64)
    split, whole = both(spark, str(tmp_path))
    assert [r.replace("\\r\\n", "\\n") for r in split] == whole  # line breaks within quotes stay as they are


def test_bytes_that_are_not_utf8_pass(spark, parts_of, tmp_path):
    (tmp_path / "file.csv").write_bytes(b'id,a,b\n1,"\xff\n\xfe",x\n' * 1 + b"2,y\xe9,z\n")
    parts_of(16)
    assert records.read_records(spark, str(tmp_path)).count() == 2


def test_only_text_of_crossing_records_is_shuffled(spark, tmp_path):
    (tmp_path / "file.csv").write_text("id,a,b\n1,x,y\n")
    plan = records.read_csv(spark, str(tmp_path), SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and plan.count("hashpartitioning(file#") == 3  # two windows over parts, one grouping of pieces
