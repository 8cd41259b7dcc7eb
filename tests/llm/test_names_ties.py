"""Columns named like the operators' own helpers, ties among many components, rare languages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import html, language, lines, neighbours, simhash, suffixes

HELPERS = "hit runs id tag windows doc gone pos line row mark again open _id _tag _word _bits _text _component _rows".split()
PASSAGE = "a passage of well over fifty bytes that stands in several of the documents here"


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, f"{PASSAGE}\n{'x' * i}", *[f"{h}-{i}" for h in HELPERS], "dot") for i in range(6)] + [(None, None, *HELPERS, None)]
    fields = ", ".join(f"`{h}` string" for h in [*HELPERS, "a.b"])
    return spark.createDataFrame(rows, f"doc_id long, text string, {fields}")


@pytest.mark.parametrize("operator", [suffixes.remove_repeats, lines.dedupe_lines, simhash.keep_first])
def test_helper_names_belong_to_the_user(named, operator):
    out = operator(named)
    assert out.columns[: len(named.columns)] == [c for c in named.columns]
    got = {r["doc_id"]: r for r in out.collect()}
    assert None in got and 0 in got
    for i, r in got.items():
        assert [r[h] for h in HELPERS] == ([f"{h}-{i}" for h in HELPERS] if i is not None else HELPERS)
    if operator is lines.dedupe_lines:
        assert [got[i]["n_removed"] for i in range(6)] == [0, 1, 1, 1, 1, 1]
    if operator is suffixes.remove_repeats:
        assert bytes(got[0]["kept"]).startswith(PASSAGE.encode()) and len(got[3]["removed"]) == 1


def test_equal_vectors_of_64_components_tie(spark):
    rng = np.random.default_rng(4)
    data = np.repeat(rng.standard_normal((60, 64)).astype(np.float32), 15, axis=0)
    rows = [(int(i), [float(x) for x in data[j]]) for i, j in enumerate(rng.permutation(len(data)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, relax=1.0, shard_rows=300, block_rows=7, leaf=33)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())

    def product(v, w):
        total = 0.0
        for x, y in zip(v, w):
            total += x * y
        return total

    true = []
    for q, v in rows[::20]:
        best = sorted((-product(v, w), i) for i, w in rows if i != q)[:20]
        true += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == true


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the words of a plain text here", "en") for i in range(600)] + [(i, "und ein deutscher satz", "de") for i in range(900, 903)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert list(language.learn_languages(docs, max_rows=20, min_rows=5)) == ["de", "en"]
