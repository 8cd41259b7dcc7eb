"""The registered queries' columns and folds, and the pipeline stage by stage against simple versions."""

import zlib

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallywise.llm import lines, simhash, tokens
from tallywise.llm.queries import ORACLE, QUERIES

SCHEMAS = {
    "op1_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op2_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op3_tokens": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op11_lexical": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op12_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_private": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
}
KEYS = {"op2_main_text": ("pages", "page_id"), "op12_codes": ("embeddings", "vec_id")}  # others: a row for each document
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", QUERIES)
def test_queries(spark, sf, name):
    found = QUERIES[name](spark, sf)
    if name in SCHEMAS:
        assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == SCHEMAS[name]
    rows = found.collect()
    table, key = KEYS.get(name, ("documents", "doc_id"))
    if name == "op10_neighbours":
        ids = [r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()]
        assert sorted({r.query_id for r in rows}) == sorted(i for i in ids if i % 20 == 0)
        assert len(rows) == 20 * len({r.query_id for r in rows})
    elif name == "op11_lexical":
        items = [r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id").collect()]
        assert sorted((r.item_id, r.rank) for r in rows) == [(i, k) for i in sorted(items) for k in range(1, 11)]
    elif name != "op5_contamination":
        ids = [r[key] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()]
        assert sorted(r[key] for r in rows) == sorted(ids)
    folds = {"op8_language": (4, 2), "op9_quality": (3, 1)}
    if name in folds:
        n, rest = folds[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) for r in rows)
    if name == "op6_shards":
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" for r in rows)
    assert set(ORACLE) <= set(QUERIES)


def lean_lines(docs):
    """Line dedup by pairs: id, text and what is left of the text."""
    first, root = {}, {}
    for i, text in docs:
        for p, line in enumerate(text.split("\n")):
            line = line.strip(" \t\r")
            if len(line) >= 20:
                first[line] = min(first.get(line, (i, p)), (i, p))
                root[line] = line

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = sorted((x for x in root if len(x) >= 48), key=len)
    for j, a in enumerate(long):
        for b in long[j + 1 :]:
            if len(b) - len(a) > 2:
                break
            if lines.within(a, b, 2):
                root[find(a)] = find(b)
    least = {}
    for line, place in first.items():
        least[find(line)] = min(least.get(find(line), place), place)

    def stays(line, place):
        line = line.strip(" \t\r")
        return len(line) < 20 or least[find(line)] == place

    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if stays(x, (i, p))) for i, t in docs}


def test_pipeline_stage_by_stage(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == COLUMNS and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[k] = {r.doc_id: r for r in docs.collect()}
    before = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(i in kept[0] for i, q in labels.items() if q == 1)
    assert sum(i in kept[0] for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    assert all(r == before[i] for i, r in kept[0].items())

    lean = lean_lines([(i, r.text) for i, r in kept[0].items()])
    lost = {i for i, t in lean.items() if t != kept[0][i].text and not t.strip()}
    assert {i: r.text for i, r in kept[1].items()} == {i: t for i, t in lean.items() if i not in lost}
    assert all(r.n_chars == len(r.text) for r in kept[1].values())

    prints = sorted((i, simhash.fingerprint(r.text, 4, 42)) for i, r in kept[1].items())
    group = {i: i for i, _ in prints}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for j, (a, x) in enumerate(prints):
        for b, y in prints[j + 1 :]:
            if (x ^ y).bit_count() <= 4:
                low, high = sorted((find(a), find(b)))
                group[high] = low
    assert set(kept[2]) == {i for i in group if find(i) == i}

    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = lambda t: " ".join(decontaminate_words(t))
    whole = {i for i, r in kept[2].items() if any(f" {words(x)} " in f" {words(r.text)} " for x in items)}
    assert whole and not whole & set(kept[3]) and len(kept[2]) - len(kept[3]) <= 1.2 * len(whole) + 1

    path, pattern = corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokens.read_ranks(path), special_tokens={})
    assert set(kept[4]) == set(kept[3])
    assert all(r.ids == library.encode_ordinary(kept[3][i].text) for i, r in kept[4].items())
    assert corpus_pipeline.ORACLE_SQL is None


def decontaminate_words(text):
    import re

    return re.findall(r"\w+", text.lower())


def test_run_gives_the_last_stage(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert found.where(F.size("ids") != F.col("n_tokens")).count() == 0 and found.count() > 0
