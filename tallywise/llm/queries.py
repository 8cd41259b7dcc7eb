"""One registered query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.llm import (
    codes,
    decontaminate,
    html,
    language,
    lexical,
    lines,
    neighbours,
    private,
    quality,
    sharding,
    simhash,
    suffixes,
    tokens,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = suffixes.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes, n_kept = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), F.octet_length("kept").cast("long")
    return docs.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - n_kept).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract_pages(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = tokens.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(docs, items)
    return found.select("doc_id", F.explode("matches").alias("match")).select("doc_id", "match.*")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.histogram_shards(docs, shards=40).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = lines.dedupe_lines(docs, least=1, least_near=20, share=0.05)
    kept = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "n_lines", "n_removed", F.octet_length(kept).alias("n_bytes"), F.sha2(kept, 256).alias("kept_sha256")
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    prototypes = language.learn_languages(docs.where(~held_out))
    scored = language.identify_languages(docs.select("doc_id", "text"), prototypes)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_read(spark, sf_dir, t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    weights = quality.fit_quality(docs, labels.where(_fold(3) != 1))
    scored = quality.score_quality(docs, weights)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", predicted)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, is_query=F.col("vec_id") % 20 == 0, k=20)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark")
    return lexical.search(docs, items, k=10)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.with_label_error(codes.compress(_read(spark, sf_dir, "embeddings")))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("identifiers")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(joined(F.filter(found, lambda s: s["plain"])), 256)
    docs = private.find_identifiers(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *map(counted, private.KINDS), base.alias("base_sha256"), joined(found).alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repeats, op2_main_text, op3_tokens, op4_simhash, op5_contamination, op6_shards, op7_lines, op8_language,
        op9_quality, op10_neighbours, op11_lexical, op12_codes, op13_private,
    )
}

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_LEXICAL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
heard AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM docs) u GROUP BY ALL),
totals AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms)) AS n_terms FROM docs),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM heard, totals GROUP BY t, n_docs),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) u GROUP BY ALL),
scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(terms) * n_docs) // n_terms)))) AS score
  FROM asked JOIN weights USING (t) JOIN heard USING (t) JOIN docs USING (r), totals GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM ranked WHERE rank <= 10"""


def _assigned(book: str) -> str:
    return f"""SELECT r, part, x, min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j]))), 'entry': entry}}) AS m
  FROM parts JOIN {book} USING (part) GROUP BY r, part, x"""


def _moved(book: str, assigned: str) -> str:
    return f"""SELECT part, entry, coalesce(mean, c) AS c FROM {book} LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY j) AS mean FROM (
      SELECT part, m.entry AS entry, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS mean
      FROM {assigned}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS j) js GROUP BY ALL) means
    GROUP BY part, entry) moved USING (part, entry)"""


_CODES = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p AS part, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, (SELECT unnest(range(16)) AS p) ps),
book0 AS (SELECT part, r - 1 AS entry, x AS c FROM parts WHERE r <= 64),
round1 AS ({_assigned("book0")}),
book1 AS ({_moved("book0", "round1")}),
round2 AS ({_assigned("book1")}),
book2 AS ({_moved("book1", "round2")}),
last AS ({_assigned("book2")}),
coded AS (SELECT r, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM last GROUP BY r),
digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest"""

#: The others can't be said in SQL: they rest on hashes that DuckDB lacks, on fitted models or on transducers.
ORACLE: dict[str, str] = {"op11_lexical": _LEXICAL, "op12_codes": _CODES}
