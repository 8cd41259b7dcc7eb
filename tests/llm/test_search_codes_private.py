"""Lexical search, vector codes and personal data against brute force, with hostile rows."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywise.llm import codes, lexical, private, queries

DOCS = "doc_id long, text string"

# Ranked lexical search


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked_by_force(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    n, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for doc, bag in bags:
            score = 0
            for t in terms(text):
                tf, df = bag.count(t), sum(t in b for _, b in bags)
                if tf:
                    m = 25 + (75 * len(bag) * n) // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        scored.sort()
        out += [(item, r, None if null else doc, -score) for r, (score, null, doc) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def corpus():
    draw = random.Random(3)
    words = "the of and pine Oak ELM ash fir yew bay Ärger ärger größe naïve 3 42 x_y l'eau a-b".split()
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 12)))) for i in range(60)]
    docs += [(i, "oak elm elm, pine!") for i in range(200, 240)] + [(i, "Elm pine oak ELM?") for i in range(300, 305)]
    docs += [(1000, None), (1001, ""), (1002, "... --"), (7, "oak"), (7, "oak"), (None, "yew bay"), (None, None)]
    return docs + [(2000, "oak fir " * 20000 + "größe")]


ITEMS = [(1, "Oak elm"), (2, "größe GRÖSSE naïve"), (3, "elm elm elm pine"), (4, None), (5, ""), (6, "nowhere"), (7, "the of and"), (7, "yew"), (1, "Oak elm"), (None, "bay")]


@pytest.mark.parametrize("k, block_bytes", [(10, 1 << 20), (3, 1 << 20), (10, 16)])
def test_lexical_search(spark, k, block_bytes):
    docs = spark.createDataFrame(corpus(), DOCS).withColumns({c: F.lit("x") for c in ("h", "m", "score", "terms", "item", "rank")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = lexical.search(docs.repartition(7), items, k=k, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == ranked_by_force(corpus(), ITEMS, k)


def test_lexical_search_in_small_pieces(spark, monkeypatch):
    """Classes scored a few at a time, with the best kept between pieces."""
    items = lexical._Items([[0, 1, 1], [2]], [3, 5, 7])
    assert items.width > 8
    monkeypatch.setattr(lexical._Items, "__init__", narrow(lexical._Items.__init__))
    found = lexical.search(spark.createDataFrame(corpus(), DOCS).coalesce(2), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == ranked_by_force(corpus(), ITEMS, 10)


def narrow(init):
    def made(self, items, weights):
        init(self, items, weights)
        self.width = 4

    return made


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame(corpus(), DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("text is null"), items).count() == 0


# Vector codes


def coded_by_force(vectors, parts, entries, rounds):
    rows = np.floor(256 * np.array([v for _, v, _ in vectors])).astype(int).reshape(len(vectors), parts, -1)
    books = [[r[p].copy() for r in rows[:entries]] for p in range(parts)]

    def assign():
        return [[min((int(((x - c) ** 2).sum()), e) for e, c in enumerate(books[p])) for p, x in enumerate(r)] for r in rows]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [rows[i, p] for i in range(len(rows)) if found[i][p][1] == e]
                if mine:
                    books[p][e] = np.sum(mine, axis=0) // len(mine)
    found = assign()
    flat = ",".join(str(c) for p in range(parts) for e in books[p] for c in e)
    return [("".join(f"{e:02x}" for _, e in r), sum(d for d, _ in r)) for r in found], hashlib.sha256(flat.encode()).hexdigest()


def vectors_of(n, d, seed, spread=0.2):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(9, d))
    return [(int(i), (centres[i % 9] + spread * draw.normal(size=d)).tolist(), i % 3 or None) for i in range(n)]


@pytest.mark.parametrize("n, d, entries, chunk, block", [(300, 32, 64, 64, 8), (40, 16, 64, 4096, 32), (200, 64, 16, 50, 7), (1, 16, 64, 8, 4)])
def test_codes(spark, n, d, entries, chunk, block):
    rows = vectors_of(n, d, n)
    rows += [(n + i, rows[i % n][1], 5) for i in range(20)]  # repeats are ties
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    odd = [(-1, None, 1), (-2, [float("nan")] * d, 1), (-3, [None] + [0.0] * (d - 1), 1), (-4, [float("inf")] + [0.0] * (d - 1), 2)]
    table = table.union(spark.createDataFrame(odd, table.schema)).withColumns({"id": F.lit(1), "code": F.lit("x"), "_label": F.lit(0)})
    found = codes.compress(table.repartition(3), entries=entries, chunk_rows=chunk, block_rows=block)
    found = codes.with_label_error(found).collect()
    expected, digest = coded_by_force(rows, 16, entries, 2)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in found) == [(i, *e) for (i, _, _), e in zip(rows, expected)]
    assert {r["codebooks_sha256"] for r in found} == {digest}
    sums = {}
    for (_, _, label), (_, error) in zip(rows, expected):
        sums[label] = sums.get(label, 0) + error
    assert all(r["label_error"] == sums[r["label"]] for r in found)


def test_codes_of_odd_vectors(spark):
    """Vectors that can't be coded beside the others keep their row; nothing at all gives an empty result."""
    rows = vectors_of(30, 16, 1)
    schema = "vec_id long, embedding array<double>, label int"
    odd = [(-9, [], 1), (100, [0.5] * 32, None), (101, [1e300] * 16, 2), (None, rows[3][1], 2), (None, None, None)]
    found = codes.compress(spark.createDataFrame(rows + odd, schema)).collect()
    expected, digest = coded_by_force(rows + [(99, rows[3][1], 2)], 16, 64, 2)
    assert {r["vec_id"]: r["code"] for r in found if r["vec_id"] is not None} == {
        **{i: e[0] for (i, _, _), e in zip(rows, expected)}, -9: None, 100: None, 101: None
    }
    assert [r["code"] for r in found if r["vec_id"] is None] == [expected[-1][0]] and found[0]["codebooks_sha256"] == digest
    empty = codes.with_label_error(codes.compress(spark.createDataFrame([], schema)))
    assert empty.count() == 0 and "label_error" in empty.columns
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [0.5] * 17, 1)], schema))


@pytest.mark.parametrize("d, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_order_walks_in_steps_of_one(d, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
    walked = grid[codes.hilbert_order(grid)]
    assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-40, 40), min_size=3, max_size=3), min_size=1, max_size=80), st.integers(1, 9), st.integers(1, 12))
def test_blocks_find_the_nearest_entry(points, size, entries):
    rows = np.array(points, np.int16)
    book = rows[np.random.default_rng(len(points)).integers(0, len(rows), entries)].astype(np.int64)
    blocks = codes.Blocks.of(rows, size)
    blocks = codes.Blocks.unpack(blocks.pack(), len(rows), size, 3, "<i2")
    found, errors, _ = blocks.nearest(book)
    distance = ((rows[:, None, :].astype(int) - book[None]) ** 2).sum(axis=2)
    got = np.zeros(len(rows), int)
    got[blocks.order] = found.reshape(-1)[: len(rows)]
    assert got.tolist() == distance.argmin(axis=1).tolist()
    sums = [[int((got == e).sum()), *rows[got == e].sum(axis=0).tolist()] for e in range(entries)]
    assert blocks.entry_sums(book).tolist() == sums


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [2 * int(d) - 9 * (d > "4") if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(twice) % 10 == 0


def base_by_force(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": all(int(n) <= 255 for n in m.group().split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if fine[kind]:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0145.@+- a_é😀(x[", max_size=60))
def test_base_spans(text):
    assert [s[:3] for s in private.identifiers(text) if s[3]] == base_by_force(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111", " ", "-", "1", "+49", ".", "10", "255", "256", "00", "@", "a", "b.c", "é", "\n", "x@y.z", "0"]), max_size=30))
def test_base_spans_of_likely_pieces(pieces):
    text = "".join(pieces)
    assert [s[:3] for s in private.identifiers(text) if s[3]] == base_by_force(text)


DISGUISED = [
    ("email", "john [at] example [dot] com"),
    ("email", "john (at) example.com"),
    ("email", "john at example dot com"),
    ("email", "jane dot doe at mail dot example dot org"),
    ("email", "john_at_example_dot_com"),
    ("email", "john{@}example{.}com"),
    ("email", "juan arroba ejemplo punto es"),
    ("email", "user＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("email", "jоhn@exаmple.com"),
    ("email", "a​nn@example.com"),
    ("ip", "192[.]168[.]0[.]1"),
    ("ip", "192 dot 168 dot zero dot 1"),
    ("ip", "one nine two dot one six eight dot one dot one"),
    ("ip", "１０.0.0.１"),
    ("card", "four one one one one one one one one one one one one one one one"),
    ("card", "4111 1111 one one one one 1111"),
    ("card", "４１１１-１１１１-１１１１-１１１１"),
    ("card", "4111 1111 1111 1111"),
    ("card", "4lll 1111 1111 11I1"),
    ("phone", "+four nine, three zero one two three four five six"),
    ("phone", "＋49 30 1234567"),
    ("phone", "+49–30–1234567"),
    ("phone", "+٤٩ 30 1234567"),
]


@pytest.mark.parametrize("kind, disguise", DISGUISED)
def test_disguises_are_traced_back(kind, disguise):
    for before, after in (("", ""), ("😀 call: ", " now."), ("élan, ", "\nand then")):
        text = before + disguise + after
        spans = [text[a:b] for k, a, b, plain in private.identifiers(text) if k == kind and not plain]
        assert spans == [disguise]
        assert [s[:3] for s in private.identifiers(text) if s[3]] == base_by_force(text)


CLEAN = [
    "look at example.com please", "see at 192.168.1.1", "meet me at noon dot. The end", "one two three four five six seven",
    "at this point com is a word", "He arrived at ten. Com was late", "un point six", "Section 1.2 dot 4", "10 O 12 and 3l4",
    "write to me@here.org dot then", "почта и слова на русском. АВС", "(at) the start (dot) end", "a @ b . c", "plus 100 000 000 euros",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay_clean(text):
    assert [s for s in private.identifiers(text) if not s[3]] == []


@pytest.mark.parametrize("piece", ["1", "a", "@", "1.", "+1", "one ", "[at] ", " dot ", "a at ", "1 ", "(.)", "а", "a.b@c", "4 one ", "O1", "_at_a"])
def test_long_texts_take_linear_time(piece):
    import time

    start = time.perf_counter()
    private.identifiers(piece * (200_000 // len(piece)))
    assert time.perf_counter() - start < 5


def test_identifiers_of_a_table(spark):
    rows = [(1, "mail a@b.co or x [at] y [dot] org"), (2, None), (3, ""), (3, ""), (None, "10.0.0.1"), (4, "z " * 50_000 + "q@r.st")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("identifiers", "kind", "start", "plain", "spans")})
    found = private.find_identifiers(docs)
    assert set(found.columns) == set(docs.columns)
    got = [(r["doc_id"], [tuple(s) for s in r["identifiers"]]) for r in found.collect()]
    assert got == [(i, private.identifiers(t or "")) for i, t in rows]
    assert got[0][1] == [("email", 5, 11, True), ("email", 15, 33, False)] and got[1][1] == []
    assert private.find_identifiers(docs.limit(0)).count() == 0


# Queries


@pytest.mark.parametrize("name", ["op11_lexical", "op12_codes"])
def test_queries_equal_their_sql(spark, sf, name):
    found = queries.QUERIES[name](spark, sf)
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    expected = connection.execute(queries.ORACLE[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expected.fetchall())


def test_private_query(spark, sf):
    found = {r["doc_id"]: r for r in queries.QUERIES["op13_private"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc, text in docs:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in base_by_force(text or ""))
        row = found[doc]
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert row["n_email"] + row["n_ip"] + row["n_card"] + row["n_phone"] == len(row["spans"].split(",")) * bool(row["spans"])
