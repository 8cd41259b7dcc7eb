"""Operators over many documents against brute force, with planted cases and hostile rows."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallywise.llm import components, decontaminate, lines, membership, neighbours, queries, sharding, simhash, suffixes

DOCS = "doc_id long, text string"
WORDS = "the of and pine oak elm ash fir yew bay fig gum box holly maple cedar larch birch rowan alder hazel willow".split()


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Random texts with shared passages, copies, near copies, an empty one and a very long one."""
    draw = random.Random(5)
    shared = [sentence(draw, 15) for _ in range(4)]
    texts = []
    for i in range(60):
        parts = [sentence(draw, draw.randint(1, 30)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(draw.randint(0, 3), draw.choice(shared))
        texts.append(("\n" if i % 2 else " ").join(parts))
    texts += [texts[3]] * 5 + [texts[7][:-1] + "é", "", "short", "a" * 300, "é" * 120, texts[9] + " " + texts[12]]
    texts.append("\n".join(sentence(draw, 20) for _ in range(400)))
    return list(enumerate(texts, 10))


def repeats_by_force(rows, length):
    first = {}
    for i, text in sorted(rows):
        for p in range(len(text) - length + 1):
            first.setdefault(text[p : p + length], i)
    out = []
    for i, text in rows:
        gone = [False] * len(text)
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        spans = []
        for p, g in enumerate(gone):
            if g and (not p or not gone[p - 1]):
                spans.append([p, p])
            if g:
                spans[-1][1] = p + 1
        out.append((i, bytes(b for b, g in zip(text, gone) if not g), [tuple(s) for s in spans]))
    return out


@pytest.mark.parametrize("length, seed, crowd", [(50, 16, 50000), (24, 8, 50000), (50, 16, 3), (24, 8, 0)])
def test_repeats(spark, corpus, length, seed, crowd):
    docs = spark.createDataFrame(corpus, DOCS).repartition(5)
    found = suffixes.remove_repeats(docs, length=length, seed=seed, crowd=crowd).collect()
    got = sorted((r.doc_id, bytes(r.kept), [(s.start, s.end) for s in r.removed]) for r in found)
    assert got == sorted(repeats_by_force([(i, t.encode()) for i, t in corpus], length))
    assert any(spans for _, _, spans in got)


def test_repeats_edges(spark):
    text = "x" * 20 + "0123456789" * 6
    rows = [(None, text), (1, None), (1, ""), (2, text), (2, text), (3, text), (2, "y" + text), (4, "x" * 49)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    found = suffixes.remove_repeats(docs)
    assert found.columns == ["doc_id", "text", "kept", "removed"]
    kept = sorted((r.doc_id or 0, bytes(r.kept).decode()) for r in found.collect())
    assert kept == sorted([(0, text), (1, ""), (1, ""), (2, text), (2, text), (2, "y" + text), (3, ""), (4, "x" * 49)])
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_deep_shallow_order():
    draw = random.Random(2)
    strings = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 40))) for _ in range(400)]
    strings += [b"a" * 16 + bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 20))) for _ in range(400)]
    order, shared = suffixes.sort_suffixes(strings)
    ordered = [strings[i] for i in order]
    assert sorted(order) == list(range(len(strings)))
    assert ordered == sorted(strings)
    for a, b, n in zip(ordered, ordered[1:], shared[1:]):
        assert a[:n] == b[:n] and (a == b or n == min(len(a), len(b)) or a[n] != b[n])


def test_membership_filter_has_no_misses(spark):
    df = spark.createDataFrame([(i,) for i in range(500)] + [(None,)], "id long")
    hits = {r.id: r.hit for r in membership.maybe_among(df, "id", df.where("id % 3 = 0")).collect()}
    assert all(hits[i] for i in range(0, 500, 3)) and hits[None] is False
    assert sum(hits.values()) < 200


def fingerprint_by_force(text):
    words = text.encode().lower().split() if text.isascii() else simhash._LOWER and text.encode().translate(simhash._LOWER).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_force(prints, distance):
    """prints: (id, fingerprint) -> smallest id reachable of each."""
    root = {p: p for _, p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= distance:
            root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        least[find(p)] = min(i, least.get(find(p), i))
    return [least[find(p)] for _, p in prints]


def test_simhash_groups(spark, corpus):
    found = sorted(simhash.near_groups(spark.createDataFrame(corpus, DOCS)).collect())
    prints = [(i, fingerprint_by_force(t)) for i, t in corpus]
    assert [r.simhash % 2**64 for r in found] == [p for _, p in prints]
    assert [r.component_id for r in found] == groups_by_force(prints, 4)


@pytest.mark.parametrize("distance, segments", [(4, 3), (4, 2), (3, 4), (5, 3), (0, 2)])
def test_links_within(spark, distance, segments):
    draw = random.Random(distance * 10 + segments)
    centres = [draw.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    prints = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))) for c in centres for _ in range(12)}
    rows = [(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(sorted(prints))]
    table = spark.createDataFrame(rows, "simhash long, id long")
    got = {(r.a, r.b) for r in simhash.links_within(table, distance, segments).collect()}
    pairs = combinations([(i, s % 2**64) for s, i in rows], 2)
    assert got == {(max(i, j), min(i, j)) for (i, a), (j, b) in pairs if (a ^ b).bit_count() <= distance}


def test_simhash_edges(spark):
    text = sentence(random.Random(1), 40)
    rows = [(5, text), (None, text), (7, None), (8, ""), (9, " \t"), (7, text), (None, "only here"), (5, text)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, simhash int")
    found = [(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()]
    # document 7 has two texts, so it ties the empty ones to the others
    assert sorted(found, key=str) == sorted([(5, 5), (5, 5), (None, 5), (7, 5), (7, 5), (8, 5), (9, 5), (None, None)], key=str)
    assert sorted(r.doc_id or 0 for r in simhash.keep_first(docs).collect()) == [0, 0, 5]
    assert simhash.near_groups(docs.limit(0)).count() == 0 == simhash.keep_first(docs.limit(0)).count()


def test_components(spark):
    draw = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (None, 3)]
    links += [(draw.randint(300, 400), draw.randint(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def mutate(draw, text, n):
    text = list(text)
    for _ in range(n):
        kind, at = draw.randint(0, 2), draw.randint(0, max(0, len(text) - 1))
        if kind == 0 or not text:
            text.insert(at, draw.choice("abé"))
        elif kind == 1:
            del text[at]
        else:
            text[at] = draw.choice("abé")
    return "".join(text)


def test_edit_distance_bound():
    draw = random.Random(4)
    for _ in range(4000):
        a = "".join(draw.choice("ab") for _ in range(draw.randint(1, 10)))
        b = mutate(draw, a, draw.randint(0, 4)) if draw.random() < 0.8 else "b" * draw.randint(0, 5)
        for most in (0, 1, 2, 3):
            assert lines.within(a, b, most) == (edits(a, b) <= most)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_near_lines_lose_no_link(spark, most):
    draw = random.Random(most)
    texts = set()
    for _ in range(25):
        base = "".join(draw.choice("abcdefé ") for _ in range(draw.randint(14, 30))).strip() + "z"
        texts |= {base, *(mutate(draw, base, draw.randint(1, 4)).strip() + "z" for _ in range(5))}
    texts = sorted(t for t in texts if len(t) >= 12)
    table = spark.createDataFrame([("\n".join(texts[i::7]),) for i in range(7)], "text string").repartition(3)
    named = {np.int64(np.uint64(lines._name(t)).view(np.int64)): t for t in texts}
    got = {frozenset((named[r.a], named[r.b])) for r in lines.near_lines(table, most, 12).collect()}
    assert got == {frozenset(p) for p in combinations(texts, 2) if edits(*p) <= most}


def lines_by_force(rows, most, least, least_near):
    seen = {}
    for i, text in rows:
        for p, line in enumerate(text.split("\n")):
            line = line.strip(" \t\r")
            if len(line) >= least:
                seen.setdefault(line, []).append((i, p))
    root = {t: t for t in seen}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    long = [t for t in seen if len(t) >= least_near]
    for a, b in combinations(long, 2):
        if abs(len(a) - len(b)) <= most and edits(a, b) <= most:
            root[find(a)] = find(b)
    first = {}
    for t, places in seen.items():
        first[find(t)] = min(first.get(find(t), min(places)), min(places))
    out = []
    for i, text in rows:
        kept = []
        for p, line in enumerate(text.split("\n")):
            bare = line.strip(" \t\r")
            if len(bare) < least or first[find(bare)] == (i, p):
                kept.append(line)
        out.append((i, "\n".join(kept)))
    return out


def test_dedupe_lines(spark):
    draw = random.Random(8)
    bases = [sentence(draw, 12) for _ in range(6)] + ["Released under a licence.", "ok", "  "]
    rows = []
    for i in range(40):
        own = [draw.choice(bases) if draw.random() < 0.5 else sentence(draw, draw.randint(2, 14)) for _ in range(5)]
        rows.append((i, "\n".join(mutate(draw, x, draw.randint(0, 2)) if len(x) > 48 and draw.random() < 0.4 else x for x in own)))
    rows += [(50, rows[4][1]), (51, "\t" + bases[0] + " \r\n" + bases[0]), (52, "")]
    found = lines.dedupe_lines(spark.createDataFrame(rows, DOCS).repartition(4))
    assert sorted((r.doc_id, r.text) for r in found.collect()) == lines_by_force(rows, 2, 20, 48)


def test_edit_distance_bound_of_long_strings():
    draw = random.Random(14)
    for _ in range(400):
        a = "".join(draw.choice("abcdé") for _ in range(draw.randint(0, 70)))
        b = mutate(draw, a, draw.randint(0, 14))
        for most in (4, 7, 12):
            assert lines.within(a, b, most) == (edits(a, b) <= most)


def test_edit_distance_of_many_pairs():
    draw = random.Random(16)
    alphabets = ["abcdé", "".join(map(chr, range(0x100, 0x400))), "".join(map(chr, range(0x4E00, 0xD7FF)))]
    pairs, limits = [("", ""), ("", "abc"), ("abc", "")], [0, 2, 3]
    for alphabet in alphabets[:2]:
        for _ in range(600):
            a = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 70)))
            pairs.append((a, mutate(draw, a, draw.randint(0, 14)) if draw.random() < 0.9 else "b" * draw.randint(0, 9)))
            limits.append(draw.choice([0, 1, 2, 4, 7, 12]))
    expected = [edits(*p) <= n for p, n in zip(pairs, limits)]
    assert lines.all_within(pairs, np.array(limits)).tolist() == expected
    wide = alphabets[2] + "".join(map(chr, range(0x10000, 0x1A000)))  # more characters than 16 bits number
    assert lines.all_within([(wide, "x" + wide[1:] + "y"), (wide, wide[3:])], np.array([2, 2])).tolist() == [True, False]
    assert lines.all_within([], np.zeros(0, np.int64)).tolist() == []


def test_near_lines_with_a_changed_word(spark):
    draw = random.Random(12)
    texts = set()
    for n in [14] * 12 + [30] * 12 + [90] * 6:
        words = sentence(draw, n).split()
        texts.add(" ".join(words))
        for _ in range(4):
            at = draw.randrange(n)
            texts.add(" ".join([*words[:at], "".join(draw.choice("uvwxyz") for _ in range(draw.randint(3, 6))), *words[at + 1 :]]))
    texts = sorted(texts)
    table = spark.createDataFrame([("\n".join(texts[i::7]),) for i in range(7)], "text string").repartition(3)
    named = {np.int64(np.uint64(lines._name(t)).view(np.int64)): t for t in texts}
    got = {frozenset((named[r.a], named[r.b])) for r in lines.near_lines(table, 2, 20, 0.05).collect()}
    close = [(a, b) for a, b in combinations(texts, 2) if abs(len(a) - len(b)) <= 0.05 * max(len(a), len(b))]
    true = {frozenset(p) for p in close if edits(*p) <= max(2, 0.05 * max(map(len, p)))}
    assert got <= true and len(got) >= 0.99 * len(true) and len(true) > 100
    assert any(edits(*p) > 10 for p in true)


def test_lines_query_drops_a_line_with_a_changed_word(spark, tmp_path):
    draw = random.Random(15)
    line = sentence(draw, 40)
    near = " ".join([*line.split()[:20], "quince", *line.split()[21:]])
    rows = [(1, line), (2, near + "\n" + sentence(draw, 40))]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_removed for r in queries.op7_lines(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def test_lines_query_compares_short_lines(spark, tmp_path):
    rows = [(1, "ok\n\nIs it so? Yes, it is so.\nBe to."), (2, "\n ok\nIs it so. Yes, it is so.\nBy to.\n")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.n_removed, r.n_bytes) for r in queries.op7_lines(spark, str(tmp_path)).collect()}
    assert found == {1: (0, len(rows[0][1])), 2: (2, len("\nBy to.\n"))}


def test_dedupe_lines_edges(spark):
    line = "a line of text that is surely long enough for everything here"
    rows = [(None, line), (1, None), (2, line), (2, line), (3, f"{line}\n{line}x\n{line * 500}"), (4, "")]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, n_lines string")
    found = lines.dedupe_lines(docs)
    assert found.columns == ["doc_id", "text", "n_lines", "n_removed"]
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in found.collect()), key=str)
    expected = [(0, line, 1, 0), (1, None, 0, 0), (2, line, 1, 0), (2, line, 1, 0), (3, line * 500, 3, 2), (4, "", 1, 0)]
    assert got == sorted(expected, key=str)
    assert lines.dedupe_lines(docs.limit(0)).count() == 0


def test_contamination(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    item = lambda n: [draw.choice(words if draw.random() < 0.6 else WORDS) for _ in range(n)]
    items = [item(n) for n in (12, 25, 40, 55, 30)]
    filler = lambda n: [draw.choice(WORDS if draw.random() < 0.5 else [f"d{i}" for i in range(3000)]) for _ in range(n)]
    rows, planted = [], set()
    for i in range(60):
        text = filler(draw.randint(20, 300))
        if i % 4 == 0:
            k = draw.randrange(len(items))
            words_in = [w for j, w in enumerate(items[k]) if i % 8 or j % 6]  # every second one lacks some words
            at = draw.randint(0, len(text))
            text[at:at] = words_in
            planted.add((i, k))
        elif i % 4 == 1:
            k = draw.randrange(len(items))
            text[5:5] = items[k][: len(items[k]) // 4]  # too little to count
        rows.append((i, " ".join(text).title() if i % 3 else ", ".join(text)))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    table = [(k, " ".join(x)) for k, x in enumerate(items)] + [(7, None), (8, " !"), (None, "w1 w2")]
    found = decontaminate.find_contamination(docs, spark.createDataFrame(table, "item_id long, text string"))
    got = {(r.doc_id, m.item_id) for r in found.collect() for m in r.matches}
    assert got == planted


def test_contamination_is_fitted_on_all_passages(spark, monkeypatch):
    draw = random.Random(8)
    text = lambda n: " ".join(draw.choice("abcdefghijklmnop") for _ in range(n))
    rows = [(i, text(draw.randint(0, 90)), None) for i in range(2500)]  # more documents than the basis once came from
    rows += [(9000, None, None), (9001, "a " * 300, None), (9002, "a " * 300, None), (9003, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    vocabulary = {w: i for i, w in enumerate("abcdefgh")}
    n, passage = len(vocabulary), 8
    whole = np.zeros((n + 1, n + 1), np.int64)
    table = []
    for _, t, _ in rows:
        words = (t or "").split()
        for low in range(0, len(words), passage):
            line = np.zeros(n, np.int64)
            for w in words[low : low + passage]:
                if w in vocabulary:
                    line[vocabulary[w]] += 1
            table.append(line)
            whole[n, :n] += line > 0
            whole[n, n] += 1
    table = np.array(table)
    whole[:n, :n] = np.tril(table.T @ table)
    for held in (1 << 22, 4):  # also where a task must write what it has in between
        monkeypatch.setattr(decontaminate, "_HELD", held)
        monkeypatch.setattr(decontaminate, "_PAIRS", 1 << 10)
        joint = decontaminate._joint_counts(docs.select("text"), vocabulary, passage)
        found = np.zeros_like(whole)
        for r in joint.collect():
            found[r.term, np.frombuffer(r.others, np.int32)] = np.frombuffer(r.counts, np.int64)
        assert (found == whole).all()
    items = [np.array([0, 1, 2]), np.array([3, 3, 4])]
    weights = np.linspace(1.0, 2.0, n)
    basis = decontaminate._basis(joint, items, weights, 3, 5)
    matrix = np.vstack([table, [np.bincount(w, minlength=n) for w in items]]) * weights
    values, vectors = np.linalg.eigh(matrix.T @ matrix)
    assert np.allclose(basis @ basis.T, vectors[:, -3:] @ vectors[:, -3:].T, atol=1e-6)


def test_contamination_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "one two three four", 3), (4, "x " * 50000, 3)], "doc_id long, text string, matches int")
    items = spark.createDataFrame([(1, "One, two three four!"), (1, "one two three four")], "item_id long, text string")
    found = decontaminate.find_contamination(docs, items)
    assert found.columns == ["doc_id", "text", "matches"]
    got = {r.doc_id: [m.item_id for m in r.matches] for r in found.collect()}
    assert got == {1: [], 2: [], None: [1, 1], 4: []}
    assert all(not r.matches for r in decontaminate.find_contamination(docs, items.limit(0)).collect())
    assert decontaminate.find_contamination(docs.limit(0), items).count() == 0


def test_common_subsequence():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ([draw.randint(0, 4) for _ in range(draw.randint(1, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        assert decontaminate._common(a, b) == row[-1]


@pytest.mark.parametrize("shards, part_bytes", [(40, 1 << 27), (7, 3000)])
def test_shards(spark, sf, shards, part_bytes):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = sharding.histogram_shards(docs, shards, part_bytes=part_bytes)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    sizes, slots = {}, {}
    for r in rows:
        assert r.size == len(r.text.encode()) + 16
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / shards, max(r.size for r in rows)
    assert len(sizes) == shards and all(abs(s - mean) <= largest + 0.001 * mean for s in sizes.values())


def test_shards_are_ranges_and_split_a_hot_text(spark):
    draw = random.Random(3)
    rows = [(i, "hot text " * 4) for i in range(400)] + [(1000 + i, sentence(draw, 8)) for i in range(800)]
    rows += [(None, None), (None, "x"), (5, "hot text " * 4)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shard int").repartition(6)
    found = sharding.histogram_shards(docs, 8).withColumn("key", sharding.sort_key("doc_id", "text")).collect()
    assert len(found) == len(rows)
    ordered = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [r.key for r in ordered] == sorted(r.key for r in found)
    totals = [sum(r.size for r in found if r.shard == s) for s in range(8)]
    assert max(totals) - min(totals) <= 2 * max(r.size for r in found)
    assert len({r.shard for r in found if r.text == "hot text " * 4}) > 1


def test_shards_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    assert sorted((r.size, r.slot) for r in sharding.histogram_shards(docs, 40).collect()) == [(16, 0), (17, 0)]
    assert sharding.histogram_shards(docs.limit(0), 40).count() == 0
    with pytest.raises(ValueError, match="_key"):
        sharding.histogram_shards(docs.withColumn("_key", F.lit(1)), 4)


def nearest_by_force(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)
        out += [(q, r, i, round(-s, 9)) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("relax", [1.0, 1.1])
def test_neighbours(spark, relax):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 6)) * 3
    data = [centres[i % 8] + rng.standard_normal(6) * 0.3 for i in range(900)]
    data[100:160] = [data[100]] * 60  # one vector many times
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, relax=relax, shard_rows=250, block_rows=20, leaf=16)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect())
    true = nearest_by_force(rows, [r for r in rows if r[0] % 20 == 0], 20)
    if relax == 1.0:
        assert got == true
    else:
        assert len(set(g[::2] for g in got) & set(t[::2] for t in true)) >= 0.9 * len(true)


def test_factor_one_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.standard_normal((200, 3)) * 0.05 + c for c in rng.standard_normal((10, 3)) * 5])
    tree = neighbours.build(np.arange(2000), rows, 16, 1)
    queries = rows[:30]
    ids, scores = neighbours.search(tree, np.arange(30), queries, 5, 1.0)
    for q in range(30):
        products = rows @ queries[q]
        products[q] = -np.inf
        assert np.allclose(np.sort(products)[::-1][:5], scores[q])


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0])]
    rows += [(6, [None, 1.0]), (7, [0.5, 0.0]), (None, [9.0, 9.0]), (8, [1.0, 1.0, 1.0]), (9, []), (20, [1.0]), (40, [0.0, 0.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == [(0, 1, 1, 0.5), (0, 2, 7, 0.5)]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
