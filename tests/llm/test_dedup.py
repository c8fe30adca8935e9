from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np

from floatq.llm import line_dedup as L
from floatq.llm import near_dedup as N
from floatq.llm import shared
from floatq.llm.components import connected_components
from floatq.llm.exact_dedup import exact_dedup
from floatq.llm.shared import Scratch

SCHEMA = "doc_id long, text string, row string, kept string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    up = {v: v for v in nodes}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    return {v: find(v) for v in nodes}


def test_exact_dedup(spark):
    rows = [(i, f"Text {i % 7}" if i % 2 else f"own {i}", "x", "y") for i in range(300)]
    rows += [(400, None, "x", "y"), (401, "", "x", "y"), (402, "ÀB", "x", "y"), (403, "Àb", "x", "y"), (404, "àb", "x", "y"), (None, "Text 1", None, None), (405, "twice", "", ""), (405, "twice", "", ""), (406, "long " * 30_000, "", "")]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(20), min_copies=20).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = sorted((-1 if i is None else i, max(x for x in g if x is not None), len(g), i == max(x for x in g if x is not None), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()
    want = roots({v for e in links for v in e}, links)
    assert {r.id: r.component for r in got} == {v: c for v, c in want.items() if v != c}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []


def test_components_of_hubs_with_few_broadcasts(spark, monkeypatch):
    """Vertices with many edges, where only those may be broadcast, and where not even these may."""
    rng = random.Random(4)
    links = [(rng.choice([1, 900]), rng.randrange(1000)) for _ in range(700)] + [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(200)]
    want = {v: c for v, c in roots({v for e in links for v in e}, links).items() if v != c}
    for most, hot in ((5, 50), (0, 1)):
        monkeypatch.setattr(shared.pick_hot, "__defaults__", (most,))
        monkeypatch.setattr(shared, "MIN_HOT", hot)
        got = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()
        assert {r.id: r.component for r in got} == want


def measured_recall(texts, per_text, rng):
    """By similarity, the share of linked pairs that share a key and are let through by their sketches."""
    odd = L.multipliers(L.BANDS * L.ROWS, L.SEED)
    bound = N.sketch_bound(L.THRESHOLD / 100, L.BANDS * L.ROWS, L.SKETCH_BITS, L.DEVIATIONS)
    vocabulary = sorted({w for t in texts for w in t.split()})
    pairs = []
    for t in texts:
        for _ in range(per_text):
            w = t.split(" ")
            for at in rng.sample(range(len(w)), max(1, len(w) * rng.randrange(1, 12) // 100)):
                w[at] = rng.choice(vocabulary)
            pairs.append((t, " ".join(w)))
    pairs = [(a, b) for a, b in pairs if len(b) >= L.SHINGLE]
    low = [L.line_minima([p[k] for p in pairs], odd) for k in (0, 1)]
    keys, sketches = [L.band_keys(x, L.ROWS) for x in low], [N.odd_sketches(x, L.SKETCH_BITS).view(np.uint64) for x in low]
    found = (keys[0] == keys[1]).any(1) & (np.bitwise_count(sketches[0] ^ sketches[1]).sum(1, dtype=np.int64) <= bound)
    out = defaultdict(list)
    for (a, b), hit in zip(pairs, found.tolist(), strict=True):
        p, q = ({t[i : i + L.SHINGLE] for i in range(len(t) - L.SHINGLE + 1)} for t in (a, b))
        similarity = len(p & q) / len(p | q)
        if 0.8 <= similarity < 1:
            out[min(int(similarity * 20) / 20, 0.95)].append(hit)
    return {k: (sum(v) / len(v), len(v)) for k, v in sorted(out.items())}


def test_recall_of_lines(spark):
    """Lines of the documents against copies with changed words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    rng = random.Random(11)
    lines = sorted({x for r in docs for x in (r.text or "").split("\n") if 100 <= len(x) <= 700})
    got = measured_recall(rng.sample(lines, 600), 12, rng)
    print(got)
    assert all(n >= 100 for _, n in got.values()) and got[0.8][0] >= 0.995 and all(got[k][0] >= 0.999 for k in got if k > 0.8)


def words(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_near(rows, width):
    sets = {i: words(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, roots(ids, links)


def test_near_dedup_matches_brute_force(spark):
    """A group of copies with similarities around the threshold, so that hubs alone don't settle it."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=150)
    rows = []
    for i in range(260):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 3, 6, 8, 9, 11])):
            w[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(rng.choices(vocabulary, k=60))) for i in range(40)]
    rows += [(2000, ""), (2001, None), (2002, "one"), (2003, "ONE"), (2004, "one two"), (2005, " \t\n"), (2006, "é ё"), (2007, "É ё"), (2008, "x\u00a0y z"), (2009, " ".join(rng.choices(vocabulary, k=30_000)))]
    df = spark.createDataFrame([(i, t, "r", "k") for i, t in rows], SCHEMA).repartition(8)
    got = {r.doc_id: r for r in N.near_dedup(df, width=2).collect()}
    sizes, want = brute_near(rows, 2)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (sizes[i], want[i], want[i] == i) for i in sizes}


def test_near_dedup_of_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, same, None, None), (3, same, None, None), (3, same, None, None), (None, "", None, None)], SCHEMA)
    assert sorted(((r.doc_id or -1), r.component_id or -1, r.kept) for r in N.near_dedup(df).collect()) == [(-1, -1, True), (-1, 3, False), (3, 3, True), (3, 3, True)]
    assert N.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    a, b = N.permutations(N.BANDS * N.ROWS, 4)
    x = rng.integers(0, 1 << 32, 1000, dtype=np.uint64).astype(np.uint32)
    for share in (0.9, 0.8):
        n = round(1000 * share / (2 - share) * 2 / (1 + share / (2 - share)))  # shared of 1000 for this similarity
        y = np.concatenate([x[:n], rng.integers(0, 1 << 32, 1000 - n, dtype=np.uint64).astype(np.uint32)])
        low = np.stack([N.minima(x, a, b), N.minima(y, a, b)])
        p, q = N.odd_sketches(low, N.SKETCH_BITS).view(np.uint64)
        bits = int(np.bitwise_count(p ^ q).sum())
        true = n / (2000 - n)
        assert abs(bits - N.sketch_bits(true, N.BANDS * N.ROWS, N.SKETCH_BITS)) < 50
        assert bits <= N.sketch_bound(0.8, N.BANDS * N.ROWS, N.SKETCH_BITS, N.DEVIATIONS)


def brute_lines(rows):
    places = defaultdict(list)
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                places[line].append((i, p))
    keys = list(places)
    sets = [{k[i : i + L.SHINGLE] for i in range(max(1, len(k) - L.SHINGLE + 1))} for k in keys]
    links = [(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(range(len(keys)), links)
    best = {}
    for k, key in enumerate(keys):
        best[root[k]] = min([best.get(root[k], (1 << 60, 0)), *places[key]])
    drop = {p for k, key in enumerate(keys) for p in places[key] if p != best[root[k]]}
    return {i: t and "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in drop) for i, t in rows}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    common = [line(30) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [line(rng.randrange(1, 30)) for _ in range(3)]
        for c in rng.sample(common, 2):
            w = c.split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(30)] = line(1)
            parts.insert(rng.randrange(3), " ".join(w))
        parts += ["short", common[0]] if i % 9 == 0 else ["short"]
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "a line that is there twice\na line that is there twice"), (104, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, "r", "k") for i, t in rows], SCHEMA).repartition(6)
    got = L.line_dedup(df)
    assert got.columns == ["doc_id", "text", "row", "kept", "n_lines", "n_dropped"]
    got = {r.doc_id: r for r in got.collect()}
    assert {i: r.text for i, r in got.items()} == brute_lines(rows)
    assert got[103].n_dropped == 1 and got[103].n_lines == 2 and got[100].n_lines == 0
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lines_of_80_characters_are_linked_across_one_character(spark):
    """One changed character breaks 8 of 73 shingles: 65 of 81 are shared, which is over 0.8."""
    rng = random.Random(9)
    lines = ["".join(rng.choices("abcdefghij ", k=78)) for _ in range(200)]
    rows = [(i, f"x{t}y") for i, t in enumerate(lines)] + [(1000 + i, f"x{t[:39]}#{t[40:]}y") for i, t in enumerate(lines)]
    df = spark.createDataFrame([(i, t, "r", "k") for i, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: r.n_dropped for r in L.line_dedup(df).collect()}
    assert all(got[i] == 0 for i in range(200)) and sum(got[1000 + i] for i in range(200)) >= 198
    assert L.BANDS >= 12 and L.DEVIATIONS >= 4


def test_line_dedup_of_odd_rows(spark):
    text = "this line is long enough to count\nand this one too, as it is long"
    df = spark.createDataFrame([(None, text, None, None), (5, text, None, None), (5, text, None, None)], SCHEMA)
    assert sorted(((r.doc_id or -1), r.n_dropped) for r in L.line_dedup(df).collect()) == [(-1, 2), (5, 0), (5, 0)]


def test_line_names_are_sparks_hashes(spark):
    lines = ["Straße 1", "a", "x" * 100]
    got = spark.createDataFrame([(x,) for x in lines], "t string").selectExpr("xxhash64(t)", "xxhash64(1, t)").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in L.line_names(lines).tolist()]


def test_sets_of_lines_are_exact():
    """Lines of one byte a character as arrays, others as strings, and both against one another."""
    rng = random.Random(2)
    shape = L.LineShingles(80)
    for _ in range(300):
        a = "".join(rng.choices("aäß " if rng.random() < 0.7 else "aä€ ", k=rng.randrange(8, 60)))
        b = a[: rng.randrange(len(a))] + rng.choice(["", "x", "€"]) + a[rng.randrange(len(a)) :]
        if len(b) < 8:
            continue
        p, q = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (a, b))
        assert shape.linked(shape.of(a), shape.of(b)) == (100 * len(p & q) >= 80 * len(p | q)), (a, b)


def test_line_dedup_keeps_columns_of_all_names(spark):
    """Extra columns named like its own."""
    rows = [(1, "same line of text here\nb", 1, "x", "y", "z", "w"), (2, "same line of text here\n\n \nshort\nshort", 2, "x", "y", "z", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, lost string, kept_lines string, cut string, `a b` string")
    got = L.line_dedup(df).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["same line of text here\nb", "\n \nshort"] and [r.row for r in got] == [1, 2]
    assert all((r.lost, r.kept_lines, r.cut, r["a b"]) == ("x", "y", "z", "w") for r in got)
