from __future__ import annotations

import functools
import html
import math
import random
import re
import time

from pyspark.sql import functions as F

from floatq.llm import licenses, quality, url_filter
from floatq.llm import html_text
from floatq.llm.html_text import align, extract, marks, parse, rebuild, region, skeleton
from floatq.llm.queries import BAD_HOST_WORDS, URL_RULES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DATA = "/root/testdata/sf0.001"


def brute_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {p for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def histograms(text, lang):
    t, w = text or "", brute_quality(text)
    classes = [sum(c.isupper() and len(c.lower()) > 0 and c.upper() == c and c.isalpha() for c in t), sum(c.isdecimal() for c in t)]
    return classes, [sum(x.lower() == r for x in re.split(r"[\x20\x09-\x0D]+", t) if x) for r in quality.COMMON_WORDS.get(lang, [])], w[0]


def test_quality_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    phrase = " ".join(f"w{i}" for i in range(9))
    odd = [(9001, None, "en"), (9002, "", None), (9003, f"{phrase} {phrase} " + " ".join(f"v{i}" for i in range(60)), "en"), (9004, "a " * 50, "xx"), (9005, "l\nl\n \nl\n", "en"), (None, "x#|<>&", "en"), (9006, f"{phrase} x {phrase} y {phrase}", "en"), (9007, "word " * 40_000, "en")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = quality.quality_rules(docs)
    assert set(docs.columns) <= set(got.columns)
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.text), r.doc_id
        assert not (r.base_failed and r.kept)
        if r.js_common is not None:
            assert 0 <= r.js_common <= 1 and r.n_words >= quality.MIN_WORDS_FOR_COMMON
    assert quality.quality_rules(docs.limit(0)).collect() == []


def test_quality_keeps_columns_of_all_names(spark):
    """Extra columns named like those used inside, and repeated rows."""
    names = ["_list", "_s", "_t", "_common", "_ref_lang", "_others", "_text", "_lang", "_w", "a b", "l"]
    rows = [(i % 2, "some words of a text " * 9, "en", *[f"{n}{i}" for n in names]) for i in (1, 2, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    got = quality.quality_rules(df)
    assert got.columns[: len(df.columns)] == df.columns
    assert sorted(tuple(r)[: len(df.columns)] for r in got.collect()) == sorted(rows)
    assert "text" not in quality.quality_rules(df, keep_text=False).columns


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality.quality_rules(docs).join(labels, "doc_id").where("n_words >= 100")
    kept, clean, junk, out = r.agg(*[F.expr(f"count_if({c})") for c in ("quality = 1 AND (kept OR base_failed)", "quality = 1", "quality = 0", "quality = 0 AND NOT kept")]).first()
    assert kept == clean and out > 0.8 * junk


def test_quality_judges_other_languages_by_classes(spark):
    prose = lambda i: " ".join(f"word{'abcdefghij'[(i + k) % 10]}{'klmnopqrst'[k // 10]}" for k in range(90)) + "."
    junk = lambda i: " ".join(f"{i * 1000 + k * 7919}#|{k}" for k in range(90))
    rows = [(i, prose(i), "en") for i in range(40)] + [(100, prose(3), None), (101, prose(4), "EN")]
    rows += [(200 + i, junk(i), lang) for i, lang in enumerate([None, "EN", "xx", None, None, None, None, None])]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in (*range(40), 100, 101))
    assert all(not got[200 + i].base_failed and not got[200 + i].kept and got[200 + i].js_common is None for i in range(8))


def test_js_distance(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0], [1.0, 0.0, 1.0]), ([2.0, 2.0, 0.0], [5.0, 5.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "p array<double>, q array<double>")
    got = [r.d for r in df.select(quality.js_distance("p", "q").alias("d")).collect()]
    assert math.isclose(got[0], math.sqrt(0.5)) and got[1] == 0 and got[2] is None


def test_license_base_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    mit = "Permission is hereby granted, free of charge, to any dear person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction"
    odd = [(9001, None), (9002, ""), (9003, "The MIT license, the mit License and the GNU General Public License"), (9004, f"x {mit} y"), (None, "Apache License"), (9005, "mit\x80license mit"), (9006, "MIT license " * 5000), (9007, "All rights reserved.")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    docs = docs.union(docs.where("doc_id = 9003")).withColumn("row", F.lit(1)).withColumn("labels", F.lit(1))
    got = licenses.license_scan(docs)
    assert got.count() == docs.count()
    text_of = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in got.collect()}
    for i, r in found.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text_of[i] or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))), i
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert found[9004].labels == "mit" and found[9004].n_base == 0 and found[9007].labels == "all-rights-reserved"
    assert licenses.license_scan(docs.limit(0)).collect() == []


def brute_labels(text):
    """Labels and score by the stated rule, with plain loops."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels, score = set(), 0.0
    for phrases, base in ((licenses.BASE, True), (licenses.NOTICES, False)):
        for phrase, label in phrases.items():
            w = phrase.split()
            n = len(w) - 1
            hits = [(p, t) for p in range(len(words) - 1) for t in range(n) if words[p : p + 2] == w[t : t + 2]]
            if base:
                if any({t for p, t in hits if p - t == d} == set(range(n)) for d in {p - t for p, t in hits}):
                    labels.add(label)
                    score = 1.0
                continue
            chains = []
            for d in sorted({p - t for p, t in hits}):
                if not chains or d - chains[-1][-1] > licenses.NEAR:
                    chains.append([])
                chains[-1].append(d)
            for chain in chains:
                own = [(p, t) for p, t in hits if p - t in chain]
                share = len({t for _, t in own}) / n
                first, last = min(own)[0], max(own)[0]
                if share >= licenses.LEAST_SHARE and last - first + 1 > licenses.MOST_EXTENT * n:
                    extent = int(licenses.MOST_EXTENT * n)
                    share = max(len({t for p, t in own if at <= p < at + extent}) / n for at in range(first, last + 1))
                score = max(score, share)
                labels |= {label} if share >= licenses.LEAST_SHARE else set()
    return ",".join(sorted(labels)), score


def test_license_labels_match_brute_force(spark):
    """Notices with words inserted, lost and changed, copies side by side, and repeated rows."""
    rng = random.Random(6)
    phrases = [*licenses.BASE, *licenses.NOTICES]
    rows = [(0, None), (1, ""), (2, "license"), (3, "all rights reserved " * 300)]
    for i in range(4, 200):
        words = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(phrases).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice([[], ["x"], ["the", "license"]])
            words += w * rng.choice([1, 1, 2, 3]) + ["and"] * rng.randrange(5)
        rows.append((i, " ".join(words).upper()))
    rows += rows[-20:]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.labels, round(r.score, 9)) for r in got) == sorted((i, labels, round(score, 9)) for i, t in rows for labels, score in [brute_labels(t)])


def test_license_copies_side_by_side(spark):
    rows = [(1, "All rights reserved. All rights reserved."), (2, "All rights reserved. Some rights reserved"), (3, "eclipse public license " * 500), (4, "all x y z rights x y z reserved")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["all-rights-reserved", "all-rights-reserved", "epl", ""]
    assert got[3].score == 1


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    best = None
    for rule, verdict in URL_RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_url_rules_and_trees(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(9001, None), (9002, ""), (9003, "no scheme"), (9004, "http://"), (9005, "HTTP://WWW.EXAMPLE.COM/en/x?y=://z"), (9006, "x://example.com?q"), (9007, "https://a.net/es/#f"), (9008, "http://notexample.com/en/"), (None, "http://casino-win.example.org/"), (9009, "http://ä.net/" + "x" * 50_000)]
    pages = pages.union(spark.createDataFrame(odd, pages.schema)).withColumn("rule", F.lit(1)).withColumn("host", F.lit(1))
    pages = pages.union(pages.where("page_id = 9005"))
    labelled = label_by_words(pages.select("url"), F.lit(True))
    got = url_filter.url_filter(pages, URL_RULES, labelled).collect()
    assert len(got) == pages.count()
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in got:
        host, path, best = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else "block" if r.block_score > 0.5 else "allow")
    assert url_filter.url_filter(pages.limit(0), URL_RULES, labelled.limit(0)).collect() == []
    assert {r.verdict for r in url_filter.url_filter(pages, [], labelled.limit(0)).collect()} == {"allow"}


def label_by_words(urls, known):
    host = url_filter.parts("url")[0]
    bad = F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, BAD_HOST_WORDS)))
    return urls.select("url", F.when(known, bad.cast("int")).alias("label"))


def test_url_trees_judge_hosts_they_have_not_seen(spark):
    """Whole hosts are held out, so neither a URL nor its host was learned."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host = url_filter.parts("url")[0]
    judged, right, found = 0, 0, 0
    for part in range(3):  # five hosts of 60 are bad, so a split may leave two to learn from
        held_out = F.pmod(F.xxhash64(host), F.lit(3)) == part
        got = url_filter.url_filter(pages, [], label_by_words(pages, ~held_out)).where(F.pmod(F.xxhash64("host"), F.lit(3)) == part).collect()
        bad = [bool(set(re.split("[.-]", r.host)) & set(BAD_HOST_WORDS)) for r in got]
        judged += len(got)
        right += sum((r.verdict == "block") == b for r, b in zip(got, bad, strict=True))
        found += sum(r.verdict == "block" and b for r, b in zip(got, bad, strict=True))
    assert judged == pages.count() and right >= 0.96 * judged and found >= 60


def test_url_suffixes_count_all_rows_and_rare_blocks_are_fitted(spark):
    rows = [(i, f"http://h{i}.site{i % 50}.com/") for i in range(3000)] + [(5000 + i, f"http://casino{i}.bad.net/") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns(dict(zip(("host", "path"), url_filter.parts("url"), strict=True)))
    labelled = df.select("url", "host", "path", F.col("host").endswith("bad.net").cast("int").alias("label"))
    model = url_filter.UrlModel(labelled, url_filter.Scratch(spark, "test"), 40)
    assert {r.suffix: (r.rows, r.blocked) for r in model.suffixes.where("suffix LIKE '2 %'").collect()} == {f"2 site{k}.com": (60, 0) for k in range(50)} | {"2 bad.net": (5, 5)}
    got = {r.page_id: r.verdict for r in url_filter.url_filter(df.select("page_id", "url"), [], labelled, sample_rows=40).collect()}
    assert {i for i, v in got.items() if v == "block"} == {5000 + i for i in range(5)}


def text(source):
    return "\n".join(b.text for b in parse(source)[1] if marks(b))


def test_parse_blocks():
    page = '<body><p>a&amp;b <i>c</i>d<br>e\n f<p>g</p><!-- <p>no</p> --><script>var x="</p>";</script><ul class="site-menu"><li>m</li></ul><aside>s</aside>h<footer>f</footer><form>q</form><div id="comments"><p>r</p></div>'
    assert text(page) == "a&b cd e f\ng\nh"
    assert text("1 < 2 & 3") == "1 < 2 & 3" and text("") == "" and text("<head><title>x</title><body>y") == "y"
    assert text("<article><h1>t</h1><p><b>one.<br><p>two</article>") == "t\none.\ntwo"


def test_parse_takes_linear_time():
    """Many "<" without ">", open quotes, comments and elements that never close, and deep nesting."""
    n = 60_000
    for source in ("<" * n, "<a " * n, "<p '" * n, "<p \"x' " * n + ">", "<!-- " * n, "<button>" * n, "</p>" * n, "<div>" * n + "</p>" * n, "<b x='>" * n):
        began = time.perf_counter()
        root, _ = parse(source)
        skeleton(root)
        assert time.perf_counter() - began < 5, source[:20]
    assert text("<p>a < b <c</p>") == "a < b"
    assert text('<p title="x > y">a</p><p title="never closed>b</p><p>c</p>') == "a\nb\nc"
    deep = parse("<div>" * 3000 + "text" + "</div>" * 3000)[0]
    assert max(n.level for n, _ in align(deep, parse("<div>" * 3000)[0])) == html_text.MAX_DEPTH


def brute_matching(x, y):
    """The size of the largest matching, by trying all pairs."""

    @functools.cache
    def best(i, j, a, b):
        p, q = nodes_a[a].children, nodes_b[b].children
        if i == len(p) or j == len(q):
            return 0
        most = max(best(i + 1, j, a, b), best(i, j + 1, a, b))
        if p[i].kind == q[j].kind:
            most = max(most, best(i + 1, j + 1, a, b) + 1 + best(0, 0, p[i].number, q[j].number))
        return most

    nodes_a, nodes_b = rebuild(skeleton(x)), rebuild(skeleton(y))
    return 1 + best(0, 0, 0, 0)


def test_align_is_the_largest_matching():
    rng = random.Random(1)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "section", "ul"], k=rng.randrange(4)))

    for _ in range(150):
        a, b = parse(tree(3))[0], parse(tree(3))[0]
        pairs = align(a, b)
        assert len(pairs) == brute_matching(a, b)
        assert all(x.kind == y.kind for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_align_of_long_lists_is_the_largest():
    """Lists of a thousand elements, in which what matches lies far from the diagonal; some have children."""
    rng = random.Random(2)
    items = [f"<li>{rng.choice(['', '<p></p>', '<ul><li></li></ul>', '<p></p><h2></h2>'])}</li>" if rng.random() < 0.5 else "<p></p>" for _ in range(600)]
    long, short = parse("<section></section>" * 700 + "".join(items))[0], parse("".join(items))[0]
    for a, b in ((long, short), (short, long)):
        pairs = align(a, b)
        assert len(pairs) == len(rebuild(skeleton(short)))
        assert all(x.kind == y.kind for x, y in pairs)


def test_align_takes_the_same_pairs_at_any_size(monkeypatch):
    rng = random.Random(3)

    def tree(depth, width):
        return "".join(f"<{t}>{tree(depth - 1, width) if depth else ''}</{t}>" for t in rng.choices(["div", "section", "ul"], k=rng.randrange(width)))

    for depth, width in [(3, 4), (2, 9), (1, 25), (0, 200)] * 25:
        a, b = parse(tree(depth, width))[0], parse(tree(depth, width))[0]
        found = []
        for cells, kept in ((10**9, 1 << 27), (0, 1 << 27), (0, 1), (40, 1)):
            monkeypatch.setattr(html_text, "CELL_BY_CELL", cells)
            monkeypatch.setattr(html_text, "CELLS_KEPT", kept)
            found.append({(id(x), id(y)) for x, y in align(a, b)})
        assert all(f == found[0] for f in found)


def test_region_goes_down_to_the_text():
    nodes = rebuild(skeleton(parse("<div>ad</div><main><nav>n</nav><section><h2>t</h2><div><p>a</p><p>b</p></div></section></main><div>f</div>")[0]))
    at = {n.kind: n.number for n in nodes}
    assert region(nodes, {at["p"]: 50.0, at["p"] - 1: 50.0, at["div"]: 3.0}) == (at["p"] - 2, at["p"])
    assert region(nodes, {at["p"]: 50.0, at["p"] - 1: 50.0, at["h2"]: 9.0}) == (at["section"], at["p"])
    assert region(nodes, {}) == (0, len(nodes) - 1)


def test_extraction_of_the_pages_table(spark):
    """The main text of these pages is what stands in their article element."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.sub(r"<!--.*?-->", "", r.html, flags=re.DOTALL).split("<article>", 1)[1].split("</article>", 1)[0].split("<footer>", 1)[0]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(" ".join(x.split()) for x in blocks if x.split()), r.page_id


def test_alignment_decides(spark, monkeypatch):
    """Without the alignment, unmarked boilerplate would count as text and marked teasers as the article."""
    rows = [(i, f"http://a.example/{i}", f"<div>Welcome to us</div><div><p>First paragraph {i} of the story</p><p>Second one {i * 7}</p></div><div>All about {i}</div><article class='x'>See {i}</article>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"First paragraph {i} of the story\nSecond one {i * 7}" for i in range(8)}
    assert {r.page_id: r.text for r in extract(df).collect()} == want
    monkeypatch.setattr(html_text, "LEAST_PAGES", 1_000)
    assert {r.page_id: r.text for r in extract(df).collect()} == {i: f"See {i}" for i in range(8)}


def test_extraction_learns_templates(spark):
    """Without an article, what is alike on a host's pages is template and what varies is content."""
    page = lambda i: f"<html><body><div>Welcome to our site</div><div>Story number {i}</div><div><p>Body {i} &eacute;</p></div><div>Call us now</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i), "x", "y") for i in range(8)]
    rows += [(20, "http://h.example/a", None, None, None), (21, None, "<p>alone</p>", None, None), (22, "x", "", None, None), (None, "http://o.example/", "<article><nav>n</nav><p>kept</p></article><p>not</p>", None, None), (23, "http://big.example/", "<p>" + "w " * 100_000, None, None)]
    rows += [rows[3]]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    text_of = {r.page_id: r.text for r in got}
    assert {i: text_of[i] for i in range(8)} == {i: f"Story number {i}\nBody {i} é" for i in range(8)}
    assert (text_of[20], text_of[21], text_of[22], text_of[None]) == ("", "alone", "", "kept")
    assert all(r.n_chars == len(r.text) for r in got) and len(text_of[23]) == 199_999
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_extraction_keeps_copies_of_a_page(spark):
    """Copies under several addresses are one page, and no page loses all its text to a template."""
    page = "<div>Head</div><div><p>The story that was copied</p></div>"
    rows = [(i, f"http://c.example/{i}", page) for i in range(6)]
    rows += [(10 + i, f"http://d.example/{i}", f"<div>Head</div><p>Copied story</p>{'<nav>' + str(i) + '</nav>'}") for i in range(6)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(6)} == {"Head\nThe story that was copied"}
    assert {got[i] for i in range(10, 16)} == {"Head\nCopied story"}


def test_extraction_judges_marked_articles_by_template(spark):
    inside = lambda i: f"<main><div>By our staff</div><p>Long story with number {i}</p><div>Read also these</div></main>"
    teaser = lambda i: f"<div><p>The main text of page {i} is in a plain element</p></div><aside><article>Teaser {i}</article></aside><article class='comment'>Nice {i}</article><article>More here</article>"
    rows = [(i, f"http://m.example/{i}", inside(i)) for i in range(6)] + [(10 + i, f"http://t.example/{i}", teaser(i)) for i in range(6)]
    rows += [(20, "http://one.example/", "<div>Menu of all things</div><article>Short</article>"), (21, "http://two.example/", "<div>Text</div><article class='comment'>Nice</article>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Long story with number {i}" for i in range(6)} | {10 + i: f"The main text of page {i} is in a plain element" for i in range(6)} | {20: "Short", 21: "Text"}
