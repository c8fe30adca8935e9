"""The pipeline against a plain version of each stage, on a small fixture."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from floatq.llm import quality
from tests.llm.test_dedup import brute_lines, brute_near
from tests.llm.test_text import brute_quality

pipeline = pytest.importorskip("corpus_pipeline")


def fixture(spark, folder):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(900)]
    common = quality.COMMON_WORDS["en"]

    def sentence(n):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)).capitalize() + "."

    rows = []
    for i in range(90):
        rows.append((i, "\n".join(sentence(rng.randrange(6, 40)) for _ in range(rng.randrange(3, 9))), "en"))
    for i in range(90, 110):  # near copies that share no line of the same text
        w = rows[i - 90][1].replace("\n", " ").split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), "en"))
    rows += [(120, rows[5][1], "en"), (121, rows[5][1].upper(), "en"), (122, "too short", "en"), (123, None, "en"), (124, "### $$$ &&& " * 60, "en"), (125, sentence(12) + " " + sentence(9) * 12, "en"), (126, "\n".join([common and sentence(400)] * 1), None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    return rows


def shares(counts):
    total = sum(counts)
    return [c / total for c in counts] if total else None


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return float(np.sqrt(max(0.0, (kl(p) + kl(q)) / 2)))


def classes(text):
    import regex

    count = lambda p: len(regex.findall(p, text))
    named = [count(r"\p{Lu}"), count(r"\p{Nd}"), count(r"[#*$%&|<>]"), count(r"(?![#*$%&|<>])\p{P}")]
    space = count(r"[\x20\x09-\x0D]")
    return [*named, space, max(0, len(text) - sum(named) - space)]


def common(text, lang):
    words = text.split()
    hits = Counter(w.lower() for w in words if w in {x for k in quality.COMMON_WORDS[lang] for x in (k, k.capitalize(), k.upper())})
    out = [hits[k] for k in quality.COMMON_WORDS[lang]]
    return [*out, len(words) - sum(out)]


def brute_pipeline(rows):
    base = {i: brute_quality(t) for i, t, _ in rows}
    good = [(t, lang) for i, t, lang in rows if not base[i][5] and lang in quality.COMMON_WORDS]
    refs = {lang: (shares(np.sum([classes(t) for t, x in good if x == lang], 0)), shares(np.sum([common(t, lang) for t, x in good if x == lang], 0))) for lang in {x for _, x in good}}
    kept = []
    for i, t, lang in rows:
        n, chars = base[i][:2]
        if base[i][5]:
            continue
        if lang in refs:
            if chars >= quality.MIN_CHARS_FOR_CLASSES and js(shares(classes(t)), refs[lang][0]) > quality.MAX_CLASS_DISTANCE:
                continue
            if n >= quality.MIN_WORDS_FOR_COMMON and js(shares(common(t, lang)), refs[lang][1]) > quality.MAX_WORD_DISTANCE:
                continue
        kept.append((i, t))
    lines = brute_lines(kept)
    left = [(i, lines[i]) for i, _ in kept if lines[i].strip()]
    _, component = brute_near(left, 5)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, t in left:
        if component[i] == i:
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
            out += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    return [i for i, _ in kept], out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = fixture(spark, tmp_path)
    kept, want = brute_pipeline(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns and sorted(r.doc_id for r in first.collect()) == sorted(kept)
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert {124, 122, 123} & {r.doc_id for r in got} == set() and 0 < len(got) < len(rows)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048


def test_stages_take_tables_without_rows(spark, tmp_path):
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
