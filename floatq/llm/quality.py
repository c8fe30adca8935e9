"""Quality rules by distribution divergence (DataFrame operations only).

Base rules count words, symbols, repeated lines and repeated 8-word windows. The divergence rule
compares a document's histogram of character classes, and of the common words of its language, with
reference histograms of that language by the Jensen-Shannon distance (base 2, 0 to 1).

References are sums over all documents of a language that pass the base rules, so they
follow the corpus; languages with a word list below have one each. Documents of all other or no language are compared by
character classes with the sum over these (over all documents if there is none of them), as a source of junk could be most of
its own language or move a sum that it is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, gathered, quoted

# Frequent words of four languages, in natural order.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "as", "with", "was", "on", "be", "by", "are", "this", "from", "or", "an"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "pas", "avec"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
# White space that ends words, and symbols.
SPACE, SYMBOLS = r"\x20\x09-\x0D", r"#*$%&|<>"
WINDOW = 8
#: Documents with fewer words, or failing the repeat share in percent, fail the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Least word characters and words for the two distances, and the largest distances of kept documents.
MIN_CHARS_FOR_CLASSES, MIN_WORDS_FOR_COMMON = 100, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.33, 0.3
#: What is not of a character class, as Java patterns; white space and all else, mostly small letters, are two more classes.
CLASSES = {"upper": r"\P{Lu}++", "digit": r"\P{Nd}++", "symbol": r"[^#*$%&|<>]++", "point": r"[\P{P}#*$%&|<>]++"}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def repeated_window_words(words: str) -> list[tuple[str, Column]]:
    """Columns to add in turn; the last, ``n_repeat_words``, counts the words in repeated windows.

    Windows of 8 words are compared by 64-bit hashes, made from those of 4 words and of 2. Only rows with a repeated hash sort theirs. An array that a
    lambda looks into is named twice, so that the optimizer keeps it as a column instead of moving
    its expression into the lambda, where it would be computed for each element.
    """
    pairs = lambda c, step: F.expr(f"CASE WHEN size({c}) > {step} THEN zip_with({c}, slice({c}, {step} + 1, size({c})), (a, b) -> xxhash64(a, b)) END")
    return [
        ("_h1", F.expr(f"transform({words}, w -> xxhash64(w))")),
        ("_h2", pairs("_h1", 1)),
        ("_h4", pairs("_h2", 2)),
        ("_h8", pairs("_h4", 4)),
        ("_h", F.expr(f"CASE WHEN size(_h8) >= {WINDOW} THEN slice(_h8, 1, size(_h8) - {WINDOW} + 1) END")),
        ("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN array_sort(transform(_h, (h, i) -> struct(h, i))) END")),
        ("_p", F.expr("CASE WHEN _s IS NOT NULL THEN array_sort(transform(filter(_s, (e, j) -> e.h = get(_s, j - 1).h OR e.h = get(_s, j + 1).h), e -> e.i)) END")),
        (
            "n_repeat_words",
            F.expr(
                f"coalesce(aggregate(_p, struct(0L AS upto, 0L AS n), (a, p) -> struct(CAST(p + {WINDOW} AS BIGINT) AS upto, a.n + least({WINDOW}L, p + {WINDOW} - a.upto) AS n), a -> a.n), 0L)"
            ),
        ),
    ]


def features(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``_text`` and ``_lang``) with the base counts, ``base_failed`` and two histograms (``_classes``, ``_common``)."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    known = sorted({w for words in COMMON_WORDS.values() for w in words})
    length = lambda c: F.char_length(c).cast("long")
    df = docs.withColumn("_t", text).withColumn("_w", F.expr(rf"filter(split(_t, r'[{SPACE}]+'), w -> w != '')"))
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", length(F.array_join("_w", "")))
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"_{name}", length(F.regexp_replace("_t", pattern, "")))
    df = df.withColumn("n_symbols", F.col("_symbol"))
    df = df.withColumn("_l", F.expr(rf"filter(split(_t, '\n'), l -> l rlike r'[^{SPACE}]')")).withColumn(
        "n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")
    )
    for name, column in repeated_window_words("_w"):
        df = df.withColumn(name, column)
    df = df.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )
    counted = sum((F.col(f"_{x}") for x in CLASSES), F.lit(0))
    space = length("_t") - F.col("word_chars")
    df = df.withColumn("_classes", F.array(*[F.col(f"_{x}") for x in CLASSES], space, F.greatest(F.lit(0), length("_t") - counted - space)))
    quoted = ", ".join(f"'{x}'" for w in known for x in dict.fromkeys((w, w.capitalize(), w.upper())))
    df = df.withColumn("_k", F.expr(f"transform(filter(_w, w -> w IN ({quoted})), w -> lower(w))"))
    lists = F.create_map(*[F.lit(x) for lang, words in COMMON_WORDS.items() for x in (lang, words)])
    df = df.withColumn("_list", lists[F.col("_lang")]).withColumn("_hits", F.expr("CASE WHEN size(_k) >= 0 THEN transform(_list, r -> size(filter(_k, w -> w = r)) * 1L) END"))
    df = df.withColumn("_common", F.expr("concat(_hits, array(n_words - aggregate(_hits, 0L, (a, x) -> a + x)))"))
    return df.select(*docs.columns, *FEATURES, "_classes", "_common")


def listed() -> Column:
    """The language if it has a word list, else null."""
    return F.when(F.col("_lang").isin(list(COMMON_WORDS)), F.col("_lang"))


def references(table: DataFrame, scratch: Scratch) -> DataFrame:
    """Summed histograms per language with a word list, and of null that of the classes over these, or over all if there is none."""
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[i]).cast("double") for i in range(n)])
    groups = table.where(~F.col("base_failed")).groupBy(listed().alias("_ref_lang"))
    groups = scratch.save(groups.agg(sums("_classes", len(CLASSES) + 2).alias("_ref_classes"), sums("_common", 21).alias("_ref_common")), "groups")
    sides = [groups.where(w).agg(sums("_ref_classes", len(CLASSES) + 2).alias("c")) for w in ("_ref_lang IS NOT NULL", "_ref_lang IS NULL")]
    both = sides[0].crossJoin(sides[1].withColumnRenamed("c", "d")).select(F.when(F.col("c")[0].isNotNull(), F.col("c")).otherwise(F.col("d")).alias("_ref_classes"))
    other = both.select(F.lit(None).cast("string").alias("_ref_lang"), "_ref_classes", F.lit(None).cast("array<double>").alias("_ref_common"))
    return groups.where("_ref_lang IS NOT NULL").unionByName(other)


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; null if either is null or all zero."""
    total = lambda a: f"aggregate({a}, 0D, (s, y) -> s + y)"
    share = lambda a: f"transform({a}, x -> x / {total(a)})"
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (a + b)) ELSE 0D END"
    parts = f"zip_with({share(p)}, {share(q)}, (a, b) -> ({term.format('a')} + {term.format('b')}) / 2)"
    return F.expr(f"CASE WHEN {total(p)} > 0 AND {total(q)} > 0 THEN sqrt(greatest(0D, aggregate({parts}, 0D, (s, x) -> s + x))) END")


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep_text: bool = True, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_classes, js_common, kept.

    A null text counts as empty and fails for want of words. A document in a language without a word
    list, or in none, has no js_common and is compared with the classes of the listed languages. One shorter than the guards has null distances and is judged by the base rules alone. The
    columns this adds replace columns of the same name. Rows are judged one by one, so repeated rows and null or repeated ids
    are kept as they are. ``keep_text=False`` drops the text, which makes the written table small.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    added = [*FEATURES, "js_classes", "js_common", "kept"]
    columns = [c for c in docs.columns if c.lower() not in added]
    # The caller's other columns travel in one, so that no name meets those used here.
    others = [F.col(quoted(c)) for c in columns if c not in (text_col, lang_col)] or [F.lit(None).alias("none")]
    table = features(gathered(docs).select(F.struct(*others).alias("_others"), F.col(quoted(text_col)).alias("_text"), F.col(quoted(lang_col)).cast("string").alias("_lang")))
    table = scratch.save(table if keep_text else table.drop("_text"), "features")
    refs = scratch.save(references(table, scratch), "references")
    df = table.join(F.broadcast(refs), listed().eqNullSafe(F.col("_ref_lang")), "left")
    df = df.withColumn("js_classes", F.when(F.col("word_chars") >= MIN_CHARS_FOR_CLASSES, js_distance("_classes", "_ref_classes")))
    df = df.withColumn("js_common", F.when(F.col("n_words") >= MIN_WORDS_FOR_COMMON, js_distance("_common", "_ref_common")))
    far = (F.coalesce("js_classes", F.lit(0.0)) > max_class) | (F.coalesce("js_common", F.lit(0.0)) > max_word)
    df = df.withColumn("kept", ~F.col("base_failed") & ~far)
    back = {text_col: F.col("_text"), lang_col: F.col("_lang").cast(docs.schema[lang_col].dataType)} if keep_text else {lang_col: F.col("_lang").cast(docs.schema[lang_col].dataType)}
    return df.select(*[back.get(c, F.col(f"_others.{quoted(c)}")).alias(c) for c in columns if keep_text or c != text_col], *added)
