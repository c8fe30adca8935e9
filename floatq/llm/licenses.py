"""License scans by diagonal voting.

Words of a text give rolling hashes of two-word grams. Hashes that no template has are dropped inside the row; the others are
joined to the grams of the license templates and compared with them word by word. A hit at text position p and template
position t votes for the diagonal p - t. On an exact copy all grams of a template vote for one diagonal; inserted or lost
words move the votes to neighbouring diagonals, which are merged; chains of copies are cut into windows. A span is verified
by the share of the template's grams whose words stand in it and by its extent. The votes of a diagonal are a bit mask of the template's
grams, so no list is built. The template grams are a fixed set, which bounds the broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, quoted

# What separates words, and the base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notices, lower-cased and without punctuation, with labels.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "mozilla public license version 2 0": "mpl",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Diagonals this near are one span; least share of a notice's grams in it, and its largest extent in lengths of the notice.
NEAR, LEAST_SHARE, MOST_EXTENT = 3, 0.8, 1.5
#: Steps of an extent in which places are told apart, over two for each word of the longest.
SCALE = 1024


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, label, base, t, n): a row per two-word gram, at word t of a template with n grams (63 at most, as they are bits)."""
    rows = []
    for i, (text, label) in enumerate([*BASE.items(), *NOTICES.items()]):
        words = text.split(" ")
        n = len(words) - 1
        rows += [f"('{words[t]} {words[t + 1]}', {i}, '{label}', {i < len(BASE)}, {t}, {n})" for t in range(n)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS grams(gram, template, label, base, t, n)")


def gram_hits() -> str:
    """SQL of (p, gram) for each place of ``w`` where a template's gram may begin; reads ``w`` and its rolling hashes ``h``."""
    grams = sorted({" ".join(pair) for text in (*BASE, *NOTICES) for pair in zip(text.split(" "), text.split(" ")[1:], strict=False)})
    known = ", ".join("xxhash64('{}', '{}')".format(*gram.split(" ")) for gram in grams)
    found = f"filter(sequence(0, size(h) - 1), i -> get(h, i) IN ({known}))"
    return f"CASE WHEN size(h) > 0 THEN transform({found}, i -> struct(i AS p, concat(get(w, i), ' ', get(w, i + 1)) AS gram)) END"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest
    first word (null without one). base_labels and labels are distinct, sorted and comma-joined, and
    empty without one; labels holds the base labels and those of verified notices. score is the largest
    share of a template's grams in one span. A null or empty text has no words. Rows are judged one by one: repeated rows repeat,
    a null id stays null, other columns are ignored, an empty table gives an empty result.
    """
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col(quoted(text_col)), F.lit(""))), SEPARATORS), lambda w: w != "")
    cut = docs.select(F.col(quoted(id_col)).alias("doc"), words.alias("w"))
    cut = cut.withColumn("h", F.expr("CASE WHEN size(w) > 1 THEN zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> xxhash64(a, b)) END"))
    rows = cut.select(F.monotonically_increasing_id().alias("row"), "doc", F.size("w").cast("long").alias("n_words"), F.expr(gram_hits()).alias("hits"))
    # A row without a hit comes first, which carries the document itself.
    itself = "array(CAST(NULL AS STRUCT<p: INT, gram: STRING>))"
    rolling = rows.select("row", "doc", "n_words", F.posexplode(F.expr(f"concat({itself}, coalesce(hits, array()))")).alias("k", "hit"))
    own = lambda c: F.when(F.col("k") == 0, F.col(c)).alias(c)
    rolling = rolling.select("row", own("doc"), own("n_words"), F.col("hit.p").cast("long").alias("p"), F.col("hit.gram").alias("gram"))
    hits = rolling.join(F.broadcast(template_grams(docs.sparkSession)), "gram", "left")
    # Dealt by row once; a document's hits are no more than its words, and all further steps keep to this partitioning.
    notice = ["template", "label", "base", "n"]
    votes = hits.repartition("row").groupBy("row", *notice, (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, t)")).alias("votes"), F.first("doc", ignorenulls=True).alias("doc"), F.max("n_words").alias("n_words")
    )
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    chained = votes.withColumn("fresh", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > NEAR).cast("int"), F.lit(1))).withColumn("span", F.sum("fresh").over(line))
    # Chains that are too long are cut into windows of the largest extent, of which the best counts; places are in fractions of it.
    extent = F.floor(MOST_EXTENT * F.col("n"))
    window = Window.partitionBy("row", "template", "span").orderBy("place").rangeBetween(0, SCALE - 1)
    placed = (
        chained.withColumn("t", F.explode_outer(F.expr("filter(sequence(0, n - 1), i -> getbit(votes, i) = 1)")))
        .withColumn("p", F.col("diagonal") + F.col("t"))
        .withColumn("place", F.floor(F.col("p") * SCALE / extent))
        .withColumn("near", F.bit_count(F.bit_or(F.expr("shiftleft(1L, t)")).over(window)))
        # A base phrase is a diagonal with all of its grams; it counts at the first.
        .withColumn("at", F.when(F.col("base") & (F.bit_count("votes") == F.col("n")) & (F.col("t") == 0), F.col("diagonal")))
    )
    spans = placed.groupBy("row", *notice, "span").agg(
        F.bit_count(F.bit_or("votes")).alias("held"), F.max("near").alias("near"), (F.max("p") - F.min("p") + 1).alias("extent"),
        F.count("at").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"), F.first("doc", ignorenulls=True).alias("doc"), F.max("n_words").alias("n_words"),
    )
    share = F.col("held") / F.col("n")
    share = F.when((share >= LEAST_SHARE) & (F.col("extent") > MOST_EXTENT * F.col("n")), F.col("near") / F.col("n")).otherwise(share)
    share = F.when(F.col("base"), F.when(F.col("places") > 0, F.lit(1.0))).otherwise(share)
    spans = spans.withColumn("share", share).withColumn("found", F.when(F.col("share") >= LEAST_SHARE, F.col("label")))
    # Labels are a handful, so their sets stay small.
    per_row = spans.groupBy("row").agg(
        F.first("doc", ignorenulls=True).alias(id_col),
        F.max("n_words").alias("n_words"),
        F.coalesce(F.sum("places"), F.lit(0)).alias("n_base"),
        F.min("first").alias("first_word"),
        F.max("last").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("found")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("found")), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return per_row.drop("row")
