"""URL filters: allow and block rules, and gradient-boosted trees on lexical features.

Rules name a host and a path prefix; the longest that fits decides. The rest is judged by
gradient-boosted trees over features of the URL's spelling. The trees are fitted once, on a
bounded sample of labelled URLs, and become one SQL expression, so that scoring is a projection.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, ascii_lower, pick, quoted

#: Most labelled URLs that the trees are fitted on, and most host suffixes that are broadcast; more are joined by shuffle.
SAMPLE_ROWS, MAX_SUFFIXES = 20_000, 200_000
TREES, DEPTH, STEP, SEED = 20, 3, 0.2, 11
#: Weight of the overall rate in the rate of a host suffix.
PRIOR = 20
#: Labels of the host suffixes that are counted, and folds of hosts, of which a training URL's own is left out of its rates.
SUFFIXES, FOLDS = (2, 3), 5
FEATURES = ["url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "hyphens", "entropy", "params", *(f"{c}_{k}" for k in SUFFIXES for c in ("rate", "rows"))]
Rules = list[tuple[str, str]]


def parts(url: str) -> tuple[Column, Column]:
    """Host (lower-cased in A-Z) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(rules: Rules) -> tuple[Column, Column]:
    """The longest fitting rule (like ``net/``) and its verdict, null where none fits; reads ``host`` and ``path``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame, url: str) -> DataFrame:
    """Adds the features but for the suffix statistics; reads ``host`` and ``path``."""
    count = lambda text, what: F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))
    address = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(address, r"\?([^#]*)", 1)
    chars = "filter(split(host, ''), c -> c <> '')"
    entropy = F.expr(f"aggregate(transform(array_distinct({chars}), c -> (length(host) - length(replace(host, c, ''))) / length(host)), 0D, (s, p) -> s - p * log2(p))")
    return (
        df.withColumn("url_length", F.length(address))
        .withColumn("host_length", F.length("host"))
        .withColumn("path_length", F.length("path"))
        .withColumn("labels", count(F.col("host"), ".") + 1)
        .withColumn("depth", count(F.col("path"), "/"))
        .withColumn("digit_ratio", F.length(F.regexp_replace(address, "[^0-9]", "")) / F.greatest(F.length(address), F.lit(1)))
        .withColumn("hyphens", count(F.col("host"), "-"))
        .withColumn("entropy", entropy)
        .withColumn("params", F.when(query == "", F.lit(0)).otherwise(count(query, "&") + 1))
    )


def suffix(k: int) -> Column:
    """The last k labels of the host, with k, as a short host is its own suffix for several."""
    return F.concat(F.lit(f"{k} "), F.substring_index("host", ".", -k))


def fold() -> Column:
    return F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")


def with_suffixes(df: DataFrame, counts: DataFrame, base_rate: float, own: DataFrame | None = None) -> DataFrame:
    """Adds for each suffix the share of blocked URLs and the log of its rows among the labelled; ``own`` (by suffix and fold) is taken off."""
    for k in SUFFIXES:
        df = pick(df.withColumn("suffix", suffix(k)), counts, "suffix", "left", MAX_SUFFIXES)
        rows, blocked = F.coalesce("rows", F.lit(0)), F.coalesce("blocked", F.lit(0))
        if own is not None:
            df = df.withColumn("fold", fold()).join(own, ["suffix", "fold"], "left")
            rows, blocked = rows - F.coalesce("own_rows", F.lit(0)), blocked - F.coalesce("own_blocked", F.lit(0))
        df = df.withColumns({f"rate_{k}": (blocked + F.lit(PRIOR * base_rate)) / (rows + PRIOR), f"rows_{k}": F.log1p(rows)}).drop("suffix", "rows", "blocked", "fold", "own_rows", "own_blocked")
    return df


def tree_sql(node) -> str:
    """A fitted tree as nested CASE expressions over the features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{node.prediction()!r}D"
    split = node.split()
    return f"CASE WHEN {FEATURES[split.featureIndex()]} <= {split.threshold()!r}D THEN {tree_sql(node.leftChild())} ELSE {tree_sql(node.rightChild())} END"


class UrlModel:
    """Trees as a column, and what the suffix features need. ``margin`` over 0 means block."""

    def __init__(self, labelled: DataFrame, scratch: Scratch, sample_rows: int = SAMPLE_ROWS) -> None:
        """``labelled`` has ``url``, ``host``, ``path`` and ``label`` (1: block). The fit takes ``sample_rows`` of least hash, by class; suffixes are counted over all."""
        labelled = labelled.where(F.col("label").isNotNull())
        each = labelled.select("label", fold().alias("fold"), F.explode(F.array(*map(suffix, SUFFIXES))).alias("suffix"))
        own = scratch.save(each.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("own_rows"), F.sum("label").alias("own_blocked")), "folds")
        self.suffixes = scratch.save(own.groupBy("suffix").agg(F.sum("own_rows").alias("rows"), F.sum("own_blocked").alias("blocked")), "suffixes")
        rows, blocked = self.suffixes.where(F.startswith("suffix", F.lit(f"{SUFFIXES[0]} "))).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
        self.base_rate = blocked / rows if rows else 0.0
        # Half of the sample for each class, and what one leaves for the other; weights restore their shares.
        there = {0: rows - blocked, 1: blocked}
        take = {c: min(there[c], max(sample_rows // 2, sample_rows - there[1 - c])) for c in there}
        weight = {c: there[c] / take[c] if take[c] else 1.0 for c in there}
        least = lambda c: labelled.where(F.col("label") == c).orderBy(F.xxhash64("url"), "url").limit(take[c]).withColumn("weight", F.lit(float(weight[c])))
        sample = scratch.save(lexical(least(0).unionByName(least(1)), "url"), "sample")
        if 0 < blocked < rows:
            ready = with_suffixes(sample, self.suffixes, self.base_rate, own).select(*[F.col(c).cast("double") for c in FEATURES], F.col("label").cast("double"), "weight")
            ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready).select("features", "label", "weight").coalesce(1)
            model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, weightCol="weight").fit(ready)
            trees = [f"{w!r}D * ({tree_sql(t._call_java('rootNode'))})" for w, t in zip(model.treeWeights, model.trees, strict=True)]
            self.margin = F.expr(" + ".join(trees))
        else:  # one class only: nothing to tell apart
            self.margin = F.lit(1.0 if blocked else -1.0)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` (id, url, host, path) and ``block_score``, the odds of block from 0 to 1."""
        columns = df.columns
        ready = with_suffixes(lexical(df, "url"), self.suffixes, self.base_rate)
        return ready.withColumn("block_score", 1 / (1 + F.exp(-2 * self.margin))).select(*columns, "block_score")


def url_filter(pages: DataFrame, rules: Rules, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict (allow or block), block_score.

    ``labelled`` (url, label) are the URLs to learn from: 1 is block, 0 allow, and null, like a URL without a host, is no label. A null URL, or
    one without ``://``, has an empty host and path and is judged by the trees alone; without labels, or with one class
    only, all others get that class (allow without any). Pages are judged one by one: repeated rows
    repeat, a null id stays null. Other columns are ignored, an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "url")
    cut = lambda df: df.withColumns(dict(zip(("host", "path"), parts("url"), strict=True)))
    model = UrlModel(cut(labelled.select("url", F.col("label").cast("int").alias("label"))).where("host <> ''"), scratch, sample_rows)
    rule, verdict = rule_columns(rules)
    scored = model.score(cut(pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).alias("url"))))
    judged = F.when(F.col("block_score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "block_score")
