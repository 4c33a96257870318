"""URL filters: allow and block rules, and gradient-boosted trees where no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import stratified_sample

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio",
            "host_entropy", "path_entropy", "parameters", "has_fragment", "is_https",
            "host_suffix_count", "host_suffix_rate", "path_suffix_count", "path_suffix_rate"]


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_verdicts(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits.

    A rule is a host, then a path; it fits its host and all subdomains under its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):       # the longest comes last
        name, slash, rest = text.partition("/")
        fits = (((host == name) | host.endswith("." + name)) & path.startswith(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(characters)
    parts = F.transform(F.array_distinct(characters), lambda c: F.size(
        F.filter(characters, lambda d: d == c)) / n)
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical(rows: DataFrame) -> DataFrame:
    """Add the lexical features of `_url`, `host` and `path`, and the two suffixes."""
    url = F.coalesce("_url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    return rows.withColumns({
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": count_of(F.col("path"), "/"), "labels": count_of(F.col("host"), "\\."),
        "hyphens": count_of(F.col("host"), "-"),
        "digit_ratio": count_of(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "host_entropy": entropy(F.col("host")), "path_entropy": entropy(F.col("path")),
        "parameters": count_of(query, "="), "has_fragment": F.contains(url, F.lit("#")).cast("int"),
        "is_https": F.lower(url).startswith("https://").cast("int"),
        "host_suffix": F.substring_index("host", ".", -2),
        "path_suffix": F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,8}|/)\z", 1)})


def with_suffix_statistics(rows: DataFrame, statistics: dict[str, DataFrame]) -> DataFrame:
    for suffix, table in statistics.items():
        rows = rows.join(table, suffix, "left")
    return rows.withColumns({name: F.coalesce(name, F.lit(0.5 if name.endswith("rate") else 0.0))
                             for name in FEATURES[-4:]})


def suffix_statistics(rows: DataFrame, smooth: float = 20.0) -> dict[str, DataFrame]:
    """For both suffixes: log of the urls that have it, and the smoothed share of blocked labels."""
    labelled = F.sum(F.when(F.col("_label").isNotNull(), 1).otherwise(0))
    return {suffix: cut_lineage(rows.groupBy(suffix).agg(
        F.log1p(F.count(F.lit(1))).alias(f"{suffix}_count"),
        ((F.coalesce(F.sum("_label"), F.lit(0.0)) + smooth / 2) / (labelled + smooth)).alias(f"{suffix}_rate")))
        for suffix in ("host_suffix", "path_suffix")}


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None,
                train_rows: int = 5000, trees: int = 10, depth: int = 4, key: str = "page_id",
                url: str = "url") -> DataFrame:
    """Per row: key, `host`, `path`, `rule`, `verdict` and `block_score` of the trees.

    The rule's verdict holds where one fits; elsewhere the trees decide (`block` from a probability of
    one half on). They are trained on about `train_rows` labelled urls of each verdict (a bounded
    sample): rows of `labels` (url, verdict), or else the urls that the rules label. Suffix
    statistics cover all rows. A null url has an empty host and path, fits no rule and is judged by
    its features, all 0. With labels of one kind, that verdict is given; with none, `allow`.
    Repeated rows, null keys and other columns change nothing; an empty table gives an empty table.
    """
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    rule, verdict = rule_verdicts(rules, F.col("host"), F.col("path"))
    rows = (pages.select(pages[key].alias("_key"), pages[url].alias("_url"))
            .withColumns({"host": host, "path": path})
            .withColumns({"rule": rule, "_verdict": verdict}))
    if labels is None:
        said = F.col("_verdict")
    else:
        known = labels.groupBy(F.col("url").alias("_url")).agg(F.max("verdict").alias("_said"))
        rows, said = rows.join(known, "_url", "left"), F.col("_said")
    label = F.when(said == "block", 1.0).when(said == "allow", 0.0)
    featured = cut_lineage(lexical(rows.withColumn("_label", label)))
    featured = with_suffix_statistics(featured, suffix_statistics(featured))
    sample = stratified_sample(
        featured.where(F.col("_label").isNotNull()), "_label", "_url", train_rows, "urls")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = cut_lineage(sample.select("_url", "_label", *FEATURES).orderBy("_url", "_label"))
    kinds = {r[0] for r in train.select("_label").distinct().collect()}
    if len(kinds) < 2:
        scored = featured.withColumn("block_score", F.lit(1.0 if 1.0 in kinds else 0.0))
    else:
        model = GBTClassifier(labelCol="_label", maxIter=trees, maxDepth=depth, seed=5).fit(
            assembler.transform(train).select("features", "_label"))
        scored = model.transform(assembler.transform(featured)).withColumn(
            "block_score", vector_to_array("probability")[1])
    judged = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("_key").alias(key), "host", "path", "rule",
                         F.coalesce("_verdict", judged).alias("verdict"), "block_score")
