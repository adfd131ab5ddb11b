"""URL filters: rules first, then a logistic regression on character n-grams.

All of it is DataFrame expressions. Host and path are cut out of the URL; of
the rules whose host is the URL's or a parent of it, and whose path begins the
URL's, the longest decides. Where none does, the URL's character n-grams (3 to
5 characters, host and path apart) are hashed to buckets, and a logistic
regression over the set of buckets decides: block from ``threshold`` on, which
lies below one half because most labelled URLs are clean.

The regression is trained here, by gradient steps that are aggregates over a
small labelled table (url, label; 1 means block), ``urlsamples``. Its weights are one number
per bucket, an array in the plan. Unknown n-grams have weight 0 and the bias is
that of a clean URL, so an unknown URL is allowed.

A null URL, or one without ``://``, has an empty host and path, no n-grams and
no rule; it gets the verdict of the bias. Repeated rows are judged each; empty
tables give no rows; columns other than id and URL are not read. A very long
URL has as many n-grams as characters, and each distinct one counts once. An
empty labelled table allows whatever no rule blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions.columns import let
from phraseloom.llm.urlsamples import labelled_urls
from phraseloom.staging import stage

# So many rules are a part of the plan; more are joined as a table.
PLAN_RULES = 200


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # "block" or "allow"
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    buckets: int = 4096
    sizes: tuple[int, ...] = (3, 4, 5)
    steps: int = 25
    rate: float = 0.2
    l2: float = 0.02
    bias: float = -3.0
    threshold: float = 0.33


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)
DEFAULTS = UrlModel()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# what follows the first "://", in two parts
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does.
    Rules of equal length: the first one given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def rule_table(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    rows = [(r.verdict, r.host, r.path, i) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "verdict string, host string, path string, turn long")


def with_rule(rows: DataFrame, rules: tuple[UrlRule, ...] | DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) with ``fit``, as ``matching_rule`` has it.
    Rules may be a table (verdict, host, path, turn) of any size: each distinct
    host and path meets the rules of its host and of all parents by a join."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= PLAN_RULES:
            return rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
        rules = rule_table(rows.sparkSession, rules)
    rules = rules.select("verdict", F.col("host").alias("parent"), F.col("path").alias("prefix"), "turn")
    labels = F.split("host", "[.]", -1)
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    places = rows.select("host", "path").distinct().withColumn("parent", F.explode(parents))
    fits = places.join(rules, "parent").where(F.col("path").startswith(F.col("prefix")))
    text = F.concat("parent", "prefix")
    best = F.max_by(F.struct(text.alias("rule"), "verdict"), F.struct(F.length(text), -F.col("turn")))
    return rows.join(fits.groupBy("host", "path").agg(best.alias("fit")), ["host", "path"], "left")


def _grams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """The n-grams of a text between a mark of its beginning and one of its
    end. The characters are taken apart once, so a long text is read once."""

    def of_size(characters: Column, n: int) -> Column:
        last = F.size(characters) - n
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(f"{mark}{n}"), *(F.get(characters, i + k) for k in range(n))))

    bounded = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    return let(bounded, lambda characters: F.concat(*(of_size(characters, n) for n in sizes)))


def features(host: Column, path: Column, how: UrlModel = DEFAULTS) -> Column:
    """The distinct buckets of a URL's n-grams; digits count as one digit."""
    parts = []
    for text, mark in ((host, "h"), (path, "p")):
        parts.append(_grams(F.regexp_replace(text, "[0-9]+", "0"), mark, how.sizes))
    hashed = F.transform(F.concat(*parts), lambda g: F.pmod(F.xxhash64(g), F.lit(how.buckets)).cast("int"))
    return F.when((host == "") & (path == ""), F.array().cast("array<int>")).otherwise(F.array_distinct(hashed))


def _margin(found: Column, weights: list[float], bias: float) -> Column:
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda s, i: s + F.get(table, i))
    return total / F.sqrt(F.size(found) + F.lit(1.0)) + F.lit(bias)


def trained(spark: SparkSession, labelled: DataFrame | None = None, how: UrlModel = DEFAULTS) -> tuple[list[float], float]:
    """(weights, bias), by AdaGrad steps; each is one aggregate over the table."""
    labelled = labelled_urls(spark) if labelled is None else labelled
    rows = labelled.where("url is not null and label is not null").select(
        features(host_of(F.col("url")), path_of(F.col("url")), how).alias("found"), F.col("label").cast("double")
    )
    rows = stage(rows.where(F.size("found") > 0), "labelled-urls")
    n, positive = rows.agg(F.count("label"), F.sum("label")).first()
    # the bias is fixed: unknown URLs are judged by it, as clean ones
    weights, grown = [0.0] * how.buckets, [1e-12] * how.buckets
    if not n or not positive:
        return weights, how.bias
    for _ in range(how.steps):
        p = 1 / (1 + F.exp(-_margin(F.col("found"), weights, how.bias)))
        slope = (p - F.col("label")) / F.sqrt(F.size("found") + F.lit(1.0)) / n
        sums = rows.select(slope.alias("slope"), F.explode("found").alias("bucket")).groupBy("bucket")
        # at most one row per bucket
        gradient = dict(sums.agg(F.sum("slope")).collect())
        for i, w in enumerate(weights):
            g = gradient.get(i, 0.0) + how.l2 * w / n
            grown[i] += g * g
            weights[i] = w - how.rate * g / grown[i] ** 0.5
    return weights, how.bias


def judged(
    pages: DataFrame,
    rules: tuple[UrlRule, ...] | DataFrame = RULES,
    labelled: DataFrame | None = None,
    how: UrlModel = DEFAULTS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """A row per URL: id, ``host``, ``path``, ``rule``, ``verdict`` and
    ``score``, the probability of block."""
    weights, bias = trained(pages.sparkSession, labelled, how)
    rows = pages.select(F.col(id_col).alias("own_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = with_rule(rows, rules)
    rows = rows.withColumn("found", features(F.col("host"), F.col("path"), how))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-_margin(F.col("found"), weights, bias))))
    own = F.when(F.col("score") >= how.threshold, "block").otherwise("allow")
    return rows.select(
        F.col("own_id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "score"
    )
