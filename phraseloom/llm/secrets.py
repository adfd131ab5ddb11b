"""Secret scans: fixed patterns, and strings that look random.

Three patterns find what announces itself: assignments of passwords and the
like, access keys, long hexadecimal strings. For the rest, every run of
``min_length`` or more key characters is scored by two character Markov models,
one of random strings and one of ordinary identifiers: the sum over its
character pairs of log(p_random / p_ordinary), per character. What reaches the
threshold is reported as ``random``. A run that does not may still hold a key
beside ordinary words, as paths do: its stretches of high ratios are found by a
running sum and reported up to the next / _ or - on both sides. Spans of the
patterns are blanks to the models, which see what is left of a run.

Both models are trained here by pair counts over labelled samples (value,
label). The default sample is derived by Spark: random strings of several
alphabets, made from digests, and ordinary identifiers made from the words of a
bounded number of documents (``sample_documents``, those of the smallest
hash), joined in the ways identifiers are. The models are 66 x 66 numbers, an
array in the plan.

Everything is DataFrame expressions. Positions are in code points, ends
exclusive, found by splitting a text at its matches. A null text is empty and
has no span. Repeated rows are scanned each; empty tables give no rows; without
samples no span is random. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.functions.columns import let


@dataclass(frozen=True)
class SecretScan:
    min_length: int = 20
    threshold: float = 0.4  # nats per character
    # A stretch of a run must be this far above the threshold in sum, and ends
    # where the sum has fallen this far below its peak (nats).
    evidence: float = 12.0
    drop: float = 8.0
    sample_documents: int = 500
    random_strings: int = 20000
    smoothing: float = 0.5


DEFAULTS = SecretScan()
# The patterns of the three kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CLASS = "[A-Za-z0-9+/_-]"
SIDE = len(CHARACTERS) + 1
SPAN = "struct<kind:int,start:int,end:int>"
NONE = f"array<{SPAN}>"
PARTS = "array<struct<start:int,end:int>>"


def spans_of(text: Column, pattern: str, kind: int, passes=None, parts=None) -> Column:
    """array<struct(kind, start, end)> of the leftmost matches, without those
    whose string fails ``passes``; or of the ``parts`` of their strings, an
    array<struct(start, end)>."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("s")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + x["m"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"))
        ok = F.lit(True) if passes is None else passes(x["s"])
        new = F.array(span)
        if parts is not None:
            moved = lambda p: F.struct(F.lit(kind).alias("kind"), (begin + p["start"]).alias("start"), (begin + p["end"]).alias("end"))
            new = F.transform(parts(x["s"]), moved)
        spans = F.when(ok, F.concat(acc["spans"], new)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    found = F.aggregate(lengths, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(NONE))


def _value_of(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def _pairs(value: Column) -> Column:
    """The character pairs of a string, as positions in the model."""
    # 1 to 66 for each character; 0 for any other
    places = F.transform(
        F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(CHARACTERS))
    )

    def pairs(place: Column) -> Column:
        n = F.greatest(F.size(place) - 1, F.lit(0))
        return F.zip_with(F.slice(place, F.lit(1), n), F.slice(place, F.lit(2), n), lambda a, b: a * SIDE + b)

    return let(places, pairs)


def labelled_strings(docs: DataFrame, how: SecretScan = DEFAULTS, text_col: str = "text") -> DataFrame:
    """(value, label): label 1 for random strings, 0 for identifiers."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")).cast("binary"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    upper = F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", ""))
    mixed = F.regexp_replace(base64, "[^A-Za-z0-9]", "")
    kind = F.col("id") % 4
    value = F.when(kind == 0, digest).when(kind == 1, base64).when(kind == 2, upper).otherwise(mixed)
    random = spark.range(how.random_strings).select(value.alias("value"), F.lit(1).alias("label"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("hash"))
    # numbers are ordered, not texts; copies of a text count once
    smallest = texts.select("hash").distinct().orderBy("hash").limit(how.sample_documents)
    chosen = texts.join(F.broadcast(smallest), "hash").dropDuplicates(["hash"])
    # words without digits, so that no secret is taken for an identifier; four
    # at a time, joined in one of six ways
    pieces = F.regexp_extract_all("text", F.lit("(?<![A-Za-z])(?:[A-Za-z]++(?:[^A-Za-z]++|$)){1,4}"), F.lit(0))
    rows = chosen.select(F.posexplode(pieces).alias("turn", "piece"))
    four = F.filter(F.split("piece", "[^A-Za-z]+"), lambda w: w != "")
    joined = lambda sep: F.array_join("four", sep)
    camel = F.array_join(F.transform("four", F.initcap), "")
    ways = F.array(joined(""), joined("_"), joined("-"), joined("/"), camel, F.upper(joined("_")))
    ordinary = rows.select("turn", four.alias("four")).select(F.get(ways, F.col("turn") % 6).alias("value"))
    # numbers end identifiers too
    numbers = spark.range(2000).select(F.concat(F.lit("item_"), F.col("id").cast("string")).alias("value"))
    return random.unionByName(ordinary.unionByName(numbers).withColumn("label", F.lit(0)))


def trained(samples: DataFrame, how: SecretScan = DEFAULTS) -> list[float] | None:
    """log(p_random / p_ordinary) of every character pair; None without
    samples of both labels."""
    pairs = samples.where("value is not null").select("label", F.explode(_pairs(F.col("value"))).alias("pair"))
    # at most two numbers for each of 66 x 66 pairs
    counted = pairs.groupBy("pair").agg(F.sum("label").alias("random"), F.sum(1 - F.col("label")).alias("ordinary"))
    rows = {r[0]: (r[1], r[2]) for r in counted.collect()}
    if not any(r for r, _ in rows.values()) or not any(o for _, o in rows.values()):
        return None
    ratio = [0.0] * (SIDE * SIDE)
    for first in range(1, SIDE):
        row = [rows.get(first * SIDE + second, (0, 0)) for second in range(1, SIDE)]
        total = [sum(x[k] for x in row) + how.smoothing * len(CHARACTERS) for k in (0, 1)]
        for second, (r, o) in enumerate(row, 1):
            ratio[first * SIDE + second] = math.log((r + how.smoothing) / total[0]) - math.log((o + how.smoothing) / total[1])
    return ratio


def likelihood_ratio(value: Column, model: list[float]) -> Column:
    """log-likelihood ratio per character pair of a string."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    mean = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.get(table, i)) / F.greatest(F.size(pairs), F.lit(1))
    return let(_pairs(value), mean)


def random_parts(value: Column, model: list[float], how: SecretScan = DEFAULTS) -> Column:
    """array<struct(start, end)>: the whole run if it reaches the threshold; or
    else its stretches of high ratios, to the next / _ - on both sides."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    none = F.array().cast(PARTS)

    def closed(acc: Column) -> Column:
        good = (acc["peak"] >= how.evidence) & (acc["end"] - acc["start"] + 1 >= how.min_length)
        part = F.struct(acc["start"].alias("start"), (acc["end"] + 1).alias("end"))
        return F.when(good, F.concat(acc["found"], F.array(part))).otherwise(acc["found"])

    def step(acc: Column, pair: Column) -> Column:
        total, at = acc["sum"] + F.get(table, pair) - how.threshold, acc["at"] + 1
        ends = (total <= 0) | (total < acc["peak"] - how.drop)
        higher = total > acc["peak"]
        return F.struct(
            at.alias("at"),
            F.when(ends, at).otherwise(acc["start"]).alias("start"),
            F.when(ends, 0.0).otherwise(total).alias("sum"),
            F.when(ends, 0.0).otherwise(F.greatest(acc["peak"], total)).alias("peak"),
            F.when(ends | higher, at).otherwise(acc["end"]).alias("end"),
            F.when(ends, closed(acc)).otherwise(acc["found"]).alias("found"),
        )

    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.lit(0).alias("end"), none.alias("found")
    )

    def widened(p: Column) -> Column:
        before = F.length(F.regexp_extract(F.substring(value, F.lit(1), p["start"]), "[A-Za-z0-9+]*$", 0))
        after = F.length(F.regexp_extract(F.substring(value, p["end"] + 1, F.length(value)), "^[A-Za-z0-9+]*", 0))
        return F.struct((p["start"] - before).alias("start"), (p["end"] + after).alias("end"))

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(value).alias("end")))

    def parts(pairs: Column) -> Column:
        stretches = F.array_distinct(F.transform(F.aggregate(pairs, zero, step, closed), widened))
        return F.when(likelihood_ratio(value, model) >= how.threshold, whole).otherwise(stretches)

    return let(_pairs(value), parts)


def masked_text(text: Column, spans: Column) -> Column:
    """The text with blanks where spans are, which are in order."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["start"])
        end = F.greatest(acc["at"], s["end"])
        gap = F.substring(text, acc["at"] + 1, begin - acc["at"])
        return F.struct(end.alias("at"), F.concat(acc["parts"], F.array(gap, F.repeat(F.lit(" "), end - begin))).alias("parts"))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def _ordered(spans: Column) -> Column:
    by_start = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(F.array_sort(by_start), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def found_spans(
    text: Column, model: list[float] | None, how: SecretScan = DEFAULTS, base: Column | None = None
) -> tuple[Column, Column]:
    """(spans of the patterns, spans added by the models beside them)."""
    if base is None:
        assign = spans_of(text, ASSIGN, 0, lambda m: F.length(_value_of(m)) >= 8)
        access = spans_of(text, ACCESS, 1, lambda m: F.length(m) >= 16)
        base = _ordered(F.concat(assign, access, spans_of(text, HEX, 2)))
    if model is None:
        return base, F.array().cast(NONE)
    run = f"(?<!{CLASS}){CLASS}{{{how.min_length},}}"
    added = let(masked_text(text, base), lambda t: spans_of(t, run, 3, parts=lambda m: random_parts(m, model, how)))
    return base, added


def scanned(docs: DataFrame, how: SecretScan = DEFAULTS, samples: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (kind, start, end) in
    order; columns of these names that ``docs`` has already give way."""
    samples = labelled_strings(docs, how, text_col) if samples is None else samples
    text, model = F.coalesce(F.col(text_col), F.lit("")), trained(samples, how)
    rows = docs.withColumn("base", found_spans(text, None)[0])
    _, added = found_spans(text, model, how, F.col("base"))
    return rows.withColumn("spans", added).withColumn("spans", _ordered(F.concat("base", "spans")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted_text(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal run of overlapping spans replaced."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        parts = F.when(s["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(gap, F.lit(mark))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    whole = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, whole)).otherwise(text)


def redacted(docs: DataFrame, how: SecretScan = DEFAULTS, samples: DataFrame | None = None) -> DataFrame:
    """The documents with their secrets replaced; the columns of
    ``documents``, n_chars counted anew where a text changed."""
    columns = docs.columns
    inner = docs.select(*(F.col(c).alias(f"own_{c}") for c in columns))
    rows = scanned(inner, how, samples, "own_text")
    text = redacted_text(F.col("own_text"), F.col("spans"))
    chars = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("own_n_chars"))
    rows = rows.withColumn("text", text).withColumn("own_n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return rows.select(*(F.col("text") if c == "text" else F.col(f"own_{c}").alias(c) for c in columns))
