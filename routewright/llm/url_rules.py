"""URL verdicts by mined association rules.

Given rules judge the urls that they fit, and those urls are the labels. FP-growth
mines which combinations of url tokens go with a verdict; rules are pruned by
support, confidence and redundancy, and an inverted index on the rarest token of
each rule finds the rules that a url meets. A url that meets none has the more
frequent label.

Defined results: null urls and urls without ``://`` have an empty host and path,
no rule and no token, so the method's default; rows that repeat are judged each;
without any label every url that no rule fits is allowed; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewright.llm.common import lower_ascii
from routewright.session import cut_lineage

# Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8

_VERDICT = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, F.substr(known, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))

    def pick(value) -> Column:
        none = F.lit(None).cast("string")
        return reduce(
            lambda rest, r: F.when(
                ((host == r[1]) | F.endswith(host, F.lit("." + r[1])))
                & F.startswith(path, F.lit(r[2])),
                F.lit(value(r)),
            ).otherwise(rest),
            reversed(ordered),
            none,
        )

    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, path parts, forms of numbers, query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    number = F.filter(parts, lambda x: F.regexp_like(x, F.lit(r"^[0-9]")))
    named = F.filter(parts, lambda x: ~F.regexp_like(x, F.lit(r"^[0-9]")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.split(query, "&"), lambda x: x != "")
    ending = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
            F.transform(named, lambda x: F.concat(F.lit("path:"), x)),
            F.transform(number, lambda x: F.concat(F.lit("number:"), F.substring(x, 1, 1))),
            F.transform(keys, lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1))),
            F.when(ending != "", F.array(F.concat(F.lit("ending:"), ending))).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )


def frequent_tokens(labelled: DataFrame, support: float) -> list[str]:
    """Tokens of at least ``support`` of the labelled urls, most frequent first.

    Their number is bounded by the tokens of an average url over ``support``.
    """
    n = labelled.count()
    counts = (
        labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
        .where(F.col("count") >= max(1.0, support * n))
    )
    return [r.token for r in sorted(counts.collect(), key=lambda r: (-r["count"], r.token))]


def mine(
    labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(tokens, verdict, confidence, support, key) of (tokens, verdict) rows.

    A rule goes if one with fewer of its tokens is as sure of the same verdict.
    """
    common = frequent_tokens(labelled, support)
    spark = labelled.sparkSession
    schema = "tokens array<string>, verdict string, confidence double, support double, key string"
    if not common:
        return spark.createDataFrame([], schema)
    order = F.array(*[F.lit(t) for t in common])
    items = labelled.select(
        F.concat(
            F.array_intersect(order, F.col("tokens")),
            F.array(F.concat(F.lit(_VERDICT), F.col("verdict"))),
        ).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.select(
        F.sort_array("antecedent").alias("tokens"),
        F.col("consequent")[0].alias("item"),
        "confidence",
        "support",
    ).where(F.startswith("item", F.lit(_VERDICT)))
    found = cut_lineage(
        found.where(~F.exists("tokens", lambda t: F.startswith(t, F.lit(_VERDICT)))).withColumn(
            "verdict", F.substring_index("item", "=", -1)
        )
    )
    # Subsets are looked up by name: a rule with t tokens has 2^t of them at most.
    smaller = found.select(
        F.col("tokens").alias("less"), F.col("verdict").alias("v"), F.col("confidence").alias("c")
    )
    wider = found.withColumn("less", F.explode(_proper_subsets(F.col("tokens"))))
    redundant = (
        wider.join(smaller, "less")
        .where((F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")))
        .select("tokens", "verdict")
        .distinct()
    )
    kept = found.join(redundant, ["tokens", "verdict"], "left_anti")
    rarest = F.element_at(F.array_intersect(order, F.col("tokens")), -1)
    return kept.select("tokens", "verdict", "confidence", "support", rarest.alias("key"))


def _proper_subsets(tokens: Column) -> Column:
    """All non-empty proper subsets, each in order."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(tokens)) - 2).cast("int"))
    sets = F.transform(
        masks,
        lambda m: F.filter(
            tokens, lambda _, i: (F.floor(m / F.pow(F.lit(2), i)).cast("int") % 2) == 1
        ),
    )
    return F.when(F.size(tokens) > 1, sets).otherwise(F.array().cast("array<array<string>>"))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, met): the surest rule met by each token set, looked up by rule key."""
    index = rules.select(
        "key",
        F.col("tokens").alias("need"),
        F.struct(
            "confidence", "support", (-F.size("tokens")).alias("short"), "verdict", "tokens"
        ).alias("rule"),
    )
    return (
        sets.select("tokens", F.explode("tokens").alias("key"))
        .join(index, "key")
        .where(F.size(F.array_except("need", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max("rule").alias("met"))
    )


def judge(
    pages: DataFrame,
    rules: Sequence[tuple] = RULES,
    support: float = MIN_SUPPORT,
    confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined tokens and their confidence."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, given = fitting_rule(F.col("host"), F.col("path"), rules)
    tokens = F.sort_array(url_tokens(F.col("url"), F.col("host"), F.col("path")))
    seen = cut_lineage(
        seen.select(
            "page_id", "host", "path", rule.alias("rule"), given.alias("given"), tokens.alias("tokens")
        )
    )
    labelled = seen.where("given is not null").select("tokens", F.col("given").alias("verdict"))
    by_label = {r.verdict: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    default = "block" if by_label.get("block", 0) > by_label.get("allow", 0) else "allow"
    mined = cut_lineage(mine(labelled, support, confidence))
    useful = mined.agg(F.array_distinct(F.flatten(F.collect_list("tokens")))).first()[0] or []
    # Urls differ in tokens that no rule has; without those few token sets are left.
    known = F.array(*[F.lit(t) for t in sorted(useful)]).cast("array<string>")
    seen = seen.withColumn("tokens", F.sort_array(F.array_intersect(F.col("tokens"), known)))
    # Written, so that both sides of the join are plain shuffles and a common set can be split.
    met = cut_lineage(match(seen.where("given is null").select("tokens").distinct(), mined))
    judged = seen.join(met, "tokens", "left")
    mined_verdict = F.coalesce(F.col("met.verdict"), F.lit(default))
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("given", mined_verdict).alias("verdict"),
        F.when(F.col("given").isNull(), F.col("met.tokens")).alias("met_tokens"),
        F.when(F.col("given").isNull(), F.col("met.confidence")).alias("confidence"),
    )
