"""URL filters: rules, and path templates per host judged by the purity of their labelled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import col
from tidebar.session import stage

#: Levels of the tree; what a path has beyond them is one segment more.
LEVELS = 6
#: From so many pages on, a segment is judged by its labels, whatever its part of the host.
ENOUGH = 10


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule is a host with a path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules.items(), key=lambda r: len(r[0])):
        of, _, begins = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + begins)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def segment(part: Column) -> Column:
    """A segment whose form alone shows that it varies becomes a wildcard: numbers, long hexadecimals, file names of these."""
    return (
        F.when(part.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"), F.lit("*"))
        .when(part.rlike(r"^[0-9a-fA-F-]{16,}(\.[A-Za-z]+)?$"), F.lit("*"))
        .otherwise(part)
    )


def judge(
    df: DataFrame, key: str, url: str, rules: dict[str, str], rare: float = 0.02, alike: float = 2.0, strength: float = 10.0, purity: float = 0.5
) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) per row.

    Paths of a host form a tree by segment. From the root down, a segment is a
    wildcard if its form varies or if it has less than the part ``rare`` of the
    pages at its place and under ``ENOUGH`` pages, and such siblings have about one page (under 1.5) on average; then branches of one
    parent whose labelled purity differs from their parent's by no more than
    ``alike`` standard errors are merged into the wildcard. Every level is one
    aggregate of (host, template, segment) counts, so a host with a third of all
    pages is summed before it is shuffled.

    Pages that a rule decides are the labelled ones. A template's purity is the
    part of its labelled pages that are allowed, smoothed by ``strength`` pages of
    the same path on all hosts (wildcards by form alone), and that by the part on all pages. A page
    without a rule is blocked when its template's purity is below ``purity``.

    Null urls and those without :// have an empty host and path and no rule; they
    are judged like a host of their own. Without labelled pages all is allowed.
    Repeated rows count and are judged one by one. An empty table gives an empty result.
    """
    h, p = host(col(url)), path(col(url))
    read = df.select(F.monotonically_increasing_id().alias("row"), col(key).alias("key"), h.alias("host"), p.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    parts = F.filter(F.split("path", "/", -1), lambda s: s != "")
    tail = F.expr(f"slice(_parts, {LEVELS + 1}, greatest(size(_parts) - {LEVELS}, 1))")
    read = read.withColumns({"rule": rule, "said": verdict, "_parts": parts})
    read = read.withColumn("parts", F.when(F.size("_parts") > LEVELS, F.concat(F.slice("_parts", 1, LEVELS), F.array(F.array_join(tail, "/")))).otherwise(F.col("_parts")))
    good = (F.col("said") == "allow").cast("long")
    read = stage(read.drop("_parts"), "urls")
    # one row per host and path with its numbers of pages, labelled and allowed pages
    tree = read.groupBy("host", "path", "parts").agg(F.count("*").alias("n"), F.count("said").alias("told"), F.coalesce(F.sum(good), F.lit(0)).alias("good"))
    tree = tree.withColumns({"template": F.lit(""), "plain": F.array_join(F.transform("parts", segment), "/")})
    for level in range(LEVELS + 1):
        here = F.get(F.col("parts"), F.lit(level))
        tree = stage(tree.withColumn("seg", segment(here)), f"urls-{level}")
        branch = tree.where("seg IS NOT NULL").groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "told", "good")))
        branch = stage(branch, f"urls-branch-{level}")
        parent = branch.groupBy(F.col("host").alias("ph"), F.col("template").alias("pt")).agg(
            F.sum("n").alias("pn"), F.sum("told").alias("ptold"), F.sum("good").alias("pgood"), F.count("*").alias("kinds"),
            *(F.count_if(F.col("n") == k).alias(f"with{k}") for k in range(1, ENOUGH)),
        )
        both = branch.join(parent, (F.col("host") == F.col("ph")) & (F.col("template") == F.col("pt")))
        few = lambda n: (n < rare * F.col("pn")) & (n < ENOUGH)
        siblings = [(k, F.when(few(F.lit(k)), F.col(f"with{k}")).otherwise(0)) for k in range(1, ENOUGH)]
        single = sum(k * c for k, c in siblings) < 1.5 * sum(c for _, c in siblings)
        seldom = (F.col("kinds") > 1) & few(F.col("n")) & single
        mean = F.col("pgood") / F.greatest("ptold", F.lit(1))
        error = F.sqrt(F.greatest(mean * (1 - mean), F.lit(0.01)) / F.greatest("told", F.lit(1)))
        same = (F.col("kinds") > 1) & (F.col("told") > 0) & (F.abs(F.col("good") / F.greatest("told", F.lit(1)) - mean) <= alike * error)
        named = both.where((F.col("seg") != "*") & ~seldom & ~same).select(F.col("host").alias("bh"), F.col("template").alias("bt"), F.col("seg").alias("bs"))
        named = stage(named, f"urls-named-{level}")
        joined = tree.join(named, (F.col("host") == F.col("bh")) & (F.col("template") == F.col("bt")) & (F.col("seg") == F.col("bs")), "left")
        step = F.when(F.col("seg").isNull(), "").when(F.col("bs").isNull(), "/*").otherwise(F.concat(F.lit("/"), F.col("seg")))
        tree = joined.withColumn("template", F.concat("template", step)).drop("seg", "bh", "bt", "bs")
    tree = stage(tree, "urls-templates")
    sums = lambda *by: tree.groupBy(*by).agg(F.sum("told").alias("told"), F.sum("good").alias("good"))
    all_told, all_good = tree.agg(F.coalesce(F.sum("told"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    overall = all_good / all_told if all_told else 1.0
    smooth = lambda prior: (F.col("good") + strength * prior) / (F.col("told") + strength)
    every = stage(sums("plain").select(F.col("plain").alias("ep"), smooth(F.lit(overall)).alias("everywhere")), "urls-every")
    own = stage(sums("host", "template").select(F.col("host").alias("oh"), F.col("template").alias("ot"), "told", "good"), "urls-own")
    paths = tree.select(F.col("host").alias("th"), F.col("path").alias("tp"), "template", "plain")
    placed = paths.join(own, (F.col("th") == F.col("oh")) & (F.col("template") == F.col("ot"))).join(every, F.col("plain") == F.col("ep"))
    placed = placed.select("th", "tp", "template", smooth(F.col("everywhere")).alias("purity"))
    placed = stage(placed, "urls-paths")
    out = read.join(placed, (F.col("host") == F.col("th")) & (F.col("path") == F.col("tp")))
    judged = F.coalesce("said", F.when(F.col("purity") < purity, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("key", "host", "path", "rule", judged.alias("verdict"), "template", "purity")
