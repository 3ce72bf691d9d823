"""Allow and block rules for URLs, by host suffix and path prefix.

A rule has a host and a path. It fits its host and all subdomains if the URL's path starts
with the rule's path; the longest fitting rule wins, of equally long ones that with the longer
host, then a block. Every distinct (host, path) is expanded into the host suffixes and path
prefixes whose lengths occur in the rules, these expressions meet the rules in an equality
join on a short hash prefix, and full digests confirm each hit.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end.

Cases: a null URL or one without ``://`` has an empty host and path, which no rule fits;
an empty path starts with no rule's path but the empty one; rules with a null host or path
or an unknown action are refused; no rules let everything take the default; repeated URLs
are judged once and every row keeps its own result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.llm import common

#: Rules up to this number (some 100 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_RULES = 200_000
#: Hex digits of the short hash that the join uses.
SHORT_DIGITS = 8


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _shape(rules: DataFrame) -> tuple[int, list[int], list[int]]:
    """Number of rules, and the lengths of their hosts and paths: as many integers as the longest URL has letters, at most."""
    got = rules.agg(
        F.count("*"),
        F.count(F.when(F.col("host").isNull() | F.col("path").isNull() | ~F.coalesce(F.col("action").isin("allow", "block"), F.lit(False)), 1)),
        F.collect_set(F.length("host")),
        F.collect_set(F.length("path")),
    ).first()
    if got[1]:
        raise ValueError(f"{got[1]} rules without host, path or a known action")
    return got[0], sorted(got[2]), sorted(got[3])


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """The kept columns, ``host``, ``path``, ``rule`` (host and path of the rule, or null) and ``verdict``.

    ``rules`` has the columns host, path and action (allow or block).
    """
    common.needs(pages, [url, *keep])
    common.needs(rules, ["host", "path", "action"])
    n_rules, host_lengths, path_lengths = _shape(rules)
    pages = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not n_rules:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    digest = F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)
    short = F.substring("digest", 1, SHORT_DIGITS).alias("short")
    table = (
        rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
        .withColumn("digest", digest)
        .groupBy("digest")
        .agg(F.max("action").alias("action"))  # of a rule given both ways, block
        .select("digest", "action", short)
    )
    whole = F.length("host")
    tails = [
        F.when((whole == n) | (whole > n) & (F.substring(F.col("host"), -n - 1, 1) == "."), F.right("host", F.lit(n)) if n else F.lit(""))
        for n in host_lengths
    ]
    heads = [F.when(F.length("path") >= n, F.left("path", F.lit(n)) if n else F.lit("")) for n in path_lengths]
    urls = pages.select("host", "path").distinct()
    asked = (
        urls.select("host", "path", F.explode(F.array_compact(F.array(*tails))).alias("rule_host"), F.array_compact(F.array(*heads)).alias("heads"))
        .select("host", "path", "rule_host", F.explode("heads").alias("rule_path"))
        .withColumn("digest", digest)
        .select("host", "path", "rule_host", "rule_path", F.col("digest").alias("asked"), short)
    )
    hit = asked.join(common.checked_broadcast(table, n_rules, BROADCAST_RULES), "short").where(F.col("asked") == F.col("digest"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("long"),
        F.length("rule_host").alias("host"),
        F.col("action"),
        F.concat("rule_host", "rule_path").alias("rule"),
    )
    best = hit.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.action")
    out = pages.join(best, ["host", "path"], "left")
    return out.select(*keep, "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
