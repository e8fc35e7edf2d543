"""Link filters for asset hrefs and feature links: pattern rules found through their rarest literal token.

A rule is a regular expression over ``host`` + ``path`` and the literal tokens that any match contains.
Every rule is filed under that of its tokens which the fewest of the given links hold.  A link's tokens
fetch the rules filed under them, and only those run.  So the work per link does not grow with the rules,
and a list of any length stays a table that Spark joins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import reliable_checkpoint

TOKEN = r"[a-z0-9]+"
#: Fixed host and path rules: verdict, host with its subdomains, start of the path.
PLACES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Host labels that are blocked where no place rule fits.
LABELS = ("casino-win", "cheap-pills", "free-bets", "spam-farm", "ads-track")

RULES = "rule STRING, verdict STRING, rank INT, pattern STRING, literals ARRAY<STRING>"


def place_rule(verdict: str, host: str, path: str) -> tuple:
    """A rule for a host, all its subdomains and the paths that start with ``path``; longer ones rank higher."""
    literals = re.findall(TOKEN, host)
    # The last token of the path may go on in the link ("/en/a" fits "/en/abc"), so it is no literal.
    literals += re.findall(rf"(?<![A-Za-z0-9]){TOKEN}(?=[^A-Za-z0-9])", path)
    return (f"{host}{path}", verdict, 1000 + len(host) + len(path), rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", literals)


def label_rule(label: str, verdict: str = "block") -> tuple:
    """A rule for hosts with a label, such as ``casino-win`` in ``www.casino-win.org``."""
    return (label, verdict, len(label), rf"^([^/]*\.)?{re.escape(label)}(\.[^/]*)?(/|$)", re.findall(TOKEN, label))


def rule_table(spark: SparkSession, places: Sequence[tuple] = PLACES, labels: Sequence[str] = LABELS) -> DataFrame:
    return spark.createDataFrame([place_rule(*p) for p in places] + [label_rule(x) for x in labels], RULES)


def _lower(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(href: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(href, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(_lower(rest), F.lit(""))


def path_of(href: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(href, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rules`` with ``token``: the literal that the fewest links hold, the first by name of equals."""
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_held"))
    literals = rules.select("rule", "verdict", "rank", "pattern", F.explode("literals").alias("token"))
    rarest = F.min_by("token", F.struct(F.coalesce("_held", F.lit(0)), "token")).alias("token")
    return literals.join(held, "token", "left").groupBy("rule", "verdict", "rank", "pattern").agg(rarest)


def href_verdicts(links: DataFrame, rules: DataFrame | None = None, href: str = "href") -> DataFrame:
    """The links with ``link_host``, ``link_path``, ``rule`` (null when none fits) and ``verdict``.

    Of the rules that fit, the one of highest ``rank`` gives the verdict, the first by name of equals;
    links that none fits are allowed.  ``rules`` has the columns of ``RULES``; every rule needs at least
    one literal token of lower-case letters and digits.  Each different link is judged once.  Null and
    malformed hrefs have an empty host and path.  Columns of the four names are replaced; others may have
    any name.
    """
    rules = rule_table(links.sparkSession) if rules is None else rules
    # Numbered names clash with none, and columns that no reader asks for are not read.
    rows = links.select(F.col(href), "*").toDF("_href", *[f"_column{i}" for i in range(len(links.columns))])
    distinct = rows.where(F.col("_href").isNotNull()).select("_href").distinct()
    target = distinct.select("_href", F.concat(host_of(F.col("_href")), path_of(F.col("_href"))).alias("_target"))
    tokens = target.select(
        "_href", "_target", F.explode(F.array_distinct(F.regexp_extract_all(_lower(F.col("_target")), F.lit(f"({TOKEN})"), F.lit(1)))).alias("token")
    )
    tokens = reliable_checkpoint(tokens)
    index = reliable_checkpoint(filed(rules, tokens))
    fitting = tokens.join(index, "token").where(F.expr("_target RLIKE pattern"))
    best = fitting.groupBy("_href").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.col("rank"), F.col("rule"))).alias("_best"))
    judged = rows.join(reliable_checkpoint(best), "_href", "left")
    carried = [F.col(f"_column{i}").alias(c) for i, c in enumerate(links.columns) if c not in ("link_host", "link_path", "rule", "verdict")]
    return judged.select(
        *carried, host_of(F.col("_href")).alias("link_host"), path_of(F.col("_href")).alias("link_path"),
        F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"),
    )
