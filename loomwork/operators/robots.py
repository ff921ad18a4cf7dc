"""Robots rules against URL tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import row_key, split_host_path


class RuleFormatError(ValueError):
    """A line that is no rule."""


def parse_rules(robots: str | None) -> list[str]:
    """The patterns of a robots text, one Disallow line each; raises RuleFormatError."""
    out = []
    for line in (robots or "").rstrip("\n").split("\n") if robots else []:
        if not line.startswith("Disallow: "):
            raise RuleFormatError(f"not a rule: {line!r}")
        out.append(line[len("Disallow: ") :])
    return out


def rules_of(robots: str | Column) -> Column:
    """The patterns of a robots column; other lines raise an error when the query runs."""
    text = F.regexp_replace(F.coalesce(F.col(robots) if isinstance(robots, str) else robots, F.lit("")), "\n+$", "")
    lines = F.filter(F.split(text, "\n"), lambda x: (text != "") & x.isNotNull())
    good = F.transform(lines, lambda x: F.when(x.startswith("Disallow: "), F.substr(x, F.lit(11))).otherwise(F.raise_error(F.concat(F.lit("not a rule: "), x)).cast("string")))
    return good


def rule_matches(rule: Column, path: Column, strict: bool = False) -> Column:
    """/x: the path starts with it; *x: it holds it; a final $ anchors the end; anything else only with $.

    strict leaves the $ of a rule without / or * as a character of the text.
    """
    ends, star, slash = rule.endswith("$"), rule.startswith("*"), rule.startswith("/")
    bare = F.regexp_replace(F.regexp_replace(rule, r"^\*", ""), r"\$$", "")
    suffix = F.endswith(path, rule) if strict else F.endswith(path, bare)
    return F.when(slash & ends, path == bare).when(slash, F.startswith(path, bare)).when(star & ends, F.endswith(path, bare)).when(star, F.contains(path, bare)).when(ends, suffix).otherwise(F.lit(False))


def robots_disabled(pages: DataFrame, sites: DataFrame, strict: bool = False) -> DataFrame:
    """pages(url, ...) with host and is_disabled by the rules of sites(site, robots); pages without a site are not disabled.

    A site's rules are one array, so the join is on the host alone and keeps one row a page.
    """
    host, path = split_host_path("url")
    rules = sites.select(F.col("site").alias("host"), rules_of("robots").alias("_rules"))
    found = pages.withColumn("host", host).withColumn("_path", F.when(path == "", "/").otherwise(path)).join(rules, "host", "left")
    hit = F.exists("_rules", lambda r: rule_matches(r, F.col("_path"), strict))
    return found.withColumn("is_disabled", F.coalesce(hit, F.lit(False))).drop("_path", "_rules")


def robots_changes(pages: DataFrame, sites: DataFrame, strict: bool = False) -> DataFrame:
    """row_key, url, op of the pages(url, disabled) whose flag is to change: put where Y is missing, delete where it is too many."""
    judged = robots_disabled(pages, sites, strict)
    was = F.coalesce(F.col("disabled") == "Y", F.lit(False))
    changed = judged.where(was != F.col("is_disabled"))
    return changed.select(row_key("url").alias("row_key"), "url", F.when(F.col("is_disabled"), "put").otherwise("delete").alias("op"))


def apply_changes(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """pages with the flags that changes ask for: one row a page, however many pages and changes name the same url, also a null one.

    Changes of a url agree, as its rules are the same for all its pages; of others, put is taken.
    """
    op = changes.groupBy(F.col("url").alias("_url")).agg(F.max("op").alias("_op"))
    flag = F.when(F.col("_op") == "put", "Y").when(F.col("_op").isNull(), F.col("disabled"))
    return pages.join(op, F.col("url").eqNullSafe(F.col("_url")), "left").withColumn("disabled", flag).select(*pages.columns)


def duplicate_sites(sites: DataFrame) -> DataFrame:
    """Hosts with more than one robots row."""
    return sites.groupBy("site").agg(F.count("*").alias("n")).where("n > 1")
