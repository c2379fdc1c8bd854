"""URL filters: rules found by one literal token each, regular expressions run only on the rules found.

Every rule is filed under the rarest of its whole literal tokens, rarest by how often
the URLs of the table at hand hold it. A URL is cut into the same kind of tokens, each
token fetches the rules filed under it, and only those rules' expressions run. A rule
without a whole token is filed under the empty token, which every URL has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobvigil.llm.common import ascii_lower

#: Tokens are what stands between these.
BOUNDS = r"[./]"
#: More rules than this are joined by a shuffle on the token instead of a broadcast.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``; or ``pattern``, a regular expression.

    A pattern is tried on host and path written together. ``tokens`` are literals
    that any text it fits has whole between two of . and / or at an end.
    """

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str | None = None
    tokens: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"/{self.pattern}/" if self.pattern is not None else self.host + self.path

    @property
    def expression(self) -> str:
        return self.pattern if self.pattern is not None else rf"^(?:[^/]*\.)?{re.escape(self.host + self.path)}"

    @property
    def literals(self) -> tuple[str, ...]:
        if self.pattern is not None:
            return tuple(self.tokens) or ("",)
        # the last piece is whole only if a bound follows it, so it is left out
        whole = re.split(BOUNDS, self.host + self.path)[:-1] if self.path else self.host.split(".")
        return tuple(dict.fromkeys(t for t in whole if t)) or ("",)


#: Fixed: what the method itself judges, beneath any rule for hosts. Hosts that name themselves spam, log-in and cart pages.
GENERAL_RULES = (
    Rule("block", pattern=r"(?:^|\.)spam-farm\.", tokens=("spam-farm",)),
    Rule("block", pattern=r"/(?:login|signin)(?:[/.]|$)", tokens=("login",)),
    Rule("block", pattern=r"/(?:signin)(?:[/.]|$)", tokens=("signin",)),
    Rule("block", pattern=r"/cart(?:[/.]|$)", tokens=("cart",)),
    Rule("block", pattern=r"/wp-admin(?:[/.]|$)", tokens=("wp-admin",)),
)

_RULES = "number int, verdict string, name string, expression string, size int, general boolean, literals array<string>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to / ? # or the end, A-Z lower-cased; path from there up to ? or #. Else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules, general=GENERAL_RULES) -> DataFrame:
    rows = [
        (i, r.verdict, r.name, r.expression, len(r.host + r.path), i >= len(rules), list(r.literals))
        for i, r in enumerate([*rules, *general])
    ]
    return spark.createDataFrame(rows, _RULES)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.concat(host, path), BOUNDS))


def file_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules, each with the token it is filed under: its rarest among the URLs' tokens, ties by spelling."""
    literals = rules.select("number", F.explode("literals").alias("token"))
    wanted = F.broadcast(literals.select("token").distinct())
    counts = (
        urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
        .join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    )
    filed = literals.join(F.broadcast(counts), "token", "left").groupBy("number").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")
    )
    return rules.drop("literals").join(filed, "number")


def judge_urls(pages: DataFrame, rules, url: str = "url", general=GENERAL_RULES, otherwise: str = "allow") -> DataFrame:
    """The rows of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are for hosts: the longest that fits decides, and is named in ``rule``;
    of two as long, the one given first. Where none fits, ``rule`` is null and the
    general patterns decide (block, if any fits that blocks), else ``otherwise``.
    A null URL and one without ``://`` have an empty host and path, which no rule for a
    host fits. Repeated rows are judged each; an empty table gives an empty one.
    Columns of ``pages`` that bear one of the four new names are replaced.
    """
    spark = pages.sparkSession
    table = rule_table(spark, list(rules), list(general))
    host, path = host_and_path(F.col(f"`{url}`"))
    # the rows travel as one struct, so that no column of theirs can clash with the ones used here
    whole = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page"), host.alias("host"), path.alias("path"))
    filed = file_rules(whole.select("host", "path"), table)
    if len(rules) + len(general) <= BROADCAST_RULES:
        filed = F.broadcast(filed)
    target = F.concat("host", "path")
    asked = whole.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "token", F.explode(F.array_distinct(F.concat(_tokens(F.col("host"), F.col("path")), F.array(F.lit("")))))
    )
    fits = F.col("number").isNotNull() & F.expr("rlike(concat(host, path), expression)")
    found = F.when(fits, F.struct(
        (~F.col("general")).alias("listed"), F.when(F.col("general"), (F.col("verdict") == "block").cast("int")).otherwise(F.col("size")).alias("size"),
        (-F.col("number")).alias("first"), F.col("name"), F.col("verdict"),
    ))
    # a page's tokens leave one task together, so one row a page is shuffled
    best = (
        asked.join(filed, "token", "left").withColumn("found", found)
        .groupBy("row").agg(F.first("page").alias("page"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("found").alias("found"))
    )
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return best.select(
        *(F.col("page")[c].alias(c) for c in kept), "host", "path",
        F.when(F.col("found.listed"), F.col("found.name")).alias("rule"),
        F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict"),
    )
