"""URL filters: pattern rules that are indexed by their rarest literal token.

Every rule is a regular expression over a URL's host and path. What literal tokens (runs of letters and digits) each of its matches
must contain is read off the expression. The rule is filed under the one of them that is rarest among all URLs; a URL's tokens
fetch the rules filed there, and only those run their expressions. A rule without any literal token is filed under the empty token,
which every URL has. Rules are given as a list or as a table of any size.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.frames import staged, without

MOST_SENT_RULES = 10_000    # with more rules than this, candidates are joined by a shuffle


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in host + newline + path; the largest `rank` among the matching rules decides."""
    name: str
    verdict: str
    pattern: str
    rank: int


def _plain(code: int) -> bool:
    return chr(code).isascii() and chr(code).isalnum()


def _breaks(node: tuple) -> bool:
    """Whether all that an item can match, if anything, is no letter or digit: it ends a token, as the text's ends do."""
    kind, value = node
    if kind is op.LITERAL:
        return not _plain(value)
    if kind is op.AT:
        return value in (op.AT_BEGINNING, op.AT_BEGINNING_STRING, op.AT_END, op.AT_END_STRING)
    if kind is op.IN:
        return value[0][0] is not op.NEGATE and all(k is op.LITERAL and not _plain(v) or k is op.RANGE and not any(_plain(c) for c in range(v[0], min(v[1], 127) + 1)) for k, v in value)
    return False


class _Scan:
    """Walks an expression from left to right: the literal run that is open, whether it began at a token's start, whole tokens found."""

    def __init__(self):
        self.run, self.clean, self.found = "", False, []

    def end(self, clean: bool) -> None:
        """The run goes no further: a token if both its sides are no letter or digit."""
        if self.run and self.clean and clean:
            self.found.append(self.run)
        self.run, self.clean = "", clean

    def walk(self, nodes) -> None:
        for node in nodes:
            kind, value = node
            if kind is op.LITERAL and _plain(value):
                self.run += chr(value)
            elif _breaks(node):
                self.end(True)
            elif kind is op.SUBPATTERN and not (value[1] or value[2]):
                self.walk(value[3])
            elif kind is op.BRANCH and all(len(side) and all(map(_breaks, side)) for side in value[1]):
                self.end(True)
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
                self.repeat(*value)
            else:
                self.end(False)

    def repeat(self, least: int, most: int, nodes) -> None:
        if least and all(map(_breaks, nodes)):
            self.end(True)
            return
        inner = _Scan()
        inner.walk(nodes)
        # What is left out leaves the side as it was; what is there has to end a token itself.
        kept = not least and not self.run and self.clean and not inner.run and inner.clean
        if least:
            self.found += inner.found
        self.end(False)
        self.clean = kept


def literals(pattern: str) -> tuple[str, ...]:
    """Letter and digit runs that stand whole in every text that a regular expression finds a match in.

    Only what is certain: what optional, alternative, negated or case-blind parts say is left out, and an expression that cannot be
    read here has none.
    """
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ()
    if tree.state.flags & re.IGNORECASE:
        return ()
    scan = _Scan()
    scan.walk(tree)
    scan.end(False)
    return tuple(dict.fromkeys(scan.found))


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with its subdomains, and a path prefix; longer ones outrank shorter ones, and all outrank `word_rule`s."""
    return Rule(host + path, verdict, rf"^([^\n]*\.)?{re.escape(host)}\n{re.escape(path)}", 1_000 + len(host + path))


def word_rule(verdict: str, word: str) -> Rule:
    """A word of the host, between dots or hyphens."""
    return Rule(f"*{word}*", verdict, rf"(^|[.\-]){re.escape(word)}([.\-]|\n)", len(word))


SITE_RULES = (site_rule("allow", "org", "/"), site_rule("block", "example.org", "/es/"), site_rule("block", "example.org", "/en/1"),
              site_rule("allow", "com", "/fr/"), site_rule("block", "com", "/de/"))
# What the filter adds where no site rule speaks.
WORD_RULES = tuple(word_rule("block", word) for word in ("adult", "porn", "sex", "xxx", "casino", "bets", "betting", "poker", "gambling", "spam", "viagra", "pills", "warez"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased): between the first :// and the next /, ?, # or the end; path: on to the next ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rule_table(spark: SparkSession, rules) -> DataFrame:
    """rule_id, rule, verdict, pattern, rank and literals; a table of rules keeps to its tasks."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.name, r.verdict, r.pattern, r.rank) for r in rules], "rule string, verdict string, pattern string, rank int")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(literals=[list(literals(p)) or [""] for p in batch["pattern"]])
    known = rules.select("rule", "verdict", "pattern", F.col("rank").cast("int").alias("rank")).dropna(subset=["rule", "verdict", "pattern", "rank"])
    known = known.mapInPandas(read, "rule string, verdict string, pattern string, rank int, literals array<string>")
    return staged(known.withColumn("rule_id", F.monotonically_increasing_id()))


def filter_urls(pages: DataFrame, rules=SITE_RULES + WORD_RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Append host, path, rule (null if none fits) and verdict to every row.

    A null url, or one without ://, has an empty host and path, and the default verdict; repeated rows and urls are judged
    alike; of rules with equal ranks the smaller name decides; no rules leave the default; an empty table gives an empty result;
    columns of these names are replaced. `rules`: a list, or a table (rule, verdict, pattern, rank), whose rows with a null are left
    out; patterns are regular expressions searched in host, newline and path.
    """
    spark = pages.sparkSession
    base = without(pages, ["host", "path", "rule", "verdict"])
    host, path = host_and_path(F.col(url))
    split = base.withColumns({"host": host, "path": path})
    # Each different URL is judged once.
    urls = staged(split.select("host", "path").distinct())
    tokens = urls.select("host", "path", F.explode(F.array_distinct(F.concat(F.regexp_extract_all(F.concat_ws("\n", "host", "path"), F.lit("[A-Za-z0-9]+"), 0), F.array(F.lit(""))))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    table = _rule_table(spark, rules)
    named = table.select("rule_id", F.explode("literals").alias("token")).join(counts, "token", "left")
    # A literal that no URL has comes first of all: its rule is never fetched.
    filed = named.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    index = staged(table.join(filed, "rule_id").select("token", "rule", "verdict", "pattern", "rank"))
    index = F.broadcast(index) if index.count() <= MOST_SENT_RULES else index
    fetched = tokens.join(index, "token")
    fits = fetched.filter(F.regexp_like(F.concat_ws("\n", "host", "path"), F.col("pattern")))
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.col("rank")).alias("order"), "rule", "verdict")).alias("best"))
    judged = split.join(best, ["host", "path"], "left")
    columns = [F.col(f"`{c}`") for c in base.columns]
    return judged.select(*columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
