"""Block decisions for URLs, spread over redirect and canonical-link aliases [native: no Python on executors].

A rule (verdict, host, path) fits its host and all its subdomains if the URL's path starts with the
rule's path; the longest host + path wins (a tie: allow first). Aliases are URLs that edges join:
canonical links (<link rel=canonical href=...>) and redirects (<meta http-equiv=refresh
content="...url=...">) of the pages, relative ones (//host/p, /p, p, ../p, ?q, #f) resolved against the page's
URL as RFC 3986 says (<base> is not read; targets of another scheme such as mailto: are no aliases). Two
URLs are the same if scheme and host are equal but for A-Z and path and query are equal; nothing else is
taken to be an alias. Components over these edges share their fate: a URL without a rule is blocked if a
rule blocks some URL of its component, be it a page's or only a link's target. Explicit allow has
precedence: a URL that an allow rule fits stays allowed whatever its component holds; everything else is
allowed.

Edge cases: a null URL or one without :// has an empty host and path, no alias and the verdict allow;
a null page has no links; comments hold none; pages of any length are read whole; repeated rows are judged
alike; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small
from .graph import connected_components

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z in lower case; empty without ://."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The name of a URL: without fragment, scheme and host in lower case; null for one without host."""
    scheme, rest = _lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), rest))


def _links(page: Column) -> Column:
    """The targets of canonical links and redirects in a page."""
    bare = F.regexp_replace(page, r"(?s)<!--.*?(?:-->|\z)", "")
    kind = r"""(?i)\srel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)|\shttp-equiv\s*=\s*["']?\s*refresh\b"""
    tags = F.filter(F.regexp_extract_all(bare, F.lit(r"(?i)<(?:link|meta)\s[^>]*+>"), 0), lambda t: t.rlike(kind))
    link = r"""(?i)\shref\s*=\s*["']?\s*([^"'\s>]+)"""
    move = r"""(?i)url\s*=\s*["']?\s*([^"'\s>]+)"""
    to = F.transform(tags, lambda t: F.replace(F.when(t.rlike(r"(?i)^<link"), F.regexp_extract(t, link, 1)).otherwise(F.regexp_extract(t, move, 1)), F.lit("&amp;"), F.lit("&")))
    # few pages hold either word, and only these are looked through
    return F.when(page.rlike("(?i)canonical|refresh"), to)


def resolved(url: Column, target: Column) -> Column:
    """The name of a link's target on the page at ``url``; null for one that names no place."""
    scheme = _lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    host, path = host_of(url), path_of(url)
    away = target.startswith("//")
    plain, query = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(\?[^#]*)", 1)
    own = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    to = (
        F.when(away, F.regexp_extract(target, r"^//[^/?#]*([^?#]*)", 1))
        .when(plain.startswith("/"), plain)
        .otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), plain))
    )
    # . and .. are walked through, .. at the root stays there; what stands before the first / is empty
    steps = F.split(to, "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
    walked = F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.array(F.lit("")), lambda done, s: F.when(s == ".", done).when(s == "..", up(done)).otherwise(F.concat(done, F.array(s))))
    # a last step . or .. leaves a folder
    walked = F.when(to.rlike(r"/\.\.?\z"), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    there = F.concat(scheme, F.lit("://"), F.when(away, _lower(F.regexp_extract(target, r"^//([^/?#]*)", 1))).otherwise(host), F.array_join(walked, "/"), query)
    # without a path of its own a target is the page, with the target's query if it has one
    here = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", query).otherwise(own))
    relative = F.when((plain == "") & ~away, here).otherwise(there)
    absolute = F.when(target.rlike(r"^[^:]*://"), node_of(target))
    return F.when(host != "", F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), absolute).otherwise(relative))


def _rules(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    one = spark.range(1 if rules else 0)
    each = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h.lower()).alias("rhost"), F.lit(p).alias("rpath")) for v, h, p in rules or [("", "", "")]))
    return one.select(F.explode(each).alias("x")).select("x.*").withColumn("rule", F.concat("rhost", "rpath"))


def _ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, explicit) of the places that some rule fits: one join on the host's suffixes."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    at = places.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("rhost"))
    fit = at.join(small(rules), "rhost").where(F.expr("startswith(path, rpath)"))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "allow").alias("first"), F.col("rule"), F.col("verdict"))).alias("x")
    return fit.groupBy("host", "path").agg(best).select("host", "path", "x.rule", F.col("x.verdict").alias("explicit"))


def judge(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", page_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, component) of every row; component: the first name, by code point, of the URL's component."""
    url = F.col("_url")
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), _links(F.col(page_col).cast("string")).alias("to"))
    rows = materialize(rows.select("_id", "_url", "to", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")), "urls")
    target = rows.where("node is not null").select("node", "_url", F.explode("to").alias("t")).where("t <> ''").select(F.col("node").alias("u"), resolved(url, F.col("t")).alias("v"))
    target = materialize(target.where("v is not null").distinct(), "targets")
    linked = target.select(host_of(F.col("v")).alias("host"), path_of(F.col("v")).alias("path"), F.col("v").alias("node"))
    every = rows.select("host", "path").union(linked.select("host", "path")).where("host <> ''").distinct()
    ruled = materialize(_ruled(every, _rules(df.sparkSession, rules)), "ruled")
    tied = connected_components(target)
    named = rows.select("host", "path", "node").union(linked).join(ruled.where("explicit = 'block'"), ["host", "path"], "left_semi")
    spread = tied.join(named.select("node").distinct(), "node", "left_semi").select("component").distinct().withColumn("spread", F.lit("block"))
    fate = tied.join(spread, "component", "left").select("node", "component", "spread")
    out = rows.drop("to", "_url").join(ruled, ["host", "path"], "left").join(fate, "node", "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("explicit", "spread", F.lit("allow")).alias("verdict"), F.coalesce("component", "node").alias("component"))
