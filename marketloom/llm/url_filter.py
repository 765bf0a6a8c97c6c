"""URL filters with redirect equivalence.

Rules name a host and the beginning of a path. Pages that redirect or point by a canonical link to one another are aliases: a block
decision on any of them (or on a link target that is no page of the table) holds for all of them, except for those
that a rule of their own allows. Aliases are connected components over the redirect and canonical-link edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marketloom.llm.common import bound, durable, small_side
from marketloom.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"

# Comments and scripts, whichever begins first; one that is never closed runs to the end of the page.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
# Group 1 is a link or meta tag; a > in a quoted value does not end it. One that is never closed takes the rest of the page, so no part is scanned
# again and again.
TAG = (
    r"""(?is)(<(?:link|meta)\b[^>=]*+(?:=\s*+(?:(?:"[^"]*+"|'[^']*+'|[^\s"'>=])[^>=]*+)?+)*+>)"""
    r"""|<(?:link|meta)\b.*"""
)
# Name and value of an attribute: a value ends with its quote, or without quotes at white space.
ATTRIBUTE = r"""(?<![^\s=/"'<>])[^\s=/"'<>]++\s*+=\s*+(?:"[^"]*"?|'[^']*'?|[^\s"'>]+)"""
DOTS = r"/\.\.?(?:/|$)"  # a path with dot segments


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1))


@F.pandas_udf(StringType())
def _without_dots(paths: pd.Series) -> pd.Series:
    """Paths with their dot segments resolved, in one pass over each; nulls stay."""

    def resolved(path: str) -> str:
        kept = []
        segments = path.split("/")[1:]
        for segment in segments:
            if segment == "..":
                del kept[-1:]
            elif segment != ".":
                kept.append(segment)
        return "/" + "/".join(kept + [""] * (segments[-1] in (".", "..")))

    return paths.map(resolved, na_action="ignore")


def node_of(url: Column) -> Column:
    """Names a page whatever its scheme and fragment: host, path and query. Null without a host.

    An empty path is ``/``, dot segments are resolved, and the scheme's own port (80 of http, 443 of https) or an empty one goes.
    """
    scheme, path = scheme_of(url), path_of(url)
    port = F.when(scheme == "http", ":(80)?$").when(scheme == "https", ":(443)?$").otherwise(":$")
    dotted = _without_dots(F.when(path.rlike(DOTS), path))
    plain = F.coalesce(dotted, F.when(path == "", "/"), path)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 3)
    return F.when(host_of(url) != "", F.concat(F.regexp_replace(host_of(url), port, F.lit("")), plain, query))


def matched(frame: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule, verdict): the longest rule that fits each row's host and path; rows without one are absent.

    A host is looked up by each of its suffixes, so the join has as many rows as the host has labels. Of equally long
    rules, which are one rule with two verdicts, an allowing one wins.
    """
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    spread = frame.select(key, "host", "path", F.explode(suffixes).alias("rule_host"))
    fits = spread.join(rules, "rule_host").where(F.startswith(F.col("path"), F.col("rule_path")))
    best = fits.groupBy(key).agg(
        F.max(
            F.struct(
                F.length(F.concat("rule_host", "rule_path")).alias("length"),
                (F.col("rule_verdict") == "allow").alias("allows"),
                F.concat("rule_host", "rule_path").alias("rule"),
                F.col("rule_verdict").alias("verdict"),
            )
        ).alias("best")
    )
    return best.select(key, "best.rule", "best.verdict")


def _resolved(link: Column, url: Column) -> Column:
    """A link target as an absolute url; null where it is none."""

    def absolute(clean: Column) -> Column:
        site = F.concat(scheme_of(url), F.lit("://"), host_of(url))
        folder = F.concat(site, F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1))
        return (
            F.when((clean == "") | F.startswith(clean, F.lit("#")), F.lit(None))
            .when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), clean)
            .when(F.startswith(clean, F.lit("//")), F.concat(scheme_of(url), F.lit(":"), clean))
            .when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(F.startswith(clean, F.lit("?")), F.concat(site, path_of(url), clean))
            .when(F.startswith(clean, F.lit("/")), F.concat(site, clean))
            .when(folder == site, F.concat(site, F.lit("/"), clean))
            .otherwise(F.concat(folder, clean))
        )

    return bound(F.replace(link, F.lit("&amp;"), F.lit("&")), absolute)


def _attribute(attributes: Column, name: str) -> Column:
    """The value of the first attribute of that name, without its quotes, or an empty text."""
    own = F.get(F.filter(attributes, lambda a: a.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    return F.trim(F.coalesce(F.regexp_replace(own, r"""(?s)^[^=]*=\s*["']?|["']$""", ""), F.lit("")))


def _link(tag: Column) -> Column:
    """The target that a link or meta tag names, or an empty text."""

    def named(attributes: Column) -> Column:
        refresh = F.regexp_extract(_attribute(attributes, "content"), r"(?is)^[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?(\S+)", 1)
        words = F.split(F.lower(_attribute(attributes, "rel")), r"\s+")
        return (
            F.when(F.array_contains(words, "canonical"), _attribute(attributes, "href"))
            .when(F.lower(_attribute(attributes, "http-equiv")) == "refresh", F.regexp_replace(refresh, r"""^["']|["']$""", ""))
            .otherwise("")
        )

    return bound(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), named)


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): page and target of each canonical link and each redirect by refresh in the markup.
    Links in comments, in scripts and in tags that are never closed do not count."""
    named = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    hinted = named.where(F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").contains("://"))
    tags = F.regexp_extract_all(F.regexp_replace("html", HIDDEN, " "), F.lit(TAG), F.lit(1))
    links = hinted.select("url", F.explode(F.filter(F.transform(tags, _link), lambda link: link != "")).alias("link"))
    ends = links.select(node_of(F.col("url")).alias("a"), node_of(_resolved(F.col("link"), F.col("url"))).alias("b")).distinct()
    return ends.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, by_alias.

    The verdict is that of the page's own longest rule; else block if an alias is blocked (``by_alias`` is true then); else allow. A null url, or
    one without ``://``, has empty host and path, fits no rule, has no aliases and is allowed. Null html has no links. Repeated rows get
    equal verdicts; an empty table gives no rows.
    """
    spark = pages.sparkSession
    rule_rows = spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")
    base = pages.select(
        F.col(page_id).alias("page_id"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        node_of(F.col(url)).alias("node"),
    )
    place = F.concat_ws("", "host", "path").alias("place")
    own = matched(base.select(place, "host", "path").where("host <> ''").distinct(), rule_rows, "place")

    edges = durable(alias_edges(pages, url, html))
    classes = connected_components(edges)
    nodes = classes.select("node", "component", F.concat(F.lit("x://"), "node").alias("url")).select(
        "node", "component", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    blocked = matched(nodes, rule_rows, "node").where("verdict = 'block'").join(classes, "node").select("component").distinct()
    aliases = small_side(durable(classes.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("by_alias"))))

    judged = base.withColumn("place", place).join(own, "place", "left").join(aliases, "node", "left")
    by_alias = F.col("rule").isNull() & F.coalesce("by_alias", F.lit(False))
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(by_alias, "block"), F.lit("allow")).alias("verdict"),
        by_alias.alias("by_alias"),
    )



def _sql_parts(url: str, name: str) -> str:
    """Host, path and query of the page that a url names, as ``node_of`` has them."""
    host = f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1)"
    path = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    port = f"CASE WHEN {url} ILIKE 'http://%' THEN ':(80)?$' WHEN {url} ILIKE 'https://%' THEN ':(443)?$' ELSE ':$' END"
    closed = f"regexp_replace({path}, '(/[.][.]?)$', '\\1/')"
    step = "CASE part WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || part END"
    return f"""
    regexp_replace(translate({host}, '{UPPER}', '{LOWER}'), {port}, '') AS {name}_host,
    CASE WHEN {path} = '' THEN '/' ELSE
      list_reduce(list_prepend('', string_split({closed}, '/')[2:]), lambda done, part: {step}) END AS {name}_path,
    regexp_extract({url}, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)', 1) AS {name}_query"""


def _sql_attribute(name: str) -> str:
    own = rf"list_filter(attributes, lambda a: regexp_matches(a, '(?i)^{name}\s*='))[1]"
    return rf"""trim(coalesce(regexp_replace({own}, '(?s)^[^=]*=\s*["'']?|["'']$', '', 'g'), ''))"""


ORACLE_SQL = rf"""
WITH RECURSIVE rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
tags AS (
  SELECT url, host, path, unnest(regexp_extract_all(
    regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)', ' ', 'g'),
    '(?is)(<(?:link|meta)\b[^>=]*(?:=\s*(?:(?:"[^"]*"|''[^'']*''|[^\s"''>=])[^>=]*)?)*>)|<(?:link|meta)\b.*', 1)) AS tag
  FROM p WHERE host <> '' AND regexp_matches(html, '(?i)canonical|http-equiv')),
named AS (
  SELECT url, host, path,
    regexp_extract_all(tag, '[^\s=/"''<>]+\s*=\s*(?:"[^"]*"?|''[^'']*''?|[^\s"''>]+)') AS attributes
  FROM tags),
links AS (
  SELECT url, host, path, replace(CASE
    WHEN list_contains(regexp_split_to_array(lower({_sql_attribute('rel')}), '\s+'), 'canonical') THEN {_sql_attribute('href')}
    WHEN lower({_sql_attribute('http-equiv')}) = 'refresh'
      THEN regexp_replace(regexp_extract({_sql_attribute('content')}, '(?is)^[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?(\S+)', 1),
                          '^["'']|["'']$', '', 'g')
    ELSE '' END, '&amp;', '&') AS link
  FROM named),
targets AS (
  SELECT url, CASE
    WHEN link = '' OR link LIKE '#%' THEN NULL
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN link LIKE '//%' THEN scheme || ':' || link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN link LIKE '?%' THEN scheme || '://' || host || path || link
    WHEN link LIKE '/%' THEN scheme || '://' || host || link
    WHEN folder = '' THEN scheme || '://' || host || '/' || link
    ELSE scheme || '://' || host || folder || link END AS target
  FROM (SELECT *, lower(regexp_extract(url, '(?s)^(.*?)://', 1)) AS scheme, regexp_extract(path, '(?s)^(.*/)', 1) AS folder FROM links)),
ends AS (
  SELECT {_sql_parts('url', 'a')}, {_sql_parts('target', 'b')}
  FROM targets WHERE target IS NOT NULL),
pairs AS (
  SELECT a_host || a_path || a_query AS a, b_host || b_path || b_query AS b, * FROM ends WHERE a_host <> '' AND b_host <> ''),
edges AS (
  SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
reach AS (
  SELECT a, b FROM edges
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
nodes AS (
  SELECT a AS node, a_host AS host, a_path AS path FROM pairs UNION SELECT b, b_host, b_path FROM pairs),
places AS (
  SELECT host, path FROM p WHERE host <> '' UNION SELECT host, path FROM nodes),
own AS (
  SELECT host, path, rule_host || rule_path AS rule, verdict FROM places JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, verdict, rule_host || rule_path DESC) = 1),
blocked AS (
  SELECT node FROM nodes JOIN own USING (host, path) WHERE verdict = 'block'),
aliases AS (
  SELECT DISTINCT r.a AS node FROM reach r JOIN blocked ON blocked.node = r.b),
pages_named AS (
  SELECT page_id, host, path, n_host || n_path || n_query AS node
  FROM (SELECT page_id, host, path, {_sql_parts("coalesce(url, '')", 'n')} FROM p))
SELECT page_id, host, path, rule,
  coalesce(own.verdict, CASE WHEN aliases.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  rule IS NULL AND aliases.node IS NOT NULL AS by_alias
FROM pages_named LEFT JOIN own USING (host, path) LEFT JOIN aliases ON aliases.node = pages_named.node AND host <> ''
"""
