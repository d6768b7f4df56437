"""URL filters that follow redirects and canonical links.

A page's own url is judged by rules (host and path prefix; longest wins). Pages and the
targets of their canonical links and meta refreshes are nodes of a graph; its connected
components are sets of aliases. A page without a rule takes the decision of its aliases: any
explicitly allowed url allows, else any blocked one blocks, else it is allowed. Targets
that are no pages themselves are judged by the rules too, as aliases.

A node is host, path and query; scheme and fragment do not tell pages apart. Null urls and
urls without `://` have empty host and path, fit no rule and are nobody's alias. Null html
has no links. Repeated rows come back once each; an empty table gives no rows; columns
other than page_id, url and html are not read. A host with a third of all pages is no hot
group, as nothing is grouped by host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.components import components
from lorewell.llm.shared import table, written

# (verdict, host and path prefix)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REST = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_QUOTED = r"""\s*=\s*["']?\s*([^"'\s>]+)"""
_LINK = r"(?is)<link\b[^>]*>"
_META = r"(?is)<meta\b[^>]*>"


def host_of(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_text(url), _REST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host to ? or #."""
    return F.regexp_extract(_text(url), _REST, 2)


def _text(url: Column) -> Column:
    return F.coalesce(url.cast("string"), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """Host, path and query; null if there is no host."""
    host = host_of(url)
    path = F.regexp_replace(path_of(url), "^$", "/")
    return F.when(host != "", F.concat(host, path, F.regexp_extract(_text(url), _REST, 3)))


def alias_targets(html: Column) -> Column:
    """Targets of canonical links and meta refreshes, as written in the page."""
    text = F.coalesce(html.cast("string"), F.lit(""))
    links = F.filter(
        F.regexp_extract_all(text, F.lit(_LINK), F.lit(0)),
        lambda x: x.rlike(r"""(?i)\brel\s*=\s*["']?\s*canonical\b"""),
    )
    refreshes = F.filter(
        F.regexp_extract_all(text, F.lit(_META), F.lit(0)),
        lambda x: x.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""),
    )
    hrefs = F.transform(links, lambda x: F.regexp_extract(x, r"(?is)\bhref" + _QUOTED, 1))
    urls = F.transform(refreshes, lambda x: F.regexp_extract(x, r"(?is);\s*url" + _QUOTED, 1))
    return F.filter(F.concat(hrefs, urls), lambda x: x != "")


def absolute(target: Column, url: Column) -> Column:
    """The target as a full url, read from the page at `url`."""
    scheme = F.regexp_extract(_text(url), r"(?s)^(.*?)://", 1)
    base = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .when(target.rlike("^[?#]"), F.concat(base, path_of(url), target))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), target))
    )


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    page = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    judged = page.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumns({"own": rule_of(F.col("host"), F.col("path"), rules), "node": node_of(F.col("url"))})
    targets = pages.select(
        F.col("url").cast("string").alias("url"), F.explode(alias_targets(F.col("html"))).alias("target")
    )
    # Only pages with such a link are written; most have none.
    links = written(
        targets.withColumn("to_url", absolute(F.col("target"), F.col("url")))
        .select(node_of(F.col("url")).alias("u"), node_of(F.col("to_url")).alias("v"),
                F.col("url").alias("u_url"), F.col("to_url").alias("v_url"))
        .filter("u IS NOT NULL AND v IS NOT NULL").distinct(), "aliases",
    )
    ends = links.select(F.col("u").alias("node"), F.col("u_url").alias("url")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v_url").alias("url"))
    )
    verdict = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    of_node = components(links.select("u", "v"))
    decided = (
        of_node.join(ends.withColumn("said", verdict).groupBy("node").agg(F.min("said").alias("said")), "node")
        .groupBy("component").agg(F.min("said").alias("said"))  # allow sorts before block
    )
    aliases = of_node.join(decided, "component").select("node", "said")
    out = judged.join(aliases, "node", "left")
    return out.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "said", F.lit("allow")).alias("verdict"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql_host(url: str) -> str:
    return f"translate(regexp_extract({url}, '{_REST}', 1), '{UPPER}', '{LOWER}')"


def _sql_path(url: str) -> str:
    return f"regexp_extract({url}, '{_REST}', 2)"


def _sql_rule(host: str, path: str, part: int) -> str:
    """CASE over the rules, longest first; part 1: the rule, 0: its verdict."""
    cases = []
    for rule in sorted(RULES, key=lambda x: -len(x[1])):
        name, slash, rest = rule[1].partition("/")
        fits = f"({host} = '{name}' OR ends_with({host}, '.{name}')) AND starts_with({path}, '{slash}{rest}')"
        cases.append(f"WHEN {fits} THEN '{rule[part]}'")
    return f"CASE {' '.join(cases)} END"


def _sql_node(url: str) -> str:
    path = f"CASE WHEN {_sql_path(url)} = '' THEN '/' ELSE {_sql_path(url)} END"
    return f"CASE WHEN {_sql_host(url)} <> '' THEN {_sql_host(url)} || {path} || regexp_extract({url}, '{_REST}', 3) END"


_SQL_QUOTED = _QUOTED.replace("'", "''")
OP7_SQL = f"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
j AS (SELECT *, {_sql_host("url")} AS host, {_sql_path("url")} AS path, {_sql_node("url")} AS node FROM p),
tags AS (
  SELECT url, regexp_extract(tag, '(?is)\\bhref{_SQL_QUOTED}', 1) AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, '{_LINK}')) AS tag FROM p)
  WHERE regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?\\s*canonical\\b')
  UNION ALL
  SELECT url, regexp_extract(tag, '(?is);\\s*url{_SQL_QUOTED}', 1) AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, '{_META}')) AS tag FROM p)
  WHERE regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')),
based AS (
  SELECT *, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, {_sql_path("url")} AS path,
    regexp_extract({_sql_path("url")}, '(?s)^(.*/)', 1) AS folder, {_sql_host("url")} AS host
  FROM tags WHERE target <> ''),
links AS (
  SELECT url AS u_url, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN scheme || ':' || target
    WHEN starts_with(target, '/') THEN scheme || '://' || host || target
    WHEN regexp_matches(target, '^[?#]') THEN scheme || '://' || host || path || target
    ELSE scheme || '://' || host || CASE WHEN folder = '' THEN '/' ELSE folder END || target END AS v_url
  FROM based),
named AS (SELECT u_url, v_url, {_sql_node("u_url")} AS u, {_sql_node("v_url")} AS v FROM links),
ends AS (
  SELECT u AS node, u_url AS url FROM named WHERE u IS NOT NULL AND v IS NOT NULL
  UNION SELECT v, v_url FROM named WHERE u IS NOT NULL AND v IS NOT NULL),
said AS (
  SELECT node, min({_sql_rule(_sql_host("url"), _sql_path("url"), 0)}) AS said FROM ends GROUP BY node),
reach(a, b) AS (
  SELECT node, node FROM ends
  UNION
  SELECT r.a, CASE WHEN r.b = n.u THEN n.v ELSE n.u END
  FROM reach r JOIN named n ON (r.b = n.u AND n.v IS NOT NULL) OR (r.b = n.v AND n.u IS NOT NULL)),
decided AS (SELECT a AS node, min(said) AS said FROM reach JOIN said ON b = said.node GROUP BY a)
SELECT page_id, host, path, {_sql_rule("host", "path", 1)} AS rule,
  coalesce({_sql_rule("host", "path", 0)}, said, 'allow') AS verdict
FROM j LEFT JOIN decided USING (node)
"""
