"""URL filter with redirect equivalence, in DataFrame functions only.

A rule names a host, with its subdomains, and a path prefix. Pages linked by redirects (meta refresh) or canonical
links are aliases: connected components over those edges carry a block to every alias that no rule of its own allows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import keys_join, narrowed, rejoin, table
from ._components import components

#: (host, path prefix, verdict).
RULES: tuple[tuple[str, str, str], ...] = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Up to so many rules become one expression; longer lists are joined. Both give the same.
EXPRESSION_RULES = 200

_HOST = "(?s)^.*?://([^/?#]*)"
_PATH = "(?s)^.*?://[^/?#]*([^?#]*)"
_QUERY = "(?s)^.*?://[^?#]*\\?([^#]*)"
_TAG = "(?is)<(?:link|meta)\\s[^>]*>"
_CANONICAL = "(?is)^<link\\s[^>]*rel=[\"']?canonical"
_HREF = "(?is)href=[\"']?([^\"'\\s>]+)"
_REFRESH = "(?is)^<meta\\s[^>]*http-equiv=[\"']?refresh"
_JUMP = "(?is)url=[\"']?([^\"'\\s>]+)"
_SCHEME = "(?s)^(.*?)://"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def key_of(url: Column) -> Column:
    """A page's identity among links: host, path and query without utm_ parameters; scheme and fragment don't count."""
    query = F.regexp_replace(F.regexp_extract(url, _QUERY, 1), "(^|&)utm_[^&]*", "")
    return F.concat(host_of(url), path_of(url), F.lit("?"), query)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; of equally long ones an allow, then the first by text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(rows: DataFrame, host: str, path: str, out: str, rules) -> DataFrame:
    """``rows`` with ``rule_of`` its columns ``host`` and ``path``. rules: a list, or a DataFrame of host, path, verdict.

    A long list meets the distinct places by equal keys only: each suffix of a host is joined with the lengths of that
    host's rules, then with the rules themselves by the path's first so many characters.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= EXPRESSION_RULES:
            return rows.withColumn(out, rule_of(F.col(host), F.col(path), rules))
        listed = F.from_json(F.lit(json.dumps(rules)), "array<array<string>>")
        rules = rows.sparkSession.range(1).select(F.explode(listed).alias("r")).select(*(F.col("r")[i].alias(n) for i, n in enumerate(("host", "path", "verdict"))))
    rule = F.concat("host", "path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"), "verdict"))
    known = table(rules.groupBy("host", F.col("path").alias("prefix")).agg(best.alias("best")), "url-rules")
    widths = table(known.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("widths")), "url-widths")
    parts = F.split("h", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    places = table(rows.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct().select("h", "p", F.explode(suffixes).alias("host")), "url-places")
    tried = keys_join(places, widths, "host", "inner", 200).select("h", "p", "host", F.explode("widths").alias("w")).where(F.col("w") <= F.length("p"))
    tried = tried.select("h", "p", "host", F.col("p").substr(F.lit(1), F.col("w")).alias("prefix"))
    found = keys_join(tried, known, ["host", "prefix"], "inner", 400).groupBy("h", "p").agg(F.max("best").alias("best"))
    found = found.select(F.col("h").alias(host), F.col("p").alias(path), F.struct("best.rule", "best.verdict").alias(out))
    return rejoin(rows, found, [host, path], "left", row_bytes=400)


def _without_dots(path: Column) -> Column:
    """A rooted path with its ``.`` and ``..`` parts applied.

    Parts are folded in blocks of the square root of their number, then the blocks: a fold copies its list at each step.
    """
    start = F.expr("named_struct('up', 0, 'kept', cast(array() as array<string>))")
    none = F.expr("cast(array() as array<string>)")

    def step(acc: Column, x: Column) -> Column:
        up, kept = acc["up"], acc["kept"]
        fewer = F.struct(F.when(F.size(kept) == 0, up + 1).otherwise(up).alias("up"), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))).alias("kept"))
        return F.when(x == "..", fewer).when(x == ".", acc).otherwise(F.struct(up.alias("up"), F.concat(kept, F.array(x)).alias("kept")))

    def joined(parts: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(parts))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / wide).cast("int")), lambda i: F.slice(parts, i * wide + 1, wide))
        folded = F.transform(blocks, lambda block: F.aggregate(block, start, step))
        kept = F.aggregate(folded, none, lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - x["up"], F.lit(0))), x["kept"]))
        last = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))

    # The lambda's variable holds the parts: written out, the split would be made again for each block.
    split = F.transform(F.array(F.split(F.substr(path, F.lit(2)), "/")), joined)
    return F.when(path.contains("/."), F.get(split, F.lit(0))).otherwise(path)


def _resolved(target: Column, url: Column) -> Column:
    """Absolute form of a link in a page; null for a link inside the page and for schemes without ``://``."""
    scheme, path = F.regexp_extract(url, _SCHEME, 1), path_of(url)
    there, rest = F.regexp_extract(target, "(?s)^([^?#]*)", 1), F.regexp_extract(target, "(?s)^[^?#]*(.*)$", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.when(path.contains("/"), F.regexp_extract(path, "(?s)^(.*/)", 1)).otherwise(F.lit("/"))
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("#") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("?"), F.concat(site, path, target))
        .when(target.startswith("/"), F.concat(site, _without_dots(there), rest))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, there)), rest))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, target) from all canonical links and refresh redirects in (url, html)."""
    tags = pages.where("url is not null and html is not null").where(F.col("html").rlike("(?i)canonical|http-equiv"))
    tags = tags.where(F.col("url").contains("://")).select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    target = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _JUMP, 1))
    found = tags.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("target")).where("target <> ''")
    return found.select("url", _resolved(F.col("target"), F.col("url")).alias("target")).where("target is not null")


def url_filter(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, host, path, rule, verdict, via_alias for each row of ``pages``, repeated rows too.

    edges: further (url, target) redirects, beside those in the html. rules: as in ``with_rule``. A rule that fits a page decides it; else it is
    blocked if any of its aliases is blocked by rule, and allowed otherwise. Null urls and urls without ``://`` have an
    empty host and path, fit no rule, have no aliases and are allowed. An empty table gives an empty result.
    """
    rows = narrowed(pages, page_id=id_col, url=url_col, html=html_col).select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    links = alias_edges(rows.select("url", "html"))
    if edges is not None:
        links = links.union(edges.select("url", "target").where("url is not null and target is not null"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = rows.select("page_id", host.alias("host"), path.alias("path"), F.xxhash64(key_of(F.col("url"))).alias("node"))
    judged = with_rule(judged, "host", "path", "r", rules)
    end = lambda c: F.struct(F.xxhash64(key_of(F.col(c))).alias("node"), host_of(F.col(c)).alias("host"), path_of(F.col(c)).alias("path"))
    links = table(links.select(end("url").alias("a"), end("target").alias("b")), "url-links")
    tree = components(links.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    ends = links.select(F.explode(F.array("a", "b")).alias("n")).select("n.*")
    bad = with_rule(ends, "host", "path", "r", rules).where("r.verdict = 'block'").select("node").distinct()
    roots = tree.join(bad, "node").select("root").distinct()
    nodes = table(tree.join(roots, "root").select("node").distinct().withColumn("hit", F.lit(True)), "url-blocked")
    out = keys_join(judged, nodes, "node", "left")
    alias = F.col("r").isNull() & F.col("hit").isNotNull() & (F.col("host") != "")
    return out.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(alias, "block").otherwise("allow")).alias("verdict"), alias.alias("via_alias"),
    )


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_RULE_SQL = """
  SELECT x.*, (SELECT h || p FROM rules WHERE (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule FROM {0} x"""
SQL = rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
found AS (SELECT url, replace(CASE WHEN regexp_matches(tag, '(?is)^<link\s[^>]*rel=["'']?canonical') THEN regexp_extract(tag, '(?is)href=["'']?([^"''\s>]+)', 1)
                           WHEN regexp_matches(tag, '(?is)^<meta\s[^>]*http-equiv=["'']?refresh') THEN regexp_extract(tag, '(?is)url=["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS target FROM tags),
parts AS (SELECT url, target, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS site, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                 regexp_extract(target, '(?s)^([^?#]*)', 1) AS there, regexp_extract(target, '(?s)^[^?#]*(.*)$', 1) AS rest FROM found WHERE target <> ''),
merged AS (SELECT *, CASE WHEN starts_with(target, '/') THEN there WHEN contains(path, '/') THEN regexp_extract(path, '(?s)^(.*/)', 1) || there ELSE '/' || there END AS raw FROM parts),
plain AS (SELECT *, list_reduce(list_prepend([''], list_transform(string_split(raw[2:], '/'), lambda x: [x])),
                 lambda a, b: CASE WHEN b[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN b[1] = '.' THEN a ELSE a || b END) AS kept,
                 CASE WHEN regexp_matches(raw, '(^|/)[.][.]?$') THEN '/' ELSE '' END AS last FROM merged),
links AS (SELECT url, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN scheme || ':' || target
                           WHEN starts_with(target, '#') OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                           WHEN starts_with(target, '?') THEN scheme || '://' || site || path || target
                           ELSE scheme || '://' || site || CASE WHEN len(kept) = 1 THEN '/' ELSE array_to_string(kept, '/') || last END || rest END AS target FROM plain),
urls AS (SELECT url FROM pages UNION SELECT url FROM links UNION SELECT target FROM links WHERE target IS NOT NULL),
split AS (SELECT url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                 regexp_replace(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g') AS query FROM urls),
ruled AS ({_RULE_SQL.format("split")}),
known AS (SELECT r.*, rules.v, r.host || r.path || '?' || r.query AS node FROM ruled r LEFT JOIN rules ON r.rule = h || p),
e AS (SELECT a.node AS a, b.node AS b FROM links JOIN known a ON links.url = a.url JOIN known b ON links.target = b.url),
reach(node, other) AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT r.node, s.b FROM reach r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) s ON r.other = s.a),
bad AS (SELECT DISTINCT r.node FROM reach r JOIN known k ON r.other = k.node WHERE k.v = 'block')
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, v IS NULL AND bad.node IS NOT NULL AS via_alias
FROM pages JOIN known ON pages.url IS NOT DISTINCT FROM known.url LEFT JOIN bad ON known.node = bad.node
"""
