"""URL filter with redirect equivalence.

Pages that redirect to one another, name a common canonical address, or have one address in several spellings, are aliases: connected components over those
edges. A rule that fits a url itself decides it. Otherwise the url takes its component's decision: allowed if an allow
rule fits any member (explicit allows go first), blocked if a block rule fits any member, and allowed if no rule does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, LOWER, ascii_lower, checkpoint, connected_components

#: (host, path, allow). A list in the program, so it is broadcast; longer lists are refused.
MOST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, ascii_lower(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end; empty for null or no ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def node_of(url: Column) -> Column:
    """The address as links compare it: scheme and host lower-cased, no fragment. Null if it has no host."""
    head = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0)
    rest = F.regexp_extract(F.substring(url, F.length(head) + 1, F.length(url)), r"^[^#]*", 0)
    return F.when(host_of(url) != "", F.concat(ascii_lower(head), rest))


def folded(path: Column) -> Column:
    """path, which starts with /, without its . and .. segments."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))
    left = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(left, F.array(F.lit("")))).otherwise(left)
    return F.concat(F.lit("/"), F.array_join(last, "/"))


def resolved(to: Column, base: Column) -> Column:
    """The address that `to` names on a page at base (RFC 3986, 5.2); whole addresses are left as they are."""
    head = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    own = F.regexp_extract(F.substring(base, F.length(head) + 1, F.length(base)), r"^[^?#]*", 0)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    path = F.regexp_extract(to, r"^[^?#]*", 0)
    rest = F.substring(to, F.length(path) + 1, F.length(to))
    folder = F.regexp_extract(F.when(own == "", "/").otherwise(own), r"^.*/", 0)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:/?#]+:", 0), to))
        .when(to.startswith("/"), F.concat(head, folded(path), rest))
        .when(to.startswith("?"), F.concat(head, own, to))
        .when(to.startswith("#"), F.concat(head, own, query, to))
        .otherwise(F.concat(head, folded(F.concat(folder, path)), rest))
    )


def linked_addresses(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(a, b): each page's address and the address that its canonical link or its refresh names, as node_of has them.

    Addresses may be relative to the page's own or to its <base href>. Those without a host (mailto:) are ignored.
    """
    tag = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0)))
    href = F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    moved = F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    is_canonical = F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b")
    is_refresh = F.col("tag").rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")
    based = F.replace(F.regexp_extract(F.col(html), r"(?i)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("&amp;"), F.lit("&"))
    tags = pages.where(F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("url"), based.alias("based"), tag.alias("tag"))
    to = tags.select("url", "based", F.replace(F.when(is_canonical, href).when(is_refresh, moved), F.lit("&amp;"), F.lit("&")).alias("to")).where("to != ''")
    # Exploded, so that the planner doesn't write these expressions out in place of each use.
    base = F.when(F.col("based") != "", resolved(F.col("based"), F.col("url"))).otherwise(F.col("url"))
    to = to.select("url", "to", F.explode_outer(F.array(base)).alias("base"))
    to = to.select("url", F.explode_outer(F.array(resolved(F.col("to"), F.col("base")))).alias("whole"))
    return to.select(node_of(F.col("url")).alias("a"), node_of(F.col("whole")).alias("b")).where("a is not null and b is not null and a != b")


def plain_address(url: Column) -> Column:
    """What addresses of one page have in common: the host without a leading www. or m., and the path without .htm,
    .html and slashes at its end. Scheme, query and fragment don't count, as rules don't see them. Null without a host."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.(?=[^.]+\.)", "")
    return F.when(host_of(url) != "", F.concat(host, F.regexp_replace(F.regexp_replace(path_of(url), r"\.html?$", ""), r"/+$", "")))


def same_page(pages: DataFrame, url: str) -> DataFrame:
    """(a, b): addresses of pages that are ways to write one page's address, each with the smallest of them."""
    known = pages.select(node_of(F.col(url)).alias("a"), plain_address(F.col(url)).alias("_plain")).where("a is not null").distinct()
    least = known.groupBy("_plain").agg(F.min("a").alias("b"), F.count("*").alias("_n")).where("_n > 1")
    return known.join(least, "_plain").where("a != b").select("a", "b")


def fitting_rule(rows: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """rows (host, path, ...) with rule (string) and allow (boolean), both null where no rule fits.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest (host and path together)
    wins; of equals the one with the longer host, then an allow rule.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are broadcast")
    spark = rows.sparkSession
    known = spark.createDataFrame(rules, "_suffix string, _path string, _allow boolean")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    one = F.struct((F.length("_suffix") + F.length("_path")).alias("n"), F.length("_suffix").alias("h"), F.col("_allow").alias("allow"), F.concat("_suffix", "_path").alias("rule"), F.col("_path").alias("path"))
    hosts = rows.select("host").distinct().withColumn("_suffix", F.explode(suffixes)).join(F.broadcast(known), "_suffix").groupBy("host").agg(F.collect_set(one).alias("_rules"))
    hosts = checkpoint(hosts)  # as a table, so that adaptive execution can split a host of very many rows
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return rows.join(hosts, "host", "left").select(*rows.columns, best["rule"].alias("rule"), best["allow"].alias("allow"))


def judge(pages: DataFrame, key: str, url: str, rules: list[tuple[str, str, bool]], html: str | None = None, redirects: DataFrame | None = None, addresses: bool = False) -> DataFrame:
    """One row for each row of pages: key, host, path, rule, verdict (allow or block), component.

    Edges come from the pages' own html, where that column is named, from redirects, a table whose first two columns are
    addresses, and, with addresses, from pages whose addresses are ways to write the same one. component is the smallest address of the aliases, null for pages without any.
    Repeated rows and addresses stay; null urls have empty host and path, no rule and no aliases, and are allowed;
    null html and null redirects give no edges; other columns of pages are dropped; an empty table gives an empty one.
    """
    flat = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    edges = [linked_addresses(pages, url, html)] if html else []
    if addresses:
        edges.append(same_page(pages, url))
    if redirects is not None:
        a, b = redirects.columns[:2]
        edges.append(redirects.select(node_of(F.col(a)).alias("a"), node_of(F.col(b)).alias("b")).where("a is not null and b is not null"))
    judged = fitting_rule(flat, rules).withColumn("_node", node_of(F.col("_url")))
    own = F.when(F.col("allow"), "allow").when(~F.col("allow"), "block")
    if not edges:
        return judged.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce(own, F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    links = edges[0]
    for e in edges[1:]:
        links = links.union(e)
    members = checkpoint(connected_components(links))
    at = members.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    whole = fitting_rule(at, rules).groupBy("component").agg(F.max("allow").alias("_any_allow"), F.min("allow").alias("_all_allow"))
    shared = F.when(F.col("_any_allow"), "allow").when(~F.col("_all_allow"), "block")
    decided = members.join(whole, "component").select(F.col("node").alias("_node"), "component", shared.alias("_shared"))
    out = judged.join(decided, "_node", "left")
    return out.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce(own, "_shared", F.lit("allow")).alias("verdict"), "component")


def sql(rules: list[tuple[str, str, bool]]) -> str:
    low = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    rest = lambda u: f"substr({u}, instr({u}, '://') + 3)"
    host = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN {low(f"regexp_extract({rest(u)}, '^[^/?#]*')")} ELSE '' END"
    path = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    head = lambda u: f"regexp_extract({u}, '^[^:/?#]+://[^/?#]*')"
    node = lambda u: f"CASE WHEN {host(u)} <> '' THEN {low(head(u))} || regexp_extract(substr({u}, length({head(u)}) + 1), '^[^#]*') END"
    rows = ", ".join(f"('{h}', '{p}', {str(a).lower()})" for h, p, a in rules)
    fit = "arg_max(struct_pack(rule := r.h || r.p, allow := r.allow), (length(r.h) + length(r.p)) * 100000000 + length(r.h) * 10 + r.allow::int)"
    on = "(n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p)"
    return f"""WITH RECURSIVE rules(h, p, allow) AS (VALUES {rows}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages),
named AS (SELECT url, replace(CASE WHEN regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) END, '&amp;', '&') AS t FROM tags),
whole AS (SELECT url, CASE WHEN starts_with(t, '//') THEN regexp_extract(url, '^[^:/?#]+:') || t WHEN starts_with(t, '/') THEN {head('url')} || t ELSE t END AS t FROM named WHERE t <> ''),
known AS (SELECT DISTINCT {node('url')} AS a, regexp_replace({host('url')}, '^(?:www|m)\\.([^.]+\\.)', '\\1') || regexp_replace(regexp_replace({path('url')}, '\\.html?$', ''), '/+$', '') AS k FROM pages WHERE {host('url')} <> ''),
half AS (SELECT {node('url')} AS a, {node('t')} AS b FROM whole UNION ALL SELECT a, b FROM known JOIN (SELECT k, min(a) AS b FROM known GROUP BY k) USING (k)),
edges AS (SELECT a, b FROM half WHERE a <> b UNION SELECT b, a FROM half WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
n AS (SELECT node, component, {host('node')} AS host, {path('node')} AS path FROM comp),
fits AS (SELECT n.node, n.component, {fit}.allow AS allow FROM n JOIN rules r ON {on} GROUP BY 1, 2),
shared AS (SELECT component, CASE WHEN bool_or(allow) THEN 'allow' ELSE 'block' END AS v FROM fits GROUP BY 1),
flat AS (SELECT row_number() OVER () AS k, page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages),
own AS (SELECT n.k, {fit} AS best FROM flat n JOIN rules r ON {on} GROUP BY 1)
SELECT f.page_id, f.host, f.path, o.best.rule AS rule, coalesce(CASE WHEN o.best.allow THEN 'allow' WHEN NOT o.best.allow THEN 'block' END, s.v, 'allow') AS verdict, c.component
FROM flat f LEFT JOIN own o USING (k) LEFT JOIN comp c ON c.node = f.node LEFT JOIN shared s ON s.component = c.component"""
