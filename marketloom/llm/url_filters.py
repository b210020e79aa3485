"""URL rules with redirect equivalence.

A url's own rule decides first. Urls that redirects or canonical links join are one component; a component
with a blocked url blocks its members that no rule fits. An explicit allow always holds for the url that
it fits, so a blocked alias never overrides it. Everything is SQL functions; no Python runs on executors.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules are part of the plan as literals; longer lists become a table.
MAX_RULES = 200
#: The bytes that the Windows table of Western letters leaves undefined.
UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """One key for spellings that never differ on the server: no scheme, no fragment, host in lower case."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    path = url_path(url)
    return F.when(F.instr(url, "://") > 0, F.concat(url_host(url), F.when(path == "", F.lit("/")).otherwise(path), query))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits, of equally long ones an allow; null if none. rules: (action, 'host/path'), part of the plan
    as literals; `match_rules` takes a table of any size."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):  # the longest is tested first, of equal ones allow
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def match_rules(d: DataFrame, rules: DataFrame | Sequence[tuple[str, str]], host: str, path: str, out: str) -> DataFrame:
    """d with the column `out`: struct(rule, action) of the longest rule that fits, of equally long ones an allow; null if none.

    A table of rules (action, rule) is joined on the suffixes of each distinct host, so that its size does not matter.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= MAX_RULES:
            return d.withColumn(out, match_rule(F.col(host), F.col(path), rules))
        rules = d.sparkSession.createDataFrame(list(rules), "action string, rule string")
    at = F.instr("rule", "/")
    name = F.when(at > 0, F.substring(F.col("rule"), F.lit(1), at - 1)).otherwise(F.col("rule"))
    rest = F.when(at > 0, F.substring(F.col("rule"), at, F.length("rule"))).otherwise(F.lit(""))
    r = rules.select("rule", "action", name.alias("_name"), rest.alias("_rest"))
    parts = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    urls = d.select(F.col(host).alias("_h"), F.col(path).alias("_p")).distinct()
    fits = urls.withColumn("_name", F.explode(suffixes)).join(r, "_name").where(F.col("_p").startswith(F.col("_rest")))
    best = fits.groupBy("_h", "_p").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule", "action")).alias("_b"))
    best = best.select("_h", "_p", F.struct(F.col("_b.rule").alias("rule"), F.col("_b.action").alias("action")).alias(out))
    return d.join(best, (d[host] == best["_h"]) & (d[path] == best["_p"]), "left").drop("_h", "_p")


#: A character reference, with what tells whether it ends, or text up to the next one.
_PIECES = r"(&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*[;=]?|[^&]+|&)"


def unescaped(x: Column) -> Column:
    """An attribute's value with its character references decoded, each once, from left to right.

    Numbers are code points (those from 128 to 159 by the Windows table that browsers use; 0, surrogates and what is too
    large give U+FFFD); names are those of the HTML standard. A name without a semicolon that a letter, a digit or = follows
    is text, as the standard has it for attributes.
    """
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")  # a constant of the plan
    windows = F.create_map(*[F.lit(v) for i in range(128, 160) for v in (i, bytes([i]).decode("cp1252", "replace") if i not in UNDEFINED else chr(i))])

    def char(code: Column) -> Column:
        hexed = F.lpad(F.hex(code), 8, "0")
        odd = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        return F.when(odd, "\uFFFD").when(code.between(128, 159), F.try_element_at(windows, code.cast("int"))).otherwise(F.decode(F.unhex(F.when(odd, F.lit("0000FFFD")).otherwise(hexed)), "UTF-32"))

    def decoded(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^&#[xX]?0*([0-9A-Fa-f]*)", 1)
        number = F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(F.coalesce(F.when(p.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"), F.lit(0)))
        return F.when(p.rlike("^&#[xX]?[0-9A-Fa-f]"), char(number)).when(p.startswith("&"), F.coalesce(F.try_element_at(names, F.substring(p, 2, 1 << 30)), p)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(_PIECES), F.lit(1)), decoded), "")


def _attribute(tag: str, name: str) -> Column:
    """The value of a tag's attribute, quoted (with blanks) or not; empty if it is missing."""
    one = lambda rest: F.regexp_extract(tag, rf"(?is)(?:^|[\s\"'/]){name}\s*=\s*{rest}", 1)
    quoted, single, bare = one('"([^"]*)"'), one("'([^']*)'"), one(r"([^\s\"'>]+)")
    return F.trim(F.when(quoted != "", quoted).when(single != "", single).otherwise(bare))


def _without_dots(path: Column) -> Column:
    """The path with its . and .. segments resolved (RFC 3986, 5.2.4)."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    last = F.element_at(segments, -1)
    empty = F.array().cast("array<string>")
    kept = F.aggregate(segments, empty, lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(empty)), "/"))


def _resolved(links: DataFrame, u: str, t: str, out: str) -> DataFrame:
    """links with the column out: link t of a page u as a whole url by the rules of RFC 3986, null for other schemes and empty links."""
    names = [c for c in ("_t", "_scheme", "_base", "_own", "_path", "_query")]
    d = links.withColumn("_t", F.regexp_replace(F.regexp_replace(unescaped(F.col(t)), r"^\s+|\s+$|[\t\r\n]", ""), r"#.*$", ""))
    x = F.col("_t")
    d = d.withColumns({"_scheme": F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), "_base": url_host(F.col(u)), "_own": url_path(F.col(u)), "_path": F.regexp_extract("_t", r"^([^?]*)", 1), "_query": F.regexp_extract("_t", r"^[^?]*(\?.*)", 1)})
    folder = F.when(F.col("_own") == "", F.lit("/")).otherwise(F.regexp_replace("_own", r"[^/]*$", ""))
    path = F.when(F.col("_path") == "", F.col("_own")).when(F.col("_path").startswith("/"), F.col("_path")).otherwise(F.concat(folder, "_path"))
    d = d.withColumn("_path", path)
    near = F.concat("_scheme", F.lit("://"), "_base", F.when(F.col("_path") == "", "").otherwise(_without_dots(F.col("_path"))), "_query")
    whole = F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), x).when(x.startswith("//"), F.concat("_scheme", F.lit(":"), x)).otherwise(near)
    good = (x != "") & (x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") | ~x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"))
    return d.withColumn(out, F.when(good, whole)).drop(*names)


def resolved_links(links: DataFrame) -> DataFrame:
    """u, full: the links t of pages u as whole urls by the rules of RFC 3986; those of other schemes are left out."""
    return _resolved(links, "u", "t", "full").where("full IS NOT NULL").select("u", "full")


def alias_urls(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) urls of redirect (meta refresh) and canonical links in the pages' markup, resolved against the page's url or
    the first <base> element that has a link; links in comments, scripts and styles are none."""
    page = pages.where(F.col(html).rlike(r"(?i)canonical|refresh") & (F.instr(F.col(url), "://") > 0)).select(F.col(url).alias("u"), F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|template)\b.*?(?:</\1\s*>|\z)", " ").alias("h"))
    tags = F.regexp_extract_all(F.col("h"), F.lit(r"(?is)(<(?:link|meta|base)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)"), F.lit(1))
    page = page.select("u", tags.alias("tags"))
    page = page.withColumn("first_base", F.coalesce(F.get(F.filter("tags", lambda x: x.rlike(r"(?is)^<base\b.*[\s\"'/]href\s*=")), F.lit(0)), F.lit("")))
    page = _resolved(page.withColumn("base_link", _attribute("first_base", "href")), "u", "base_link", "from")
    page = page.select("u", F.coalesce("from", "u").alias("from"), F.explode("tags").alias("tag"))
    page = page.withColumns({"rel": F.lower(_attribute("tag", "rel")), "equiv": F.lower(_attribute("tag", "http-equiv")), "href": _attribute("tag", "href"), "content": _attribute("tag", "content")})
    to = F.when(F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split("rel", r"\s+"), "canonical"), F.col("href")).when(
        F.col("tag").rlike("(?i)^<meta") & (F.col("equiv") == "refresh"), F.regexp_extract("content", r"(?is)^[^;,\s]*[;,\s]\s*(?:url\s*=\s*)?[\"']?([^\"']+)", 1)
    )
    links = _resolved(page.select("u", "from", to.alias("t")).where("t <> ''"), "from", "t", "full").where("full IS NOT NULL")
    return links.select(F.col("u").alias("src"), F.col("full").alias("dst"))


def filter_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str]], url: str = "url", html: str | None = "html", edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (action, 'host/path') pairs, or a table (action, rule). edges: further (src, dst) urls known from crawl
    logs. A url's own rule holds, an explicit allow too where an alias is blocked; urls without a rule are blocked if a
    url of their component fits a block rule. Null and odd urls get empty host and path, no rule and the default
    verdict; very long urls and pages count whole; repeated rows stay; no rows give no rows; columns of the result's
    names are replaced, others may have any names.
    """
    found = alias_urls(pages, url, html) if html else None
    if edges is not None:
        more = edges.select("src", "dst")
        found = more if found is None else found.unionByName(more)
    d = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    d = match_rules(d, rules, "host", "path", "_fit")
    spread = F.lit(None).cast("string")
    if found is not None:
        found = saved(found.distinct())
        parts = saved(connected_components(found.select(url_key(F.col("src")).alias("src"), url_key(F.col("dst")).alias("dst"))))
        # Rules judge the urls as they are written, of which a node may have several.
        urls = found.select(F.explode(F.array("src", "dst")).alias("u")).distinct()
        urls = urls.select(url_key(F.col("u")).alias("node"), url_host(F.col("u")).alias("h"), url_path(F.col("u")).alias("p"))
        bad = match_rules(urls, rules, "h", "p", "fit").where("fit.action = 'block'").select("node").distinct()
        bad = parts.join(bad, "node", "left_semi").select("component").distinct()
        blocked = parts.join(bad, "component", "left_semi").select(F.col("node").alias("_key"), F.lit("block").alias("_spread"))
        d = d.withColumn("_key", url_key(F.col(url))).join(blocked, "_key", "left")
        spread = F.col("_spread")
    return d.withColumns({"rule": F.col("_fit.rule"), "verdict": F.coalesce(F.col("_fit.action"), spread, F.lit(default))}).drop("_fit", "_key", "_spread")
