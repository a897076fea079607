"""URL rules with redirect equivalence: decisions spread to all aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.components import checkpointed, components

#: (host, path, verdict); a rule fits its host and all subdomains, on paths that start with its path.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

_AFTER_SCHEME = r"(?s)^.*?://(.*)$"
_TAGS = r"(?is)<link\b[^>]*\bcanonical\b[^>]*>|<meta\b[^>]*\brefresh\b[^>]*>"
_ATTRIBUTE = r"(?is)\b{}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parsed(url: Column) -> Column:
    """struct<host, path, address> of a URL.

    Host has A-Z lower-cased; host and path are empty without ``://`` or url.
    address is what identifies a page in the alias graph: host, path and query
    without scheme and fragment; null without a host.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.coalesce(F.regexp_extract(url, _AFTER_SCHEME, 1), F.lit(""))
    fields = F.transform(
        F.array(rest),
        lambda r: F.struct(
            F.translate(F.regexp_extract(r, r"^[^/?#]*", 0), upper, lower).alias("host"),
            F.regexp_extract(r, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
            F.regexp_extract(r, r"(?s)^[^/?#]*([^#]*)", 1).alias("tail"),
        ),
    )
    return F.get(
        F.transform(
            fields,
            lambda f: F.struct(
                f["host"].alias("host"), f["path"].alias("path"),
                F.when(f["host"] != "", F.concat(f["host"], F.when(f["tail"] == "", "/").otherwise(f["tail"]))).alias("address"),
            ),
        ),
        F.lit(0),
    )


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTRIBUTE.format(name)
    return F.concat(*(F.coalesce(F.regexp_extract(tag, pattern, i), F.lit("")) for i in (1, 2, 3)))


def _tag_target(tag: Column) -> Column:
    """What a canonical link or a refresh names, else null."""
    refresh = F.regexp_extract(_attribute(tag, "content"), r"(?is)^\s*[\d.]+\s*[;,]\s*url\s*=\s*['\"]?\s*([^'\"]*)", 1)
    return F.when(F.lower(_attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)"), _attribute(tag, "href")).when(
        F.lower(_attribute(tag, "http-equiv")) == "refresh", refresh
    )


def _absolute(url: Column, target: Column) -> Column:
    """A link's target as a full http or https URL, else null."""
    scheme = F.regexp_extract(url, r"^[^:/?#]+:", 0)
    base = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*(?:/[^?#]*/)?)", 1)
    return (
        F.when(target.rlike("(?i)^https?://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(base, target))
        .when((target != "") & ~target.rlike(r"^([#?]|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), target))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target) for each canonical link and each redirect (meta refresh) in the html.

    Relative targets are resolved against the url's scheme, host and folder;
    others than http and https, queries or fragments alone and empty targets
    give no row.
    """
    clean = lambda t: F.replace(F.trim(t), F.lit("&amp;"), F.lit("&"))
    targets = F.transform(
        F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0)),
        lambda tag: _let(clean(_tag_target(tag)), lambda t: _absolute(F.col("url"), t)),
    )
    return pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.explode(F.filter(targets, lambda t: t.isNotNull())).alias("target")).distinct()


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (address, host, path, rule, verdict): the longest fitting rule, else null.

    urls has distinct (address, host, path); rules has (rule_host, rule_path,
    rule_verdict), any number.  A url's host suffixes are joined with the rules'
    hosts, so no url meets a rule of another host; path prefixes are checked on
    what is left.  Of equally long rules allow wins, then the smaller text.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1))
    )
    fits = (
        urls.where("host != ''")
        .select("address", "host", "path", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .where(F.startswith("path", "rule_path"))
        .select(
            "address", "host", "path",
            F.struct(
                F.length(F.concat("rule_host", "rule_path")).alias("long"),
                (F.col("rule_verdict") == "allow").alias("allows"),
                F.concat("rule_host", "rule_path").alias("rule"),
            ).alias("fit"),
        )
    )
    none = urls.select("address", "host", "path", F.lit(None).cast("struct<long:int,allows:boolean,rule:string>").alias("fit"))
    best = none.unionByName(fits).groupBy("address", "host", "path").agg(F.max("fit").alias("fit"))
    verdict = F.when(F.col("fit.allows"), "allow").when(~F.col("fit.allows"), "block")
    return best.select("address", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def url_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Each row of pages (page_id, url) with host, path, rule, verdict and alias_group.

    pages: (page_id, url, html); other columns are dropped.  A url with a
    fitting rule keeps the rule's verdict.  Any other url takes the verdict of
    its aliases, the connected component over canonical links and redirects,
    targets outside of pages included: allow if one is allowed by a rule, else
    block if one is blocked, else allow.  alias_group is the smallest address
    of the component (the own one without links; null without a host).
    Null urls and urls without host: empty host and path, allow.  Repeated rows
    are kept.  Empty tables give no rows.
    """
    rows = pages.select("page_id", "url", parsed(F.col("url")).alias("at")).select("page_id", "url", "at.*")
    links = alias_links(pages).select(parsed(F.col("url")).alias("a"), parsed(F.col("target")).alias("b"))
    links = checkpointed(links.where("a.address IS NOT NULL AND b.address IS NOT NULL"))
    groups = components(links.select(F.col("a.address").alias("u"), F.col("b.address").alias("v")))
    groups = groups.select(F.col("node").alias("address"), F.col("component").alias("alias_group"))
    known = rows.where("address IS NOT NULL").select("address", "host", "path").unionByName(links.select("b.address", "b.host", "b.path")).distinct()
    ruled = match_rules(known, rules)
    said = (
        ruled.where("verdict IS NOT NULL").join(groups, "address")
        .groupBy("alias_group").agg(F.max(F.col("verdict") == "allow").alias("group_allows"))
    )
    spread = groups.join(said, "alias_group").select("address", "alias_group", "group_allows")
    inherited = groups.join(spread.drop("alias_group"), "address", "left")
    verdict = F.coalesce("verdict", F.when(F.col("group_allows"), "allow").when(~F.col("group_allows"), "block"), F.lit("allow"))
    return (
        rows.join(ruled, ["address", "host", "path"], "left")
        .join(inherited, "address", "left")
        .select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("alias_group", "address").alias("alias_group"))
    )
