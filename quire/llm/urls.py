"""URL filters whose block decisions follow redirects and canonical links. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, in lower case (A-Z); empty without ://."""
    return lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _without_dots(url: Column) -> Column:
    """The url with the segments . and .. of its path worked out."""
    whole = r"(?s)^(.*?://[^/?#]*/)([^?#]*)(.*)$"
    each = F.split(F.regexp_extract(url, whole, 2), "/")
    kept = F.aggregate(each, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.array_append(done, x)))
    end = F.when(F.element_at(each, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(url.rlike(r"(?s)^.*?://[^/?#]*/(?:[^?#]*/)?\.\.?(?:[/?#]|$)"), F.concat(F.regexp_extract(url, whole, 1), F.array_join(kept, "/"), end, F.regexp_extract(url, whole, 3))).otherwise(url)


def resolved(page: Column, to: Column) -> Column:
    """The absolute url that a link on a page leads to; null for an empty link, a scheme without ://, and a relative path on a page without ://."""
    part = lambda k: F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)([^?#]*)(\?[^#]*)?", k)
    folder = F.regexp_replace(part(2), r"[^/]*$", "")
    full = (
        F.when(to.startswith("//"), F.concat(F.regexp_extract(page, r"(?s)^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat(part(1), to))
        .when(~page.contains("://"), None)
        .when(to.startswith("?"), F.concat(part(1), part(2), to))
        .when(to.startswith("#"), F.concat(part(1), part(2), part(3), to))
        .otherwise(F.concat(part(1), F.when(folder == "", "/").otherwise(folder), to))
    )
    return F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(to.contains("://"), to)).when(to.rlike(r"^[?#]"), full).when(to != "", _without_dots(full))


def normal(url: Column) -> Column:
    """The url by which aliases are told: scheme and host in lower case (A-Z), without its fragment."""
    start = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    return F.concat(lower(start), F.regexp_replace(F.substr(url, F.length(start) + 1), r"(?s)#.*$", ""))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) that pages state, of urls as ``normal`` has them: canonical links and refreshes, after whatever delay, to another url.

    Canonical may stand among other words of rel. What stands in an HTML comment
    is none. Attributes may stand in any order and with either quote or none. Relative
    targets are resolved against the page's url (``resolved``); base elements
    aren't read. Entities in targets: &amp; only.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    tags = F.regexp_extract_all(F.regexp_replace(page, r"(?s)<!--.*?(?:-->|$)", " "), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    tag = F.col("tag")
    found = pages.where(F.col(url).isNotNull() & page.rlike(r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)")).select(F.col(url).alias("a"), F.explode(tags).alias("tag"))
    canonical = F.when(tag.rlike(r"""(?is)^<link\b.*\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?:[\s/>]|$))"""), F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1))
    refresh = F.when(tag.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""), F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?\s*([^"'\s>]+)""", 1))
    to = F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&"))
    return found.select(normal(F.col("a")).alias("a"), normal(resolved(F.col("a"), to)).alias("b")).where("b is not null and a <> b")


#: Rules up to this number are part of the expression; more are joined by host.
INLINE = 256


def _fitting(rules: Column, h: Column, p: Column) -> Column:
    """The longest rule that fits, of an array of structs (host, path, verdict); null if none."""
    fit = F.filter(rules, lambda r: ((h == r["host"]) | h.endswith(F.concat(F.lit("."), r["host"]))) & p.startswith(r["path"]))
    ranked = F.transform(fit, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("m"), r["host"].alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict")))
    return F.array_max(ranked)


def rule_for(df: DataFrame, rules: list[tuple[str, str, str]], host_col: str = "host", path_col: str = "path") -> DataFrame:
    """Adds _rule, a struct (host, path, verdict) of the longest fitting rule, null where none fits.

    rules: (verdict, host, path prefix). A rule fits its host and all
    subdomains, if the path starts with the rule's. Longest is host and path
    together, then host. Of two rules with the same host and path, allow holds.
    """
    best: dict[tuple[str, str], str] = {}
    for verdict, h, p in rules:
        if best.get((h, p)) != "allow":
            best[h, p] = verdict
    kind = "host string, path string, verdict string"
    if len(best) <= INLINE:
        each = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for (h, p), v in best.items()]
        table = F.array(*each) if each else F.array().cast(f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
        return df.withColumn("_rule", _fitting(table, F.col(host_col), F.col(path_col)))
    # The rules of each distinct host, found by equality with its suffixes; hosts are few against rows.
    rows = df.sparkSession.createDataFrame([(h, p, v) for (h, p), v in best.items()], kind)
    parts = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = df.select(F.col(host_col).alias("h")).distinct()
    mine = hosts.select("h", F.explode(suffixes).alias("host")).join(rows, "host").groupBy("h").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("_rules"))
    joined = df.join(mine.withColumnRenamed("h", "_h"), F.col(host_col) == F.col("_h"), "left")
    return joined.withColumn("_rule", _fitting(F.col("_rules"), F.col(host_col), F.col(path_col))).drop("_h", "_rules")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], scratch: Scratch, url: str = "url", html: str | None = "html", redirects: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Verdict on each page's url: keep, host, path, rule, verdict, component.

    A url's own rule decides, if one fits. Else the url is blocked when any url
    that it is equivalent to is blocked by a rule: equivalent are urls in one
    connected component of redirects (columns a, b) and of the links that pages
    state (``links``; html None: none). Allow rules give no verdict to aliases,
    but an explicit allow stands against any block that comes by an alias. All
    else is allowed. component: the smallest url of the component; null for
    urls with no edge. Component members need not be pages.

    Null urls and urls without :// have an empty host and path and fit no rule;
    repeated urls and ids are separate rows with equal verdicts; an empty table
    gives none; other columns are not read.
    """
    rows = pages.select(*keep, normal(F.col(url)).alias("_url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    edges = None
    if html is not None:
        edges = links(pages, url, html)
    if redirects is not None:
        more = redirects.select(normal(F.col("a")).alias("a"), normal(F.col("b")).alias("b")).where("a is not null and b is not null and a <> b")
        edges = more if edges is None else edges.unionByName(more)
    judged = rule_for(rows, rules)
    rule = F.concat(F.col("_rule.host"), F.col("_rule.path"))
    if edges is None:
        alias = F.lit(None).cast("string")
        return judged.select(*keep, "host", "path", rule.alias("rule"), F.coalesce("_rule.verdict", F.lit("allow")).alias("verdict"), alias.alias("component"))
    label = components(edges, scratch)
    members = rule_for(label.select("node", "component", host(F.col("node")).alias("host"), path(F.col("node")).alias("path")), rules)
    blocked = members.groupBy("component").agg(F.bool_or(F.coalesce(F.col("_rule.verdict") == "block", F.lit(False))).alias("_blocked"))
    known = label.join(blocked, "component").select(F.col("node").alias("_url"), "component", "_blocked")
    out = judged.join(known, "_url", "left")
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return out.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "component")
