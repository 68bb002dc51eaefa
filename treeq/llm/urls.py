"""URL filter: host and path rules, and redirect equivalence for what no rule fits.

Addresses that lead to each other are aliases. The edges are redirects: the steps that servers commonly take from an address
(https for http, no fragment, tracking parameters, www. or m., default port, trailing slash, index page or .html), and canonical links and
meta refreshes of a page to their target, which takes the same steps. Over all these edges connected components are found, and a
component's verdict holds for those of its pages that no rule fits: allow if a rule allows one of its pages,
else block if a rule blocks one, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from .common import cut, free
from .components import components

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a browser doesn't read as markup: comments and the contents of some elements.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<textarea\b.*?(?:</textarea\s*>|\z)"
#: A link whose rel is canonical, or has it among others.
CANONICAL = (
    r"""(?i)<link\s(?:[^>]*\s)?rel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"[^>]*|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'[^>]*|canonical(?:[\s/][^>]*)?)>"""
)
REFRESH = r"""(?i)<meta\s(?:[^>]*\s)?http-equiv\s*=\s*["']?refresh["']?[^>]*>"""
HREF = r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)"""
TO = r"""(?i)url\s*=\s*["']?([^"'\s>]+)"""
TRACKING = r"(?s)\A(utm_[^=]*|ref|fbclid|gclid)(=.*)?\z"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _parts(url: Column) -> tuple[Column, Column]:
    """What stands before the first ?, and the rest from there."""
    return F.substring_index(url, "?", 1), F.regexp_extract(url, r"(?s)\A[^?]*(\?.*)", 1)


def _ends(url: Column) -> Column:
    """The address without its fragment and without tracking parameters."""
    base, query = _parts(F.regexp_replace(url, r"(?s)#.*", ""))
    kept = F.array_join(F.filter(F.split(F.substring(query, F.lit(2), F.length(query)), "&"), lambda x: ~x.rlike(TRACKING)), "&")
    return let(base, kept, then=lambda base, kept: F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept)))


def _server(url: Column) -> Column:
    """The address over https, of the host without default port, www. or m., in small letters."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"\A(www|m)\.", "")
    return F.concat(F.lit("https://"), host, F.regexp_replace(url, r"(?s)\A.*?://[^/?#]*", ""))


def _page(url: Column) -> Column:
    """The address, as `_server` leaves it, without trailing slashes, index page and .html."""
    base, query = _parts(url)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(base, r"(?s)\Ahttps://[^/]*(.*)", 1), r"/+$", ""), r"(?i)(/index)?\.html?$", "")
    return F.concat(F.regexp_extract(base, r"\A(https://[^/]*)", 1), path, query)


def redirects(url: Column) -> Column:
    """The four addresses that a request is led through, from the address itself to its last form; null without ://."""
    way = let(_ends(url), then=lambda a: let(_server(a), then=lambda b: F.array(url, a, b, _page(b))))
    return F.when(F.instr(url, "://") > 0, way)


def _joined(folder: Column, link: Column) -> Column:
    """A folder's path with a link from it, . and .. resolved; what follows ? or # of the link stays as it is."""
    path, rest = F.regexp_extract(link, r"(?s)\A([^?#]*)", 1), F.regexp_extract(link, r"(?s)\A[^?#]*(.*)", 1)
    parts = F.split(F.concat(folder, path), "/")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    open_ = F.when(path.rlike(r"(\A|/)\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), open_, rest)


def resolve(url: Column, link: Column) -> Column:
    """A link, as it stands in the page's HTML, as a full address; null if the page has no address to start from."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme, host = F.regexp_extract(url, r"(?s)\A(.*?)://", 1), F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.when(path_of(url) == "", "/").otherwise(path_of(url)), r"[^/]*$", "")
    return (
        F.when((link == "") | link.isNull(), None)
        .when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(host == "", None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(host, _joined(F.lit(""), link)))
        .when(link.startswith("?"), F.concat(host, path_of(url), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(url, r"(?s)#.*", ""), link))
        .otherwise(F.concat(host, _joined(folder, link)))
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does; of equal length, the first given."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        name, verdict = F.when(fits(h, p), h + p).otherwise(name), F.when(fits(h, p), v).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages without html, with host, path, rule and verdict, and `alias` (the last form of the address).

    A null address, or one without ://, has empty host and path, no aliases, and the verdict allow; a null html has no links, and
    of a text of any length the first canonical link and the first refresh count that are not in comments, scripts, styles or text areas. Repeated rows are judged alike; nulls in other columns and an empty table
    are fine; columns of the five names are replaced, columns of any other name stay.
    """
    url, html = F.col("url"), F.coalesce("html", F.lit(""))
    named = lambda word: F.contains(F.lower(html), F.lit(word))
    seen = F.regexp_replace(html, HIDDEN, "")
    way, link, jump, said = (free(pages, x) for x in ("way_", "link_", "jump_", "said_"))
    rows = pages.withColumns({
        "host": host_of(url), "path": path_of(url), way: redirects(url),
        link: F.when(named("canonical"), F.regexp_extract(F.regexp_extract(seen, CANONICAL, 0), HREF, 1)),
        jump: F.when(named("refresh"), F.regexp_extract(F.regexp_extract(seen, REFRESH, 0), TO, 1)),
    }).drop("html")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = cut(rows.withColumns({"rule": name, "verdict": verdict, "alias": F.get(way, F.lit(3))}))
    to = rows.where(f"`{link}` <> '' or `{jump}` <> ''").select("url", F.explode(F.array(link, jump)).alias("to"))
    to = cut(to.select("url", resolve(F.col("url"), F.col("to")).alias("to")).where("to is not null"))
    ways = rows.select(F.col(way).alias("way")).unionByName(to.select(redirects(F.col("to")).alias("way"))).where("way is not null")
    steps = ways.select(F.explode(F.arrays_zip(F.slice("way", 1, 3), F.slice("way", 2, 3))).alias("e"))
    edges = steps.select(F.col("e.0").alias("url"), F.col("e.1").alias("to")).unionByName(to.where("url is not null"))
    groups = cut(components(edges.where("url <> to"), "url", "to"))
    known = rows.where("url is not null and verdict is not null").groupBy("url").agg(F.min("verdict").alias("verdict"))
    known = known.join(groups.withColumnRenamed("node", "url"), "url", "left").select(F.coalesce("component", "url").alias("component"), "verdict")
    known = known.groupBy("component").agg(F.min("verdict").alias(said))  # allow comes before block
    names = rows.where("verdict is null and url is not null").select("url").distinct().join(groups.withColumnRenamed("node", "url"), "url", "left")
    names = names.withColumn("component", F.coalesce("component", "url")).join(known, "component").select("url", said)
    out = rows.join(names, "url", "left").withColumn("verdict", F.coalesce("verdict", said, F.lit("allow")))
    return out.drop(said, link, jump, way)
