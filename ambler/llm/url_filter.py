"""URL rules whose block decisions spread over redirects and canonical links.

Nodes are urls: those of the pages, and those that a page's html names in a
canonical link or in a refresh redirect.  Equivalent urls are the connected
components of these edges, found by distributed rounds of DataFrame operations.
A url with a rule of its own follows it.  Any other is allowed if its component
holds an explicitly allowed url, else blocked if it holds a blocked one, else
allowed.

Links are resolved against the page's url: with a scheme as they stand, ``//host/p``
with the page's scheme, ``/p`` with its host, ``?q`` with its path, others with its
folder; ``.`` and ``..`` are taken out of resolved paths, and ``&amp;`` is decoded.

Edge cases: a url that is null or lacks ``://`` has an empty host and path, fits
no rule and is a component of its own if null, and relative links in its html lead
nowhere, as do empty ones, fragments and schemes without ``://``; a null html has no
links; repeated pages and urls share one node; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambler.llm.common import connected_components, table

#: (verdict, host, path): the production rules; a fixed, short list.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: (tags, what a tag must have, where its target stands)
_LINKS = (
    (r"(?is)<link\b[^>]*>", r"(?is)\brel\s*=\s*[\"']?canonical\b", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"),
    (r"(?is)<meta\b[^>]*>", r"(?is)http-equiv\s*=\s*[\"']?refresh\b", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"),
)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null."""
    fitting = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(
                F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")
            ),
        )
        for verdict, h, p in rules
    ]
    return F.greatest(*fitting) if len(fitting) > 1 else fitting[0]


def _targets(html: Column) -> Column:
    """What canonical links and refresh redirects name, character references decoded."""

    def named(tags: str, has: str, target: str) -> Column:
        found = F.filter(F.regexp_extract_all(html, F.lit(tags), F.lit(0)), lambda t: t.rlike(has))
        return F.transform(found, lambda t: F.regexp_replace(F.regexp_extract(t, target, 1), "(?i)&(amp|#38|#x26);", "&"))

    return F.array_distinct(F.concat(*[named(*kind) for kind in _LINKS]))


def _without_dots(path: Column) -> Column:
    """An absolute path without its segments ``.`` and ``..``."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    held = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    folder = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(held) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(held, "/"), folder)


def resolved(url: Column, to: Column) -> Column:
    """The url that a page's link ``to`` means; null if it leads nowhere."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    here = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    path = F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(here, r"(?s)^(.*/)", 1)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), to)
        .when(site == "", F.lit(None))
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(site, _without_dots(path), rest))
        .when(to.startswith("?"), F.concat(site, F.when(here == "", "/").otherwise(here), to))
        .when((to == "") | to.startswith("#"), F.lit(None))
        .otherwise(F.concat(site, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and one that it redirects to or names as canonical."""
    return (
        pages.where("url is not null and (html ilike '%canonical%' or html ilike '%refresh%')")
        .select(F.col("url").alias("a"), F.explode(_targets(F.col("html"))).alias("to"))
        .select("a", resolved(F.col("a"), F.col("to")).alias("b"))
        .where("contains(b, '://') and a <> b")
    )


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and url_class of every page."""
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("own", best_rule(F.col("host"), F.col("path"), rules))
    classes = connected_components(link_edges(pages.select("url", "html")))
    own = best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    by_class = (
        classes.withColumn("own", own)
        .groupBy("label")
        .agg(F.bool_or(F.col("own").eqNullSafe("allow")).alias("allows"), F.bool_or(F.col("own").eqNullSafe("block")).alias("blocks"))
    )
    spread = classes.join(by_class, "label").select(
        F.col("node").alias("url"), F.col("label").alias("url_class"), (F.col("blocks") & ~F.col("allows")).alias("spread")
    )
    return ruled.join(spread, "url", "left").select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(F.col("spread"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("url_class", "url").alias("url_class"),
    )


def op3_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page under the production rules."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
