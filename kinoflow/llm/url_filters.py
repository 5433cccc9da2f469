"""URL filters: rules by host and path, and redirect equivalence that carries block decisions to aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoflow.llm.common import UPPER, hub_join, kept
from kinoflow.llm.components import connected_components

RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Query parameters that only say where a visitor came from.
TRACKING = r"utm_[^&=]*|ref|fbclid|gclid"


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, lower-cased; path: from there to ``?``, ``#``
    or the end. Both are empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    empty = F.lit("")
    return (
        F.coalesce(_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), empty),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), empty),
    )


def first_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict); both null where none does. Of equally long ones an allow wins."""
    name = verdict = F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def address(url: str) -> Column:
    """The plain form to which servers redirect an address: no scheme, default port, fragment, tracking
    parameters or closing slash. ``url`` names a column."""
    c = F.regexp_replace(F.col(url), r"#.*$", "")
    c = F.regexp_replace(c, rf"(?<=[?&])(?:{TRACKING})(?:=[^&]*)?(?:&|$)", "")
    c = F.regexp_replace(c, r"[?&]$", "")
    rest = F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = _lower(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r":(?:80|443)$", ""))
    tail = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    return F.concat(host, F.regexp_replace(tail, r"/+(?=$|\?)", ""))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target): all canonical links and refresh redirects that pages declare outside comments, as absolute urls."""

    def targets(has: str, tag: str, value: str) -> Column:
        html = F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", " ")
        found = F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, value, 1))
        return F.when(F.regexp_like(F.col("html"), F.lit(has)), found).otherwise(F.array().cast("array<string>"))

    links = (
        pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
        .where(F.col("url").isNotNull() & F.col("html").isNotNull())
        .select(
            "url",
            F.explode(
                F.concat(
                    targets(
                        "(?i)canonical",
                        r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>",
                        r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)",
                    ),
                    targets(
                        "(?i)refresh",
                        r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>",
                        r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)",
                    ),
                )
            ).alias("to"),
        )
        .where("to != ''")
    )
    scheme = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract("url", r"^[^:]*://[^/?#]*", 0)
    folder = F.regexp_extract("url", r"^[^:]*://[^/?#]*(?:[^?#]*/)?", 0)
    to = F.col("to")
    return links.select(
        "url",
        F.when(F.regexp_like(to, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(site, to))
        .otherwise(F.concat(F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder), to))
        .alias("target"),
    )


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """A verdict for every row: (page_id, host, path, rule, verdict, component).

    A page that a rule fits gets that rule's verdict. Any other page takes over the decision of its aliases, the pages
    of its connected component. Edges are redirects: from every address to its plain form, as servers redirect to it
    (without scheme, default port, fragment, tracking parameters and closing slash), from a page to its canonical and
    refresh targets (read from its HTML), and ``redirects``: url, target. If any alias is explicitly allowed the page is
    allowed; else if any is blocked it is blocked; pages without a decided alias are allowed.

    Null urls, and those without ``://``: host and path are empty, and without a rule the verdict is allow; a null url
    has no aliases and no component. Repeated rows each get the verdict. Empty table: no rows. Other columns don't
    matter. Rules are a short list by contract; they become one expression. Components come from distributed star
    contraction; the decisions by component are pre-aggregated before their shuffle and joined only to pages without a
    rule, dealt by :func:`hub_join` where one component holds many of them.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumns({"rule": rule, "ruled": verdict})

    edges = rows.where("url is not null").select(F.col("url").alias("a"), address("url").alias("b"))
    links = [page_links(pages, url_col, html_col)] if html_col else []
    links += [redirects.select("url", "target")] if redirects is not None else []
    for link in links:
        edges = edges.unionByName(link.select(address("url").alias("a"), address("target").alias("b")))
    named = connected_components(edges.distinct())
    per = rows.where("url is not null").groupBy(F.col("url").alias("of")).agg(F.count("*").alias("n"))
    named = per.join(named, F.col("of") == F.col("node")).select("of", "n", "component")
    rows = kept(hub_join(rows, named, "url", "of", "n", rows.count(), outer=True).drop("url"), "pages-named")
    decided = (
        rows.where("component is not null")
        .groupBy(F.col("component").alias("group"))
        .agg(F.min("ruled").alias("taken"), F.count_if(F.col("ruled").isNull()).alias("free"))  # allow sorts before block
        .where("taken is not null and free > 0")
    )
    out = ["page_id", "host", "path", "rule", "verdict", "component"]
    ruled, free = rows.where("ruled is not null"), rows.where("ruled is null")
    judged = hub_join(free, decided, "component", "group", "free", free.count(), outer=True)
    judged = judged.withColumn("verdict", F.coalesce("taken", F.lit("allow")))
    return ruled.withColumn("verdict", F.col("ruled")).select(out).unionByName(judged.select(out))
