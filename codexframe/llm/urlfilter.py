"""URL filtering with redirect equivalence, in DataFrame and SQL operations only.

Rules block or allow a host with its subdomains below a path. Pages that redirect to one another, or
name one canonical address, are aliases: connected components over those links. A block decision on
any address of a component reaches all its aliases without a rule of their own, unless an address of
the component is allowed explicitly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import materialize
from codexframe.llm.components import connected_components


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` (``allow`` or ``block``) for ``host``, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def parse_rule(verdict: str, text: str) -> UrlRule:
    """A rule from ``host/path``."""
    host, slash, path = text.partition("/")
    return UrlRule(verdict, host.lower(), slash + path)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """An address's identity among aliases: host, path and query, without scheme and fragment; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when((rest == "") | rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest))


def best_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits, as ``struct(size, host_size, rule, verdict)``, or null.

    Of two that are equally long the one with the longer host wins, then the smaller text. The rules are
    a configured list and become part of the expression.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    fits = [
        F.when(
            ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path) & (host != ""),
            F.struct(
                F.lit(-len(r.name)).alias("size"), F.lit(-len(r.host)).alias("host_size"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")
            ),
        )
        for r in rules
    ]
    return F.array_min(F.array_compact(F.array(*fits)))


#: A whole tag, and the value of one of its attributes: quoted in either way, or bare.
_TAG = r"""(?is)<{0}\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_VALUE = r"""(?is)(?<![\w-]){0}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Redirect and canonical-link edges ``src, dst`` (addresses) that pages declare in their HTML.

    Read are all ``<link>`` with ``canonical`` among the words of ``rel`` and all ``<meta http-equiv=refresh>``
    of each page, but for comments. A relative target is completed from the page's own address. Rows of
    null address or HTML have no edge.
    """
    base = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    base = base.where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|http-equiv"))
    shown = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    tags = lambda name: F.regexp_extract_all(shown, F.lit(_TAG.replace("{0}", name)), F.lit(0))
    value = lambda tag, name: F.trim(F.concat(*[F.regexp_extract(tag, _VALUE.replace("{0}", name), i) for i in (1, 2, 3)]))
    links = F.filter(tags("link"), lambda x: value(x, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"))
    metas = F.filter(tags("meta"), lambda x: F.lower(value(x, "http-equiv")) == "refresh")
    target = lambda x: F.trim(F.regexp_extract(value(x, "content"), r"""(?is)url\s*=\s*['"]?([^'"]*)""", 1))
    every = F.concat(F.transform(links, lambda x: value(x, "href")), F.transform(metas, target))
    found = base.select("url", F.explode(F.array_distinct(every)).alias("to")).where("to != ''")
    found = found.withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    scheme, site = F.regexp_extract("url", r"(?s)^(.*?)://", 1), F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    dst = (
        F.when(F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(site, F.col("to")))
        .when(F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(folder, F.col("to")))
    )
    return found.select(F.col("url").alias("src"), dst.alias("dst")).where("dst is not null")


def judge(
    pages: DataFrame,
    rules: list[UrlRule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """Verdict on every row: ``id, host, path, rule, verdict, propagated``.

    The longest fitting rule decides. Without one, a page is blocked (``propagated``) if its component
    holds an address that a rule blocks and none that a rule allows, else allowed. Links come from the
    HTML (``html_col``; none: not read) and from ``redirects`` (``src, dst`` addresses). A null address or
    one without ``://`` has empty host and path, no rule and no alias, and is allowed; null HTML names no link. Repeated rows are
    judged each; other columns are ignored. Only pages' addresses are shuffled, never their HTML.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    parts = own.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    ruled = parts.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    edges = link_edges(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        given = redirects.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
        edges = given if edges is None else edges.unionByName(given)
    if edges is None:
        blocked = None
    else:
        labels = connected_components(edges.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")))
        host, path = F.expr("substring(node, 1, instr(node, '/') - 1)"), F.expr("split_part(substring(node, instr(node, '/')), '?', 1)")
        spread = labels.withColumn("best", best_rule(host, path, rules))
        verdicts = spread.groupBy("label").agg(
            F.max(F.expr("best.verdict = 'block'")).alias("block"), F.max(F.expr("best.verdict = 'allow'")).alias("allow")
        )
        bad = verdicts.where("block and not coalesce(allow, false)").select("label")
        blocked = materialize(labels.join(bad, "label", "left_semi").select("node", F.lit(True).alias("alias")), "blocked")
    if blocked is None:
        met = ruled.withColumn("alias", F.lit(None).cast("boolean"))
    else:
        # an address without a node is alone; any text without a slash is no node
        alone = F.concat(F.lit("none "), F.pmod(F.xxhash64("id"), F.lit(4096)).cast("string"))
        met = ruled.withColumn("node", F.coalesce("node", alone)).join(blocked, "node", "left")
    propagated = F.col("best").isNull() & F.coalesce("alias", F.lit(False))
    verdict = F.coalesce(F.col("best.verdict"), F.when(propagated, F.lit("block")).otherwise(F.lit("allow")))
    return met.select("id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), propagated.alias("propagated"))
