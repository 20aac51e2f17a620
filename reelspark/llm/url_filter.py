"""URL filter with redirect equivalence.

Pages that redirect to each other or name one canonical address are aliases:
connected components over those edges, computed in a distributed way.  A block
decision on one alias holds for the others, unless an allow rule names one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .runtime import Workspace


@dataclass(frozen=True)
class Rule:
    """``host`` with its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(c: Column, body) -> Column:
    """``body`` of ``c``, which stands in the plan once however often it is used."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _lower(c: Column) -> Column:
    return F.translate(c, _AZ, _AZ.lower())


def _rest(url: Column) -> Column:
    """What follows the first ``://``, empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


_DOTS = r"(^|/)\.\.?(/|$)"


def _without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` segments resolved."""
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda out, s: F.when(s == ".", out).when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(s))),
    )
    ended = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    return F.when(path.rlike(_DOTS), F.regexp_replace(ended, "//$", "/")).otherwise(path)


def _one_escape(c: Column) -> Column:
    """Percent codes of letters, digits and ``-._~`` as these characters, others in
    upper case; what is no code stays."""

    def one(p):
        code, rest = F.upper(F.substring(p, 1, 2)), F.substring(p, F.lit(3), F.length(p))
        plain = F.decode(F.unhex(code), "ISO-8859-1")
        known = _let(plain, lambda x: F.when(x.rlike("^[A-Za-z0-9._~-]$"), F.concat(x, rest)).otherwise(F.concat(F.lit("%"), code, rest)))
        return F.when(p.rlike("^[0-9A-Fa-f]{2}"), known).otherwise(F.concat(F.lit("%"), p))

    whole = lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))
    return _let(c, lambda x: F.when(x.contains("%"), _let(F.split(x, "%"), whole)).otherwise(x))


def address(url: Column) -> Column:
    """The one spelling of an address by which aliases are compared: scheme and
    host lower-cased (A-Z), no default port, no fragment, ``/`` for an empty
    path, one form of percent codes, no dot segments.  Without ``://`` only a
    fragment goes."""

    def spelled(bare):
        scheme = _lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
        default = {"http": r":(80)?$", "https": r":(443)?$"}
        host = _let(scheme, lambda s: F.concat(s, F.lit("://"), F.regexp_replace(host_of(bare), F.when(s == "http", default["http"]).when(s == "https", default["https"]).otherwise(":$"), F.lit(""))))
        path = _let(path_of(bare), lambda p: F.when(p == "", F.lit("/")).otherwise(_let(_one_escape(p), _without_dots)))
        query = _one_escape(F.regexp_extract(bare, r"(?s)^[^?]*(\?.*)$", 1))
        return F.when(bare.contains("://"), F.concat(host, path, query)).otherwise(bare)

    return _let(F.regexp_replace(url, "(?s)#.*$", ""), spelled)


def best_rule(host: Column, path: Column, rules: list[Rule], value: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits, else null; equal
    lengths go to the first listed."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def _resolve(url: Column, target: Column) -> Column:
    """Absolute form of an address found on the page ``url``, without fragment."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))
    return _let(
        F.regexp_replace(F.trim(target), "#.*$", ""),
        lambda t: F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(origin, t))
        .when(t.startswith("?"), F.concat(origin, path_of(url), t))
        .when(t != "", F.concat(origin, F.regexp_extract(path_of(url), r"^(.*/)?", 1), t)),
    )


#: What holds no links: comments, and elements whose content is text.
_TEXT = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\z)"
#: A tag to its end outside quotes, or, with very many or unbalanced quotes, to the next ``>``.
_TAG = r"""(?is)<(?:link|meta|base)[\s/](?:(?:[^>"']++|"[^"]*+"|'[^']*+'){0,200}+>|[^>]*+>)"""
_ATTRIBUTE = r"""(?is)([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# The named references that occur in addresses.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def unescape(c: Column) -> Column:
    """Character references as characters: numbers, and the names of ``_NAMED``;
    others stay."""

    def one(p):
        digits = F.regexp_extract(p, r"^#([xX][0-9A-Fa-f]{1,6}|[0-9]{1,7})(?![0-9A-Fa-f])", 1)
        code = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 6), 16, 10)).when(digits != "", digits).cast("bigint")
        rest = F.regexp_replace(p, r"^#[xX]?[0-9A-Fa-f]+;?", "")
        real = lambda n: (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        out = _let(code, lambda n: F.when(real(n), F.concat(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"), rest)))
        named = F.when(F.lit(False), p)
        for name, char in _NAMED.items():
            named = named.when(p.startswith(name + ";"), F.concat(F.lit(char), F.substring(p, len(name) + 2, 1 << 30)))
        return F.coalesce(out, named, F.concat(F.lit("&"), p))

    whole = lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))
    return _let(c, lambda x: F.when(x.contains("&"), _let(F.split(x, "&"), whole)).otherwise(x))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``src, dst``: canonical links and refresh redirects of ``pages(url, html)``,
    both ends as :func:`address` spells them.

    Comments and the text of scripts, styles, text areas and titles hold no links.
    Attributes are read with their quotes, the first of a name counts, and character
    references in them are resolved; relative targets go by the first ``<base href>``.
    Pages with a null url or html, targets that cannot be resolved and links of a
    page to itself give no edge; repeated links repeat; extra columns are ignored;
    an empty table gives no edges.
    """
    real = pages.where("html is not null and url is not null").select("url", "html").where(F.col("html").rlike("(?i)<(?:link|meta)[\\s/]"))
    clean = real.select("url", F.regexp_extract_all(F.regexp_replace("html", _TEXT, ""), F.lit(_TAG), F.lit(0)).alias("tags"))
    value = F.regexp_extract(F.col("_v"), r"""(?s)^["']?(.*?)["']?$""", 1)

    def read(df: DataFrame, tag: str, **wanted: str) -> DataFrame:
        """Columns of a tag's attributes, unescaped."""
        names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
        df = df.withColumns({"_names": names, "_values": F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2))})
        for column, name in wanted.items():
            df = df.withColumn("_v", F.get("_values", (F.array_position("_names", name) - 1).cast("int"))).withColumn(column, unescape(value))
        return df.drop("_names", "_values", "_v")

    first = F.get(F.filter("tags", lambda t: t.rlike("(?i)^<base") & t.rlike(r"(?is)[\s/\"']href\s*=")), F.lit(0))
    based = read(clean.withColumn("base", first), "base", base_href="href")
    based = based.withColumn("from", F.coalesce(_resolve(F.col("url"), F.col("base_href")), F.col("url")))
    tag = read(based.select("url", "from", F.explode("tags").alias("tag")), "tag", rel="rel", href="href", equiv="http-equiv", content="content")
    goes = F.regexp_extract("content", r"""(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1)
    to = F.when(F.col("rel").rlike(r"(?i)(^|\s)canonical(\s|$)") & F.col("tag").rlike(r"(?i)^<link"), F.col("href")).when(
        (F.lower(F.trim("equiv")) == "refresh") & F.col("tag").rlike(r"(?i)^<meta"), goes
    )
    found = tag.select("url", "from", to.alias("to")).where("`to` is not null")
    return (
        found.select("url", _resolve(F.col("from"), F.col("to")).alias("to"))
        .select(address(F.col("url")).alias("src"), address(F.col("to")).alias("dst"))
        .where("dst is not null and src <> dst")
    )


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, aliases`` for every row of
    ``pages(page_id, url, html)``.

    A page's own longest rule decides.  Without one the page takes part in its
    alias component (``redirects(src, dst)`` adds observed redirects to the
    links in the pages): allow if an allow rule fits any of its addresses, else
    block if a block rule does, else allow.  Addresses are compared as
    :func:`address` spells them.
    ``aliases`` is the component's number of addresses, 1 for none.

    A null url, or one without ``://``, has empty host and path, no rule and no
    alias.  Repeated rows repeat; null ids stay null; extra columns are ignored;
    an empty table gives an empty result.  Addresses are nodes by 64-bit hash;
    components are never gathered in one place.
    """
    work = Workspace(spark, "urls")
    edges = alias_edges(pages)
    if redirects is not None:
        clean = lambda c: address(F.col(c).cast("string")).alias(c)
        edges = edges.unionByName(redirects.where("src is not null and dst is not null").select(clean("src"), clean("dst")))
    edges = work.table(edges.distinct())
    url = F.col("url").cast("string")
    out = pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"),
        F.xxhash64(address(url)).alias("node"), url.contains("://").alias("real"),
    )
    own = lambda v: best_rule(F.col("host"), F.col("path"), rules, v)
    out = out.select("*", own("text").alias("rule"), own("verdict").alias("own"))
    if edges.isEmpty():
        joined = out.select("*", F.lit(None).cast("string").alias("given"), F.lit(1).cast("bigint").alias("aliases"))
    else:
        found = work.table(components(edges.select(F.xxhash64("src").alias("u"), F.xxhash64("dst").alias("v")), work))
        ends = edges.select(F.col("src").alias("a")).unionByName(edges.select(F.col("dst").alias("a"))).distinct()
        named = ends.select(F.xxhash64("a").alias("node"), best_rule(host_of(F.col("a")), path_of(F.col("a")), rules, "verdict").alias("v"))
        decided = (
            found.join(named, "node")
            .groupBy("component")
            .agg(F.max(F.col("v") == "allow").alias("allow"), F.max(F.col("v") == "block").alias("block"), F.count("*").alias("aliases"))
        )
        given = found.join(decided, "component").select("node", F.expr("case when allow then 'allow' when block then 'block' end").alias("given"), "aliases")
        joined = out.join(given, (out.node == given.node) & out.real, "left").drop(given.node)
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("own", "given", F.lit("allow")).alias("verdict"), F.coalesce("aliases", F.lit(1).cast("bigint")).alias("aliases")
    )
