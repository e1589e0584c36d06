"""Small string helpers: prefixes, split numbers, safe paths, keys, and an HTML allow-list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    """Whether a text that is not empty starts with one of the prefixes."""
    found = F.lit(False)
    for p in prefixes:
        found = found | c.startswith(p)
    return F.coalesce((c != "") & found, F.lit(False))


def split_numbers(c: Column, separator: str = ",", kind: str = "long") -> Column:
    """The numbers of a separated list; blank parts are left out, and what is no number is an error."""
    parts = F.filter(F.transform(F.split(c, "\\Q" + separator + "\\E"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast(kind))


def safe_path(c: Column) -> Column:
    """Whether a relative path stays in its folder: no leading slash, backslash, NUL or drive letter, and no empty, . or .. part."""
    bad = c.isNull() | (c == "") | c.startswith("/") | c.contains("\\") | c.contains("\0") | c.rlike("^[A-Za-z]:")
    return ~bad & ~F.exists(F.split(F.coalesce(c, F.lit("")), "/"), lambda p: p.isin("", ".", ".."))


def resolved_key(method: Column, args: Column, *identity: Column) -> Column:
    """The key of a call: md5 of the method, its arguments and whoever calls (user, address or node; none: the call alone)."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.md5(F.concat(text(method), text(args), *[text(i) for i in identity]))


#: The tags that an allow-list cleaner keeps, the attributes of each, and the protocols of links.
TAGS = "a b blockquote br caption cite code col colgroup dd div dl dt em h1 h2 h3 h4 h5 h6 i img li ol p pre q small span strike strong sub sup table tbody td tfoot th thead tr u ul".split()
ATTRIBUTES = {"a": ["href", "title", "target"], "blockquote": ["cite"], "col": ["span", "width"], "colgroup": ["span", "width"], "img": ["align", "alt", "height", "src", "title", "width"], "ol": ["start", "type"], "q": ["cite"], "table": ["summary", "width"], "td": ["abbr", "axis", "colspan", "rowspan", "width"], "th": ["abbr", "axis", "colspan", "rowspan", "scope", "width"], "ul": ["type"]}
EVERYWHERE = ["style", "class"]
PROTOCOLS = {"href": ["ftp:", "http:", "https:", "mailto:"], "cite": ["http:", "https:"], "src": ["http:", "https:", "data:"]}


def clean_html(c: Column) -> Column:
    """HTML with the allowed tags and attributes alone; the text of other tags stays, that of scripts, styles and comments goes.

    A column expression over the tags as they stand: it opens or closes no tag by itself.
    """
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style|title|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<![^>]*>", "")
    pieces = F.regexp_extract_all(bare, F.lit(r"(?s)</?[A-Za-z][^>]*>|[^<]+|<"), F.lit(0))

    def attributes(tag: Column, name: Column) -> Column:
        found = F.regexp_extract_all(tag, F.lit(r"""(?s)[\w-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(0))

        def good(a: Column) -> Column:
            key, value = F.lower(F.regexp_extract(a, r"^[\w-]+", 0)), F.lower(F.regexp_replace(a, r"(?s)^[\w-]+\s*=\s*[\"']?\s*", ""))
            listed = key.isin(*EVERYWHERE)
            for t, keys in ATTRIBUTES.items():
                listed = listed | ((name == t) & key.isin(*keys))
            for k, starts in PROTOCOLS.items():
                listed = listed & ((key != k) | starts_with_any(value, starts))
            return listed

        return F.array_join(F.transform(F.filter(found, good), lambda a: F.concat(F.lit(" "), a)), "")

    def kept(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        opened = F.concat(F.lit("<"), name, attributes(x, name), F.lit(">"))
        return F.when(~x.startswith("<"), x).when(x == "<", "&lt;").when(~name.isin(*TAGS), "").when(x.startswith("</"), F.concat(F.lit("</"), name, F.lit(">"))).otherwise(opened)

    return F.array_join(F.transform(pieces, kept), "")


def common_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of df that a target has too, in the target's order."""
    return df.select(*[n for n in names if n in df.columns])


def profile(df: DataFrame, name: str) -> DataFrame:
    """table_name, column_name, position, n_rows, n_nulls of each column, in one pass."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    column = lambda i, c: F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col("_rows").alias("n_rows"), (F.col("_rows") - F.col(c)).alias("n_nulls"))
    return counts.select(F.explode(F.array(*[column(i, c) for i, c in enumerate(df.columns, 1)])).alias("c")).select("c.*")
