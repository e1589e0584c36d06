"""Documents to chunks: parsers, strategies and their registry.

A document is an array of elements, struct<kind, level, text, header, rows>; a strategy maps it to
an array of chunks, struct<content, chunk_type, parent_pos>.  All are column expressions: a document
is one row, so its order needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import estimate_tokens, overlapped, pack, paragraphs, sentences, trim

ELEMENT = "struct<kind: string, level: int, text: string, header: array<string>, rows: array<array<string>>>"
CHUNK = "struct<content: string, chunk_type: string, parent_pos: int>"


@dataclass(frozen=True)
class Params:
    """max_tokens > 0, overlap >= 0 sentences; title_chain puts the headings before a chunk."""

    max_tokens: int = 500
    overlap: int = 0
    title_chain: bool = True
    extra: dict = field(default_factory=dict)


def merge_params(c: Column, default: Params = Params()) -> Column:
    """struct<max_tokens, overlap, title_chain>: the JSON's fields where they are present and valid."""
    j = F.from_json(c, "maxTokens INT, overlap INT, titleChain BOOLEAN")
    return F.struct(
        F.when(j["maxTokens"] > 0, j["maxTokens"]).otherwise(default.max_tokens).alias("max_tokens"),
        F.when(j["overlap"] >= 0, j["overlap"]).otherwise(default.overlap).alias("overlap"),
        F.coalesce(j["titleChain"], F.lit(default.title_chain)).alias("title_chain"),
    )


def element(kind: str, text: Column, level: Column | None = None, header: Column | None = None, rows: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if level is None else level).cast("int").alias("level"), text.cast("string").alias("text"), (F.lit(None) if header is None else header).cast("array<string>").alias("header"), (F.lit(None) if rows is None else rows).cast("array<array<string>>").alias("rows"))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def parse_plain(c: Column) -> Column:
    return F.transform(paragraphs(c), lambda p: element("paragraph", p))


def parse_markdown(c: Column) -> Column:
    """Headings (# to ######) and paragraphs: trimmed lines joined by line ends, closed by blank lines and headings."""
    start = F.struct(_none("string").alias("para"), _none(ELEMENT).alias("out"))

    def flushed(s: Column) -> Column:
        return F.when(F.size(s["para"]) > 0, F.concat(s["out"], F.array(element("paragraph", F.array_join(s["para"], "\n"))))).otherwise(s["out"])

    def step(s: Column, line: Column) -> Column:
        t = trim(line)
        heading = t.rlike(r"^#{1,6}\s+.+$")
        level, title = F.length(F.regexp_extract(t, r"^(#{1,6})\s", 1)), trim(F.regexp_extract(t, r"^#{1,6}\s+(.+)$", 1))
        out = F.when(heading, F.concat(flushed(s), F.array(element("heading", title, level)))).when(t == "", flushed(s)).otherwise(s["out"])
        para = F.when(heading | (t == ""), _none("string")).otherwise(F.concat(s["para"], F.array(t)))
        return F.struct(para.alias("para"), out.alias("out"))

    return F.aggregate(F.split(F.coalesce(c, F.lit("")), "\n"), start, step, flushed)


def parse_layout(c: Column) -> Column:
    """Elements of a layout parser's JSON, an array of {page_idx, md}; a line with an image is a placeholder paragraph."""
    pages = F.from_json(c, "array<struct<page_idx: int, md: string>>")
    text = F.regexp_replace(F.array_join(F.transform(pages, lambda p: p["md"]), "\n\n"), r"(?m)^.*!\[[^\]]*\]\([^)]*\).*$", "\n\n[image]\n\n")
    return parse_markdown(text)


def chunk(content: Column, kind: str, parent: Column | None = None) -> Column:
    return F.struct(content.alias("content"), F.lit(kind).alias("chunk_type"), (F.lit(None) if parent is None else parent).cast("int").alias("parent_pos"))


def sections(elements: Column) -> Column:
    """array<struct<titles array<string>, body string>>: text under each stack of headings, in order."""
    section = "struct<titles: array<string>, body: string>"
    start = F.struct(_none("struct<level: int, text: string>").alias("stack"), _none("string").alias("body"), _none(section).alias("out"))

    def flushed(s: Column) -> Column:
        new = F.struct(F.transform(s["stack"], lambda h: h["text"]).alias("titles"), F.array_join(s["body"], "\n").alias("body"))
        return F.when(F.size(s["body"]) > 0, F.concat(s["out"], F.array(new))).otherwise(s["out"])

    def step(s: Column, e: Column) -> Column:
        head = e["kind"] == "heading"
        stack = F.concat(F.filter(s["stack"], lambda h: h["level"] < e["level"]), F.array(F.struct(e["level"].alias("level"), e["text"].alias("text"))))
        text = as_text(e)
        return F.struct(
            F.when(head, stack).otherwise(s["stack"]).alias("stack"),
            F.when(head, _none("string")).when(text != "", F.concat(s["body"], F.array(text))).otherwise(s["body"]).alias("body"),
            F.when(head, flushed(s)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(elements, start, step, flushed)


def as_text(e: Column) -> Column:
    """An element as plain text; a table's cells are joined by bars, its rows by line ends."""
    line = lambda r: F.array_join(r, " | ", "")
    table = F.array_join(F.concat(F.array(line(e["header"])), F.transform(F.coalesce(e["rows"], _none("array<string>")), line)), "\n")
    return F.when(e["kind"] == "table", table).otherwise(F.coalesce(e["text"], F.lit("")))


def render(elements: Column) -> Column:
    return F.array_join(F.filter(F.transform(elements, as_text), lambda t: t != ""), "\n\n")


def structure(elements: Column, p: Params) -> Column:
    """A chunk per section, led by its headings; long sections are cut at sentences, each piece led alike.  The lead is not counted."""

    def split(s: Column) -> Column:
        lead = F.when(F.size(s["titles"]) > 0, F.concat(F.lit("["), F.array_join(s["titles"], " > "), F.lit("] "))).otherwise(F.lit("")) if p.title_chain else F.lit("")
        blocks = F.when(estimate_tokens(s["body"]) > p.max_tokens, overlapped(pack(sentences(s["body"]), F.lit(p.max_tokens)), p.overlap)).otherwise(F.array(s["body"]))
        return F.transform(blocks, lambda b: chunk(F.concat(lead, b), "STRUCTURE"))

    return F.flatten(F.transform(sections(elements), split))


def semantic(elements: Column, p: Params) -> Column:
    """Each element whole, or cut at sentences if it is too long."""
    texts = F.filter(F.transform(elements, as_text), lambda t: t != "")
    blocks = F.flatten(F.transform(texts, lambda t: F.when(estimate_tokens(t) > p.max_tokens, pack(sentences(t), F.lit(p.max_tokens))).otherwise(F.array(t))))
    return F.transform(overlapped(blocks, p.overlap), lambda b: chunk(b, "SEMANTIC"))


def parent_child(elements: Column, p: Params) -> Column:
    """Paragraphs are parents; a long one is followed by its sentence blocks, which name its place in the list."""
    parents = paragraphs(render(elements))
    start = _none(CHUNK)

    def step(out: Column, text: Column) -> Column:
        place = F.size(out)
        children = F.transform(pack(sentences(text), F.lit(p.max_tokens)), lambda b: chunk(b, "CHILD", place))
        return F.concat(out, F.array(chunk(text, "PARENT")), F.when(estimate_tokens(text) > p.max_tokens, children).otherwise(start))

    return F.aggregate(parents, start, step)


#: Fixed value: what begins a clause.
CLAUSE = r"(第[一二三四五六七八九十百千零〇\d]+条|(?m:^)\d+\.\d+|(?m:^)[一二三四五六七八九十]+、)"


def policy(elements: Column, p: Params) -> Column:
    """Cut before every clause mark; text before the first mark has no title."""
    pieces = F.split(F.regexp_replace(render(elements), CLAUSE, "\u0001$1\u0002"), "\u0001")

    def content(x: Column) -> Column:
        title, body = F.substring_index(x, "\u0002", 1), trim(F.substring_index(x, "\u0002", -1))
        return F.when(x.contains("\u0002"), trim(F.concat(title, F.lit(" "), body))).otherwise(trim(x))

    return F.transform(F.filter(F.transform(pieces, content), lambda c: c != ""), lambda c: chunk(c, "POLICY"))


#: Fixed value: a question and its answer.
_FAQ = r"(?s)(?:问|Q)\s*[:：]\s*(.+?)\s*(?:答|A)\s*[:：]\s*(.+?)(?=(?:问|Q)\s*[:：]|$)"


def faq(elements: Column, p: Params) -> Column:
    """Question and answer pairs; without any, as semantic."""
    text = render(elements)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(_FAQ), F.lit(1)).alias("q"), F.regexp_extract_all(text, F.lit(_FAQ), F.lit(2)).alias("a"))
    found = F.transform(pairs, lambda x: chunk(F.concat(F.lit("问:"), trim(x["q"]), F.lit("\n答:"), trim(x["a"])), "FAQ"))
    return F.when(F.size(found) > 0, found).otherwise(semantic(elements, p))


#: What leads a table's header and its rows.
HEADER_LEAD, ROW_LEAD = "表头: ", " | 行: "


def table(elements: Column, p: Params) -> Column:
    """Rows as "表头: ... | 行: ..." lines, packed; other text is packed by lines; without a table all lines are."""

    def lines(e: Column) -> Column:
        head = F.concat(F.lit(HEADER_LEAD), F.array_join(e["header"], " | ", ""), F.lit(ROW_LEAD))
        rows = F.transform(F.coalesce(e["rows"], _none("array<string>")), lambda r: F.concat(head, F.array_join(r, " | ", "")))
        other = F.filter(F.transform(F.split(as_text(e), "\n"), trim), lambda x: x != "")
        return F.when(e["kind"] == "table", rows).otherwise(other)

    body = F.filter(elements, lambda e: e["kind"] != "heading")
    return F.transform(F.flatten(F.transform(body, lambda e: pack(lines(e), F.lit(p.max_tokens), "\n"))), lambda c: chunk(c, "TABLE"))


STRATEGIES: dict[str, Callable[[Column, Params], Column]] = {"structure": structure, "semantic": semantic, "parent-child": parent_child, "policy": policy, "faq": faq, "table": table}


def register(key: str, strategy: Callable[[Column, Params], Column]) -> None:
    """Add a strategy, or replace one."""
    STRATEGIES[key] = strategy


def is_valid(key: str | None) -> bool:
    return key == "auto" or key in STRATEGIES


def auto_strategy(elements: Column) -> Column:
    """structure with any heading; table if more than two fifths are tables; policy if an early paragraph has a clause mark; else semantic."""
    n = F.size(elements)
    heading = F.exists(elements, lambda e: e["kind"] == "heading")
    tables = F.size(F.filter(elements, lambda e: e["kind"] == "table"))
    clause = F.exists(F.slice(elements, 1, 5), lambda e: (e["kind"] == "paragraph") & e["text"].rlike(r"第[一二三四五六七八九十百千零〇\d]+条|\d\.\d"))
    return F.when(heading, "structure").when((n > 0) & (tables / F.when(n > 0, n) > 0.4), "table").when(clause, "policy").otherwise("semantic")


def split(docs: DataFrame, elements: Column, key: Column, p: Params = Params()) -> DataFrame:
    """docs with pos and content, chunk_type, parent_pos of each chunk; blank and unknown strategies are chosen by auto_strategy."""
    named = F.when(key.isin(*STRATEGIES), key).otherwise(auto_strategy(elements))
    chosen = None
    for name, f in STRATEGIES.items():
        chosen = (F.when if chosen is None else chosen.when)(F.col("_strategy") == name, f(F.col("_elements"), p))
    rows = docs.withColumn("_elements", elements).withColumn("_strategy", named)
    return rows.select(*docs.columns, F.posexplode(chosen).alias("pos", "_c")).select(*docs.columns, "pos", "_c.*")
