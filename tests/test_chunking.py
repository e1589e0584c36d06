"""Chunk strategies on literal documents."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunking as c


def chunks(spark, elements, key, p=c.Params()):
    df = spark.createDataFrame([(1, elements)], f"id int, e array<{c.ELEMENT}>")
    rows = c.split(df, F.col("e"), F.lit(key).cast("string"), p).orderBy("pos").collect()
    return [(r.content, r.chunk_type, r.parent_pos) for r in rows]


def el(kind, text=None, level=None, header=None, rows=None):
    return (kind, level, text, header, rows)


DOC = [el("heading", "第一章 总则", 1), el("paragraph", "本制度适用于全体员工。"), el("heading", "1.1 报销标准", 2), el("paragraph", "差旅费按标准报销。")]
LONG = "".join(f"这是第{i}个句子内容比较长一些。" for i in range(30))


def test_structure_leads_with_headings(spark):
    got = [x[0] for x in chunks(spark, DOC, "structure")]
    assert len(got) == 2 and got[0].startswith("[第一章 总则] ") and got[1].startswith("[第一章 总则 > 1.1 报销标准] ")


def test_long_section_is_folded(spark):
    got = [x[0] for x in chunks(spark, [el("heading", "条款", 1), el("paragraph", LONG)], "structure", c.Params(100))]
    assert len(got) > 1
    assert all(x.startswith("[条款] ") and -(-len(x) // 1.5) <= 120 for x in got)
    assert "".join(x.removeprefix("[条款] ") for x in got) == LONG


def test_heading_pops_deeper_ones(spark):
    doc = [el("heading", "A", 1), el("heading", "B", 3), el("paragraph", "x"), el("heading", "C", 2), el("paragraph", "y"), el("heading", "D", 1), el("paragraph", "z")]
    assert [x[0] for x in chunks(spark, doc, "structure")] == ["[A > B] x", "[A > C] y", "[D] z"]


def test_semantic(spark):
    assert len(chunks(spark, [el("paragraph", "一段。"), el("paragraph", "二段。")], "semantic")) == 2


def test_parent_child(spark):
    got = chunks(spark, [el("paragraph", LONG)], "parent-child", c.Params(100))
    assert got[0][1] == "PARENT" and got[0][2] is None and len(got) > 2
    assert {x[2] for x in got[1:]} == {0} and "".join(x[0] for x in got[1:]) == LONG


def test_table_packs_rows(spark):
    got = chunks(spark, [el("table", header=["品名", "价格"], rows=[["笔", "1"], ["纸", "2"]])], "table")
    assert [x[0] for x in got] == ["表头: 品名 | 价格 | 行: 笔 | 1\n表头: 品名 | 价格 | 行: 纸 | 2"]
    assert len(chunks(spark, [el("table", header=["品名", "价格"], rows=[["笔", "1"], ["纸", "2"]])], "table", c.Params(20))) == 2


@pytest.mark.parametrize("key", ["auto", "not-exist", "", None])
def test_auto_and_unknown(spark, key):
    assert chunks(spark, DOC, key) == chunks(spark, DOC, "structure")


def test_registry():
    assert c.is_valid("structure") and c.is_valid("auto") and not c.is_valid("not-exist") and len(c.STRATEGIES) == 6


def test_params(spark):
    rows = [('{"maxTokens":800,"overlap":1,"titleChain":false}',), ("{oops",), (None,), ('{"maxTokens":-1,"overlap":-2}',)]
    got = spark.createDataFrame(rows, "j string").select(c.merge_params(F.col("j")).alias("p")).select("p.*").collect()
    assert [tuple(x) for x in got] == [(800, 1, False)] + [(500, 0, True)] * 3


def test_policy_and_faq(spark):
    got = [x[0] for x in chunks(spark, [el("paragraph", "前言。\n第一条 内容一。\n第二条 内容二。")], "policy")]
    assert got == ["前言。", "第一条 内容一。", "第二条 内容二。"]
    got = [x[0] for x in chunks(spark, [el("paragraph", "问:甲?\n答:乙。\n问:丙?\n答:丁。")], "faq")]
    assert got == ["问:甲?\n答:乙。", "问:丙?\n答:丁。"]
    assert chunks(spark, [el("paragraph", "无问答。")], "faq")[0][1] == "SEMANTIC"


def test_overlap_uses_the_block_as_it_was(spark):
    got = [x[0] for x in chunks(spark, [el("paragraph", "a。b。"), el("paragraph", "c。"), el("paragraph", "d。")], "semantic", c.Params(500, 1))]
    assert got == ["a。b。", "b。c。", "c。d。"]


def test_long_sentence_stays_whole(spark):
    assert [x[0] for x in chunks(spark, [el("paragraph", "x" * 900)], "semantic", c.Params(10))] == ["x" * 900]


def test_markdown(spark):
    text = "# Title\nline one\n line two \n\n## Sub\n\npara\n#nohead"
    got = spark.createDataFrame([(text,)], "t string").select(c.parse_markdown(F.col("t")).alias("e")).first().e
    assert [(x.kind, x.level, x.text) for x in got] == [("heading", 1, "Title"), ("paragraph", None, "line one\nline two"), ("heading", 2, "Sub"), ("paragraph", None, "para\n#nohead")]
