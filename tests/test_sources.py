import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import asking
from tallgrass.sources import office


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = "xmlns:w='w'"
DOCX = packed(**{"word/document.xml": f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Setup</w:t></w:r></w:p>
<w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val='1'/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>
</w:body></w:document>"""})
XLSX = packed(**{
    "xl/workbook.xml": "<w/>",
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
    "xl/worksheets/sheet1.xml": "<s><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>5</v></c></row><row/></sheetData></s>",
})
PPTX = packed(**{"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": "<s><sp><nvPr><ph type='title'/></nvPr><p><r><t>Hello</t></r></p></sp><sp><p><pPr lvl='1'/><r><t>point</t></r></p></sp></s>"})


def test_office_blocks(spark):
    rows = [("x/a.docx", DOCX), ("b.XLSX", XLSX), ("c.pptx", PPTX), ("d.docx", b"junk"), ("e.docx", None), ("f.txt", b""), ("g.docx", packed(other="x"))]
    got = office.blocks_of(spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")).orderBy("path", "pos").collect()
    by = lambda p: [(r.kind, r.level, r.text) for r in got if r.path == p]
    assert by("x/a.docx") == [("heading", 2, "Setup"), ("paragraph", 0, "one two"), ("list", 1, "item"), ("table", 0, "a | b")]
    assert by("b.XLSX") == [("table", 0, "name |  | 5")]
    assert by("c.pptx") == [("heading", 1, "Hello"), ("paragraph", 1, "point")]
    assert [by(p)[0][0] for p in ("d.docx", "e.docx", "f.txt", "g.docx")] == ["error"] * 4


def test_charts_and_diagrams():
    xml = "<c><plotArea><barChart><ser><tx><v>S</v></tx><cat><pt idx='0'><v>q1</v></pt><pt idx='1'><v>q2</v></pt></cat><val><pt idx='1'><v>3</v></pt></val></ser></barChart></plotArea></c>"
    assert office.chart_series(xml) == ("bar", ["q1", "q2"], [("S", [None, 3.0])])
    assert office.chart_series("<c/>") is None and office.chart_series("<") is None
    assert office.diagram_texts("<d><pt><t>a</t><t>b</t></pt><pt/></d>") == ["ab"]


def test_asking(spark):
    one = lambda c, **v: spark.range(1).select(*[F.lit(x).alias(k) for k, x in v.items()]).select(c).first()[0]
    assert one(asking.label_in(F.col("t"), ["find", "find part"]), t="Label: find part.") == "find part"
    assert one(asking.clean_sql(F.col("t")), t="SQL: select 1 ;\n") == "select 1"
    assert abs(one(asking.confidence(F.array(F.lit(-0.1), F.lit(-0.2)))) - 0.7408182) < 1e-6
    got = one(asking.condition_changes(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("c")), F.array(F.lit("a"))))
    assert got.asDict() == {"kept": ["b", "c"], "added": ["c"], "removed": ["A"]}
    assert abs(sum(x * x for x in one(asking.hash_embedding(F.lit("a b c a")))) - 1) < 1e-9 and set(one(asking.hash_embedding(F.lit(None).cast("string")))) == {0.0}
    with pytest.raises(asking.QueryError):
        asking.run_sql(spark, "drop table x")
    with pytest.raises(asking.QueryError):
        asking.run_sql(spark, "select nothing_like_it")
    calls = []
    assert asking.with_retries(lambda x: calls.append(x) or (1 / (len(calls) - 1)))(1) == 1.0
