import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from passagework.functions.metadata import merge_metadata, metadata_text
from passagework.functions.text import file_extension, page_preview, strip_text, truncate_text, unescape_markup
from passagework.operators import pages as P
from passagework.sources import evalset, files, markup


def assembled(spark, events, documents):
    e = spark.createDataFrame([(d, i, k, t) for d, rows in events.items() for i, (k, t) in enumerate(rows)],
                              "doc string, seq int, kind string, text string")
    docs = spark.createDataFrame([(d,) for d in documents], "doc string")
    out = {}
    for r in P.assemble_pages(e, docs, "doc").orderBy("doc", "page_number").collect():
        out.setdefault(r.doc, []).append((r.page_number, r.content))
    return out


def test_page_assembly_edges(spark):
    b, t = ("break", ""), lambda x: ("text", x)
    got = assembled(
        spark,
        {
            "breaks": [b, b, t("one"), t(" "), t("two"), b, b, t("three"), b],
            "blank": [t("  "), b, t("")],
            "plain": [t("x")],
        },
        ["breaks", "blank", "plain", "none"],
    )
    assert got == {
        "breaks": [(1, "one\n\ntwo"), (2, "three")], "blank": [(1, "")], "plain": [(1, "x")], "none": [(1, "")],
    }


def test_long_document_keeps_its_pages(spark):
    rows = [("text", f"p{i}") if i % 2 == 0 else ("break", "") for i in range(12_000)]
    got = assembled(spark, {"long": rows}, ["long"])["long"]
    assert got == [(i + 1, f"p{2 * i}") for i in range(6_000)]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
XML = f"""<?xml version="1.0"?><w:document {W}><w:body>
<w:p w:rsidR="1"><w:pPr><w:jc w:val="left"/></w:pPr><w:r><w:t>A &amp; B</w:t><w:tab/><w:t xml:space="preserve"> c</w:t></w:r>
<w:r><w:br w:type="page"/></w:r><w:r><w:t>after</w:t><w:br/><w:t>&#233;&#x1F600;</w:t></w:r></w:p>
<w:p/>
<w:tbl><w:tblPr/><w:tr><w:tc><w:p><w:r><w:t>a1</w:t></w:r></w:p><w:p><w:r><w:t>a2</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc>
<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:p><w:r><w:t>b1</w:t><w:br w:type="page"/></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:pPr><w:sectPr><w:pgSz/></w:sectPr></w:pPr><w:r><w:t>end of section</w:t></w:r></w:p>
<w:p><w:r><w:t>last</w:t></w:r></w:p><w:sectPr><w:pgSz/></w:sectPr></w:body></w:document>"""
CORE = """<cp:coreProperties><dc:title>My &lt;title&gt;</dc:title><dc:creator>Ann</dc:creator>
<dcterms:created xsi:type="dcterms:W3CDTF">2024-01-02T03:04:05Z</dcterms:created></cp:coreProperties>"""


def test_word_events(spark):
    docs = spark.createDataFrame([("d", XML)], "doc string, xml string")
    got = [(r.kind, r.text) for r in markup.markup_events(docs, "doc", "xml").orderBy("seq").collect()]
    assert got == [
        ("text", "A & B\t c"), ("break", ""), ("text", "afteré😀"), ("text", ""),
        ("text", "a1\na2\t\twide\twide"), ("text", "b1"), ("text", "end of section"), ("break", ""), ("text", "last"),
    ]


def test_word_boxes_nested_and_merged_cells():
    def p(inner):
        return f"<w:p>{inner}</w:p>"

    def r(text):
        return f"<w:r><w:t>{text}</w:t></w:r>"

    def tc(inner, props=""):
        return f"<w:tc><w:tcPr>{props}</w:tcPr>{inner}</w:tc>"

    box = p(r("A") + f"<w:r><w:drawing><w:txbxContent>{p(r('B'))}</w:txbxContent></w:drawing></w:r>" + r("C"))
    nested = f"<w:tbl><w:tr>{tc(p(r('deep')))}</w:tr></w:tbl>"
    table = (f"<w:tbl><w:tr>{tc(p(r('top')), '<w:vMerge w:val=\"restart\"/>')}{tc(p(r('x')) + nested)}</w:tr>"
             f"<w:tr>{tc(p(''), '<w:vMerge/>')}{tc(p(r('y')))}</w:tr></w:tbl>")
    control = f"<w:sdt><w:sdtContent>{p(r('skipped'))}</w:sdtContent></w:sdt>"
    xml = f"<w:document {W}><w:body>{box}{control}{table}{p(r('end'))}</w:body></w:document>"
    assert [t for _, t in markup.word_events(xml)] == ["ABC", "top\tx", "top\ty", "end"]
    assert markup.word_events(None) == []


def test_pages_in_row_equal_assembled_pages(spark):
    b, t = ("break", ""), lambda x: ("text", x)
    events = {"breaks": [b, b, t("one"), t(" "), t("two"), b, b, t("three"), b], "blank": [t("  "), b, t("")], "plain": [t("x")], "none": []}
    rows = spark.createDataFrame(list(events.items()), "doc string, es array<struct<kind:string,text:string>>")
    found = P.numbered_pages(rows, "doc", F.col("es"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("LocalTableScan")[0]
    got = {}
    for r in found.orderBy("doc", "page_number").collect():
        got.setdefault(r.doc, []).append((r.page_number, r.content))
    assert got == assembled(spark, events, list(events))


def test_word_file_end_to_end(spark, tmp_path):
    def archive(path, xml, core=None):
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("word/document.xml", xml)
            if core:
                z.writestr("docProps/core.xml", core)

    (tmp_path / "sub").mkdir()
    archive(tmp_path / "sub" / "Report.DOCX", XML, CORE)
    archive(tmp_path / "empty.docx", f"<w:document {W}><w:body></w:body></w:document>")
    (tmp_path / "notes.txt").write_text("skipped")
    (tmp_path / "broken.pdf").write_bytes(b"%PDF")
    found = files.require_files(files.discover_files(spark, str(tmp_path), with_bytes=True), str(tmp_path))
    assert sorted(r.uri.rsplit("/", 1)[1] for r in found.collect()) == ["Report.DOCX", "broken.pdf", "empty.docx"]
    handlers = [markup.WORD_HANDLER]
    good, bad = files.route_formats(found, files.handler_table(spark, handlers))
    assert [r.reason for r in bad.collect()] == ["no handler registered for file type"]
    parsed = files.parse_files(good, handlers)
    got = {(r.uri.rsplit("/", 1)[1], r.page_number): r for r in parsed.collect()}
    assert got[("Report.DOCX", 1)].content == "A & B\t c"
    assert got[("Report.DOCX", 2)].content == "afteré😀\n\na1\na2\t\twide\twide\n\nb1\n\nend of section"
    assert got[("Report.DOCX", 3)].content == "last"
    assert got[("empty.docx", 1)].content == ""
    assert got[("Report.DOCX", 1)].title == "My <title>"
    assert got[("Report.DOCX", 1)].doc_meta == {"author": "Ann", "created": "2024-01-02T03:04:05+00:00", "modified": ""}
    assert got[("empty.docx", 1)].title is None


def test_no_supported_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(files.NoSupportedFiles, match=".docx, .pdf"):
        files.require_files(files.discover_files(spark, str(tmp_path)), str(tmp_path))


def test_extensions(spark):
    names = ["a.PDF", "x/y.tar.gz", ".pdf", "dir.d/noext", "a..docx", "...pdf", "..a.pdf"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(file_extension(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["pdf", "gz", "", "", "docx", "", "pdf"]


def test_first_handler_wins(spark):
    table = files.handler_table(spark, [files.Handler("A", "1", ("PDF",)), files.Handler("B", "2", ("PDF", "DOCX"))])
    assert {(r.file_type, r.parser) for r in table.collect()} == {("PDF", "A"), ("DOCX", "B")}


def test_eval_set(spark, tmp_path):
    good = [{"user_input": "q", "reference": None}, {"user_input": "é", "reference": "r", "extra": 1}]
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1, ensure_ascii=False))
    (tmp_path / "bad.json").write_text(json.dumps([{"reference": "r", "answer": "a"}]))
    (tmp_path / "empty.json").write_text("[]")
    rows = evalset.load_eval_set(spark, str(tmp_path / "good.json")).collect()
    assert {(r.user_input, r.reference) for r in rows} == {("q", None), ("é", "r")}
    with pytest.raises(evalset.BadSamples, match="answer,reference"):
        evalset.load_eval_set(spark, str(tmp_path / "bad.json"))
    assert evalset.load_eval_set(spark, str(tmp_path / "empty.json")).count() == 0


def test_table_rows(spark):
    cells = [(1, r, c, f"r{r}c{c}" if (r, c) != (1, 1) else "") for r in range(2) for c in range(3)]
    df = spark.createDataFrame(cells, "doc int, row_no int, cell_no int, text string")
    assert {r.text for r in P.table_row_text(df, "doc").collect()} == {"r0c0\tr0c1\tr0c2", "r1c0\t\tr1c2"}


def test_physical_pages_keep_blanks(spark):
    df = spark.createDataFrame([(1, "a\f\fb")], "doc int, text string")
    assert [(r.page_number, r.content) for r in P.physical_pages(df, "doc", "text").collect()] == [(1, "a"), (2, ""), (3, "b")]


def test_text_helpers(spark):
    df = spark.createDataFrame([("😀" * 5, "  x  \n")], "a string, b string")
    r = df.select(truncate_text(F.col("a"), 3), truncate_text(F.col("a"), 5), strip_text(F.col("b")),
                  page_preview(F.col("b"), 1), page_preview(F.col("b"), 0), unescape_markup(F.lit("&amp;lt; &#65;&#x42;&bad; &"))).first()
    assert r[0] == "😀😀😀… [+2 chars]" and r[1] == "😀" * 5 and r[2] == "x"
    assert r[3] == "<empty>  … (+5 more chars)" and r[4] == "  x  \n" and r[5] == "&lt; AB&bad; &"


def test_metadata_merge(spark):
    a, b = F.create_map(F.lit("k"), F.lit("1"), F.lit("a"), F.lit("2")), F.create_map(F.lit("k"), F.lit("3"))
    assert spark.range(1).select(metadata_text(merge_metadata(a, b))).first()[0] == '{"a":"2","k":"3"}'


def test_table_rows_from_runs_of_cells(spark):
    """Scattered, repeated, null and tabbed cells give what sorting single cells gives; whole rows are shuffled as one run."""
    whole = [("a", r, c, f"t{r}-{c}") for r in range(3) for c in range(50)]
    odd = [("b", 1, 2, "c"), ("b", 1, 0, "a"), ("b", 1, 1, "b"), ("b", 1, 0, "z"), ("b", 1, 1, "A"), ("b", 2, 0, "x\ty"), ("b", 2, 1, None), ("b", 2, 2, ""),
           ("b", 2, 3, "end"), (None, 1, 0, "n"), (None, 1, 1, "m"), ("c", None, 0, "p"), ("c", None, 1, "q"), ("d", 1, None, "u"), ("d", 1, 0, "v"), ("e", 1, 0, None)]
    cells = spark.createDataFrame(whole + odd, "key string, row_no int, cell_no int, text string").coalesce(1)
    order = F.array_sort(F.collect_list(F.struct("cell_no", "text")))
    plain = cells.groupBy("key", "row_no").agg(F.array_join(F.transform(order, lambda r: r["text"]), "\t").alias("text"))
    assert sorted(map(str, P.table_row_text(cells, "key").collect())) == sorted(map(str, plain.collect()))
    runs = P._cell_runs(cells.filter("key = 'a'"), "key").collect()
    assert [(r["row_no"], r["first"], r["cells"]) for r in runs] == [(0, 0, 50), (1, 0, 50), (2, 0, 50)]
