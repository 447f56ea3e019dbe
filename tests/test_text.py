"""Text functions, layouts, XML edits and plans of changes."""

import pytest
from pyspark.sql import functions as F

from aulamill.functions import text as X
from aulamill.operators import enrich
from aulamill.plans import catalog, changes


@pytest.mark.parametrize(
    ("text", "slug"),
    [("Hola Mundo", "hola_mundo"), ("Pregunta: ¿Qué es?", "pregunta_que_es"), ("Acción y Función", "accion_y_funcion"), ("", ""), (None, None)],
)
def test_slugify(value, text, slug):
    assert value(X.slugify, text) == slug


def test_slugs_of_all_titles(spark, tmp_path):
    titles = {
        1: "Acción y Función", 2: "Ejercicio 1152 – Traza de los permisos heredados", 3: "“Comillas” y ‘más’", 4: "Ｆｕｌｌ ｗｉｄｔｈ　１２",
        5: "Æsir × straße", 6: "ﬁn de línea\n", 7: "数据 Q7", 8: "Привет", 9: "", 10: None, 11: "x²  -  y½",
    }
    spark.createDataFrame([*titles.items()], "question_id long, title string").write.parquet(str(tmp_path / "questions.parquet"))
    want = {1: "accion_y_funcion", 2: "ejercicio_1152_traza_de_los_permisos_heredados", 3: "comillas_y_mas", 4: "full_width_12"}
    want |= {5: "sir_strae", 6: "fin_de_linea", 7: "q7", 8: "", 9: "", 11: "x2_y12"}
    assert {r.question_id: r.slug for r in catalog.slugs(spark, str(tmp_path)).collect()} == want


def test_fences_and_empty_blocks_stay_in(spark, tmp_path):
    spans = [(1, "`a=b`"), (2, "```c\na=b\n```"), (3, None)]
    spark.createDataFrame(spans, "text_id long, text string").write.parquet(str(tmp_path / "formatted_text.parquet"))
    xml = [(1, "xml", "<text>a</text>"), (2, "xml", "<text/><x>k</x><text>c</text>"), (3, "xml", None), (4, "gift", "<text>a</text>")]
    spark.createDataFrame(xml, "doc_id long, fmt string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    mapped = {r.text_id: r.mapped for r in catalog.code_spans_to_wide(spark, str(tmp_path)).collect()}
    assert mapped == {1: "`a＝b`", 2: "```c\na＝b\n\n```"}
    assert {r.doc_id: r.n_missing for r in catalog.cdata_missing(spark, str(tmp_path)).collect()} == {1: 1, 2: 1}


def test_sanitize(value):
    assert value(X.sanitize_filename, "  Año - nuevo: 1/2 ") == "año_nuevo_12"
    assert len(value(X.sanitize_filename, "x" * 500)) == 100


def test_html(value):
    out = value(X.html_to_markdown, "<code>code</code> <p>para</p> <strong>bold</strong>")
    assert "`code`" in out and "**bold**" in out and "para" in out
    assert "`code`" in value(X.html_to_markdown, "＜code＞code＜/code＞ ＜p＞para＜/p＞")
    assert value(X.html_to_markdown, "a<br />b<pre>c\nd</pre>") == "a\nb```\nc\nd\n```"
    xml = '<t format="html"><![CDATA[<b>x</b>]]></t><b>y</b>'
    assert value(X.html_to_markdown_in_xml, xml) == '<t format="markdown"><![CDATA[**x**]]></t><b>y</b>'


def test_code_indent(value):
    text = "```python\n    print('hello')\n```"
    assert value(X.indent_code, text) == "```python\n····print('hello')\n```"
    assert value(X.count_indents, text) == 1
    text = "    a\n```\n         b\nc    d\n```\n    e"
    assert value(X.indent_code, text) == "    a\n```\n········ b\nc    d\n```\n    e"
    assert value(X.count_indents, text) == 2
    assert value(X.indent_code, "```\n    open") == "```\n····open"
    assert value(X.indent_code, "") == ""
    assert value(X.indent_code, None) is None


def test_character_map(value):
    wide = lambda t: value(lambda c: X.map_code(c, False), t)
    plain = lambda t: value(lambda c: X.map_code(c, True), t)
    assert wide("Check this: `x == y`") == "Check this: `x ⩵ y`"
    assert plain(wide("Check this: `x == y`")) == "Check this: `x == y`"
    assert value(lambda c: X.count_mapped_code(c, False), "`x == y` and `z`") == 1
    assert wide("a = b") == "a = b"
    assert wide("```c\na=b\n```") == "```c\na＝b\n\n```"
    assert value(lambda c: X.map_code_in_cdata(c, False), "`a=b`<![CDATA[`a=b`]]>") == "`a=b`<![CDATA[`a＝b`]]>"
    assert value(lambda c: X.map_characters(c, True), "＆＇　↵") == "&#38;&#39;&nbsp;\n"


def test_cdata(value):
    assert value(X.ensure_cdata, "<question><text>Content</text></question>") == "<question><text><![CDATA[Content]]></text></question>"
    assert value(X.count_missing_cdata, "<text>a</text><text> </text><text><![CDATA[b]]></text>") == 1
    xml = "<text/><x>keep</x><text>c</text>"
    assert value(X.ensure_cdata, xml) == "<text/><x>keep</x><text><![CDATA[c]]></text>"
    assert value(lambda c: X.ensure_cdata(c, safe=False), xml) == "<text/><![CDATA[<x>keep</x><text>c]]></text>"


def test_remove_tags(value):
    xml = "<quiz><question type='x'><tags><tag/></tags><a/></question><tags>stay</tags></quiz>"
    assert value(X.remove_tags, xml) == "<quiz><question type='x'><a/></question><tags>stay</tags></quiz>"
    assert value(X.count_tags, xml) == 1


def test_titles(value):
    gift = "::Old Title::\nQuestion{=A}"
    assert value(X.gift_title, gift) == "Old Title"
    new = value(X.set_gift_title, gift, F.lit(r"New $1 \Title"))
    assert new == "::New $1 \\Title::\nQuestion{=A}"
    assert value(X.set_gift_title, "Q{=A}", F.lit("N")) == "::N::\nQ{=A}"
    xml = "<quiz><question type='m'><name><text>Old XML</text></name></question></quiz>"
    assert value(X.xml_title, xml) == "Old XML"
    assert value(X.xml_title, value(X.set_xml_title, xml, F.lit("N$"))) == "N$"
    held = xml.replace("Old XML", "<![CDATA[Old]]>")
    assert "<![CDATA[N]]>" in value(X.set_xml_title, held, F.lit("N"))
    assert value(X.title_from_name, "mi_ARCHIVO_dos") == "Mi archivo dos"


def test_format(value):
    form = lambda t, c=False: value(lambda x: X.format_gift(x, c), t)
    assert form("::Title::Question{=Ans~Wrong}") == "::Title::\nQuestion\n{\n    =Ans~Wrong\n}\n"
    assert form("// c\n::T::Q{\n~a\n more\n=b\n} tail") == "// c\n::T::\nQ\n{\n    ~a more\n    =b\n}\ntail\n"
    assert form("Q{\n~a\n=b\n}", True) == "Q\n{\n    =b\n    ~a\n}\n"
    assert form(r"a \{ b") == "a \\{ b\n"
    assert form("A{=x}\n\nB{=y}") == "A\n{\n    =x\n}\n\nB\n{\n    =y\n}\n"


def test_blocks(value):
    assert value(X.gift_blocks, "a\n \n\nb\n\nc") == ["a", "b", "c"]


def files(spark, *rows):
    return spark.createDataFrame(rows, "filepath string, content string")


def test_plans(spark):
    src = files(spark, ("d/Test Name.gift", "::Q1::\nText 1{=A}\n\n::Q2::\nText 2{=B}\n\nplain{=C}"), ("d/test name.gift", "x"), ("d/one.gift", "y"))
    split = changes.split_files(src).orderBy("pos").collect()
    assert [r.new_path for r in split] == ["d/q1.gift", "d/q2.gift", "d/Test Name_3.gift"]
    assert split[0].new_content == "::Q1::\nText 1{=A}\n"
    renamed = {r.filepath: (r.new_path, r.renamed) for r in changes.rename_to_slug(src).collect()}
    assert renamed == {
        "d/Test Name.gift": ("d/test_name.gift", True), "d/test name.gift": ("d/test_name_1.gift", True), "d/one.gift": ("d/one.gift", False)
    }
    titled = changes.rename_from_title(src).collect()
    assert [(r.filepath, r.new_path) for r in titled] == [("d/Test Name.gift", "d/q1.gift")]
    rewritten = changes.rewrite(src, X.format_gift).where("not changed").count()
    assert rewritten == 0
    out = changes.titles_from_names(files(spark, ("a/b_c.gift", "Q"))).head()
    assert (out.title, out.new_content, out.changed) == ("B c", "::B c::\nQ", True)


def test_write_texts(spark, tmp_path):
    plan = changes.split_files(files(spark, ("d/a.gift", "::Q1:: x{=A}\n\n::Q2:: y{=B}")))
    assert changes.write_texts(plan, str(tmp_path)).count() == 2
    assert (tmp_path / "d/q1.gift").read_text() == "::Q1:: x{=A}\n"


def test_enrichment(spark):
    src = files(spark, ("b.gift", "B1\n\nB2"), ("a.gift", "A1\n\nA2\n\nA3"), ("c.gift", ""))
    rows = enrich.batched(src, 2).orderBy("batch_id", "slot").collect()
    assert [(r.batch_id, r.slot, r.text) for r in rows] == [(0, 0, "A1"), (0, 1, "A2"), (1, 0, "A3"), (1, 1, "B1"), (2, 0, "B2")]
    assert enrich.share_out(["a", "b"], ["x"], "improve") == ["x", "b"]
    assert enrich.share_out(["a", "b"], list("123456"), "multiply") == ["1\n\n2\n\n3", "4\n\n5\n\n6"]
    assert enrich.share_out(["a", "b"], ["1", "2"], "multiply") == ["1\n\n2", "b"]
    assert enrich.split_answer("a\n---\nb\n--- \n\nc") == ["a", "b", "c"]
    assert enrich.mode_for("improve", "p") == "transform"

    def service(texts, mode):
        if "B2" in texts:
            raise RuntimeError("no answer")
        return [t.lower() for t in texts]

    out = {r.new_path: r.new_content for r in enrich.outputs(enrich.enriched(src, service, size=2)).collect()}
    assert out == {"a_improve.gift": "a1\n\na2\n\na3\n", "b_improve.gift": "b1\n\nB2\n"}


@pytest.mark.parametrize(
    ("xml", "title"),
    [
        ("<quiz><question><name><text>Tom &amp; Jerry</text></name></question></quiz>", "Tom & Jerry"),
        ('<?xml version="1.0" encoding="UTF-8"?><quiz><question type="category"/><question><name><text f="x"><![CDATA[A <b>]]></text></name></question></quiz>', "A <b>"),
        ("<quiz><question><name><text>T</text></name></question></quiz> rest", None),
        ("<quiz><question><name><text>T</text></name></quiz>", None),
        ("<quiz><question><name><text/></name></question></quiz>", None),
        ("", None),
        (None, None),
    ],
)
def test_xml_title(value, xml, title):
    assert value(X.xml_title, xml) == title


@pytest.mark.parametrize(
    ("xml", "left", "n"),
    [
        ("<question><tags/>a</question>", "<question>a</question>", 1),
        ('<question f="1"><tags lang="x/y"><tag/></tags>a<tags>b</tags></question>', '<question f="1">a<tags>b</tags></question>', 1),
        ("<question>a</question><question><tags a='b'/></question>", "<question>a</question><question></question>", 1),
        ("<question><![CDATA[<tags>q</tags></question>]]><tags>z</tags></question>", "<question><![CDATA[<tags>q</tags></question>]]></question>", 1),
        ("<questions><tags>a</tags></questions>", "<questions><tags>a</tags></questions>", 0),
    ],
)
def test_tags_in_every_form(value, xml, left, n):
    assert value(X.remove_tags, xml) == left
    assert value(X.count_tags, xml) == n


def test_new_names_are_unique(spark):
    """Names that collide across groups, with files that stay, and with each other."""
    paths = ["d/A b.gift", "d/a b.gift", "d/a b 1.gift", "d/c.gift", "d/C.gift", "d/Ç.gift", "e/A b.gift", "d/a_b_2.gift", "d/Á B.gift"]
    plan = {r.filepath: r.new_path for r in changes.rename_to_slug(files(spark, *((p, "") for p in paths))).collect()}
    assert len(set(plan.values())) == len(paths)
    assert plan["d/A b.gift"] == "d/a_b.gift" and plan["d/a b 1.gift"] == "d/a_b_1.gift" and plan["d/a b.gift"] == "d/a_b_3.gift"
    assert plan["d/a_b_2.gift"] == "d/a_b_2.gift"
    assert plan["d/c.gift"] == "d/c.gift" and {plan["d/C.gift"], plan["d/Ç.gift"]} == {"d/c_1.gift", "d/c_2.gift"}
    assert plan["e/A b.gift"] == "e/a_b.gift"
    two = "::Q1:: x{=A}\n\n::Q1:: y{=B}"
    parts = changes.split_files(files(spark, ("d/a.gift", two), ("d/b.gift", two), ("d/q1.gift", two), ("d/q1_2.gift", "z{=1}"))).collect()
    names = [r.new_path for r in parts]
    assert len(set(names)) == 6 and not {"d/a.gift", "d/q1.gift", "d/q1_2.gift"} & set(names)
    assert {r.new_content.strip()[-5:] for r in parts} == {"x{=A}", "y{=B}"}
