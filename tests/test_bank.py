"""Similarity, raw rows, readers, report, streaming and skew-safe joins."""

import json
import math
import random
import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest

from aulamill.operators import gift, rawcsv, similar, stats, work
from aulamill.plans import catalog, commands, report
from aulamill.sources import files as sources
from aulamill.streaming import ingest


def brute_similar(texts, threshold):
    clean = {k: re.sub("[^a-záéíóúñü0-9]+", " ", t.lower()).strip() for k, t in texts.items()}
    words = {k: Counter(c.split()) for k, c in clean.items()}
    df = Counter(w for c in words.values() for w in c)
    vec = {k: {w: n / sum(c.values()) * math.log(len(texts) / (1 + df[w])) for w, n in c.items()} for k, c in words.items()}
    out = {}
    for a, b in combinations(sorted(texts), 2):
        if not words[a] or not words[b]:
            continue
        common = set(words[a]) & set(words[b])
        jaccard = len(common) / len(set(words[a]) | set(words[b]))
        na, nb = (math.sqrt(sum(v * v for v in vec[k].values())) for k in (a, b))
        cosine = sum(vec[a][w] * vec[b][w] for w in common) / (na * nb) if na and nb else 0
        score = 0.4 * cosine + 0.6 * jaccard
        if score >= threshold - 1e-12:
            out[a, b] = score
    return clean, out


TEXTS = {
    1: "the cat sat on the mat today", 2: "the cat sat on the mat", 3: "The cat, sat on the MAT!", 4: "a dog ran far away from home",
    5: "a dog ran far away from home now", 6: "", 7: "¿?", 8: "unrelated words only here", 9: "cat mat",
}


@pytest.mark.parametrize(("threshold", "hot", "share"), [(0.85, 20_000, 0.998), (0.85, 20, 0.998), (0.7, 20_000, 0.5), (0.55, 50, 0.9)])
def test_similar_among_common_words(spark, tmp_path, monkeypatch, threshold, hot, share):
    """Texts of few words that all share: nothing but their combinations tells; few bytes are stored for them."""
    monkeypatch.setattr(similar, "HOT", hot, raising=False)
    monkeypatch.setattr(similar, "SLACK_SHARE", share, raising=False)
    draw, texts = random.Random(5), {}
    for i in range(600):
        words = draw.sample([f"w{k}" for k in range(50)], 24)
        texts[2 * i] = " ".join([*words, f"own{i}"] if i % 3 == 0 else words)
        texts[2 * i + 1] = " ".join([*words[draw.randrange(4) :], *[f"pair{i % 150}"] * (i % 3 == 1), *draw.sample(words, 2)])
    monkeypatch.setattr(similar, "RARE", 20, raising=False)
    _, want = brute_similar(texts, threshold)
    path = str(tmp_path / "texts")
    spark.createDataFrame(list(texts.items()), "id long, text string").write.parquet(path)
    stored_bytes = lambda: sum(f.stat().st_size for f in Path(work.work_root(spark).removeprefix("file:")).rglob("*.parquet") if f.is_file())
    before = stored_bytes()
    got = {(r.a, r.b): r.similarity for r in similar.similar_pairs(similar.cleaned(spark.read.parquet(path), "id", "text"), threshold).collect()}
    assert len(want) > 100 and got == pytest.approx(want)
    if threshold == 0.85:
        assert stored_bytes() - before < 5 * sum(f.stat().st_size for f in (tmp_path / "texts").rglob("*.parquet"))


@pytest.mark.parametrize(("sent", "rounds_from", "share"), [(1 << 26, 100_000, 0.998), (0, 0, 0.998), (0, 100_000, 0.0)])
def test_similar_long_texts(spark, tmp_path, monkeypatch, sent, rounds_from, share):
    """Long texts that share half their words: short sketches allow each pair, yet few are compared word by word, a part at a time."""
    for name, value in (("LONG_BYTES", sent), ("ROUNDS_FROM", rounds_from), ("SLACK_SHARE", share), ("SCORED", 30), ("SCORED_WORDS", 10**9)):
        monkeypatch.setattr(similar, name, value, raising=False)
    draw, texts = random.Random(7), {}
    for i in range(60):
        words = [f"shared{k}" for k in range(150)] + [f"own{i}of{k}" for k in range(150)]
        texts[2 * i] = " ".join(words)
        texts[2 * i + 1] = " ".join([*draw.sample(words, 270 + i % 30), f"new{i}"])
    _, want = brute_similar(texts, 0.85)
    path = str(tmp_path / "texts")
    spark.createDataFrame(list(texts.items()), "id long, text string").write.parquet(path)
    corpus = similar.prepare(similar.cleaned(spark.read.parquet(path), "id", "text"))
    got = {(r.a, r.b): r.similarity for r in similar.similar_pairs(corpus, 0.85).collect()}
    assert len(want) > 30 and got == pytest.approx(want)
    assert similar.candidate_pairs(corpus, 0.75, work.Passing(spark)).count() < 100


@pytest.mark.parametrize("threshold", [0.85, 0.7, 0.5, 0.3])
def test_similar_equals_all_pairs(spark, threshold):
    rows = spark.createDataFrame([*TEXTS.items(), (10, None)], "id long, text string")
    clean, want = brute_similar(TEXTS, threshold)
    table = similar.cleaned(rows, "id", "text")
    members = {r.id: r.class_id for r in similar.membership(table).collect()}
    assert members == {k: min(j for j in clean if clean[j] == clean[k]) for k in clean}
    pairs = {(r.a, r.b): r.similarity for r in similar.similar_pairs(table, threshold).collect()}
    inside = {r.class_id: r.similarity for r in similar.class_scores(table).collect()}
    got = {}
    for a, b in combinations(sorted(clean), 2):
        ca, cb = sorted((members[a], members[b]))
        score = inside.get(ca, 0) if ca == cb else pairs.get((ca, cb), 0)
        if score >= threshold:
            got[a, b] = score
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)
    n_links = {r.id: r.n_links for r in similar.links(table, threshold).collect()}
    assert n_links == {k: sum(k in p for p in want) for k in clean}


def test_membership_of_documents(spark, tmp_path):
    spark.createDataFrame([*TEXTS.items(), (10, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    classes = {r.id: (r.class_id, r.n_members) for r in catalog.similar_document_classes(spark, str(tmp_path)).collect()}
    assert classes == {k: (k, 1) for k in (1, 4, 5, 8, 9)} | {k: (2, 2) for k in (2, 3)} | {k: (6, 2) for k in (6, 7)}
    links = {r.id: (r.class_id, r.n_links) for r in catalog.similar_document_links(spark, str(tmp_path)).collect()}
    _, pairs = brute_similar(TEXTS, 0.85)
    assert (2, 3) in pairs
    assert links == {k: (classes[k][0], sum(k in p for p in pairs)) for k in TEXTS}


def test_identical_pair_without_weight(spark):
    """Two of three texts are equal, so their words weigh nothing and they score 0.6."""
    rows = spark.createDataFrame([(1, "same text a"), (2, "same text a"), (3, "other words")], "id long, text string")
    scores = similar.class_scores(similar.cleaned(rows, "id", "text")).collect()
    assert [(r.class_id, r.similarity) for r in scores] == [(1, 0.6)]
    none = spark.createDataFrame([], "id long, text string")
    assert similar.similar_pairs(similar.cleaned(none, "id", "text")).count() == 0


COLUMNS = [
    ("scan_id", "positive integer", True), ("root_dir", "text", True), ("scanned_at", "timestamp", True), ("total_files", "count", True),
    ("valid_files", "count", True), ("invalid_files", "count", True), ("with_tags_pct", "percent", False), ("parse_errors", "text", False),
]
GOOD = "1,d,2024-02-29 10:00:00,3,2,1,50.25,"


@pytest.mark.parametrize(
    ("raw", "failure"),
    [
        (GOOD.encode(), None),
        (b'1,"a ""b"", c",2024-02-29 10:00:00,3,2,1,,"x\ny, z"', None),
        (b'"1","d","2024-02-29 10:00:00","3","2","1","","\\"', None),
        (b"1,d,2024-02-29 10:00:00,3,2,1,100.0000, x ", None),
        (b"1,d,2024-02-29 10:00:00,3,2,1,\xff,", "encoding"),
        (b'1,d"e,2024-02-29 10:00:00,3,2,1,,', "quoting"),
        (b'1,"d,2024-02-29 10:00:00,3,2,1,,', "quoting"),
        (b'1,"d" ,2024-02-29 10:00:00,3,2,1,,', "quoting"),
        (b'1,d,2024-02-29 10:00:00,3,2,1,,"a \\"b\\" c"', "quoting"),
        (b"", "columns"),
        (None, "columns"),
        (b"1,d", "columns"),
        (GOOD.encode() + b",", "columns"),
        (GOOD.encode() + b"\n", "columns"),
        (b"0,d,2024-02-29 10:00:00,3,2,1,,", "value"),
        (b"\xef\xbb\xbf1,d,2024-02-29 10:00:00,3,2,1,,", "value"),
        (b"1,,2024-02-29 10:00:00,3,2,1,,", "value"),
        (b"1, d,2024-02-29 10:00:00,3,2,1,,", "value"),
        (b"1,d,2023-02-29 10:00:00,3,2,1,,", "value"),
        (b"1,d,2024-02-29 24:00:00,3,2,1,,", "value"),
        (b"1,d,2024-02-29 10:00:60,3,2,1,,", "value"),
        (b"1,d,2024-02-29 10:00:00,1234567890,2,1,,", "value"),
        ("1,d,2024-02-29 10:00:00,１２,2,1,,".encode(), "value"),
        (b"1,d,2024-02-29 10:00:00,3,2,1,100.1,", "value"),
        (b"1,d,2024-02-29 10:00:00,3,2,1,1.23456,", "value"),
    ],
)
def test_raw_rows(spark, raw, failure):
    # The row stands among good ones, which it must not take along.
    rows = [(1, bytearray(GOOD.encode())), (2, None if raw is None else bytearray(raw)), (3, bytearray(GOOD.encode()))]
    table = spark.createDataFrame(rows, "line_id long, raw_line binary").coalesce(1)
    got = {r.line_id: r for r in rawcsv.read_records(table, COLUMNS).collect()}
    assert [got[i].failure for i in (1, 2, 3)] == [None, failure, None]
    assert got[1].with_tags_pct == 50.25 and got[3].scan_id == 1


def test_raw_rows_edges(spark):
    none = spark.createDataFrame([], "line_id long, raw_line binary")
    assert rawcsv.read_records(none, COLUMNS).count() == 0
    long = f'1,"{"x" * 300_000}",2024-02-29 10:00:00,3,2,1,,'
    extra = spark.createDataFrame([(1, "f", bytearray(long.encode()))], "line_id long, failure string, raw_line binary")
    row = rawcsv.read_records(extra, COLUMNS).head()
    assert row.failure is None and len(row.root_dir) == 300_000


def test_typed_rows_keep_parse_errors(spark, tmp_path):
    raw = [(1, b'1,d,2024-02-29 10:00:00,3,2,1,50.25,"a ""b"", c\nd"'), (2, GOOD.encode()), (3, b"1,d")]
    spark.createDataFrame([(i, bytearray(x)) for i, x in raw], "line_id long, raw_line binary").write.parquet(str(tmp_path / "raw_stats.parquet"))
    columns = [(i, *c) for i, c in enumerate(COLUMNS, 1)]
    schema = "col_no int, col_label string, col_kind string, required boolean"
    spark.createDataFrame(columns, schema).write.parquet(str(tmp_path / "raw_column.parquet"))
    rows = catalog.p3_rows(spark, str(tmp_path))
    assert rows.columns == ["line_id", *(c[0] for c in COLUMNS)]
    assert {r.line_id: r.parse_errors for r in rows.collect()} == {1: 'a "b", c\nd', 2: ""}


def test_join_on_hot_keys(spark):
    rows = spark.range(3_000_00).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('k', id % 1000) end as k")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "upper(k) as v")
    out = work.join_skewed(rows, keyed, "k", "n", 3_000_00)
    assert out.count() == 3_000_00
    assert out.where("v <> upper(k)").count() == 0


def test_files_report_and_stream(spark, tmp_path):
    bank = tmp_path / "bank"
    (bank / "sub").mkdir(parents=True)
    (bank / "a.gift").write_text("$CATEGORY: c\n::Q1:: Same text here {=A}\n\n// [tag:t]\n::Q2:: Same text here {=A}", encoding="utf-8")
    (bank / "sub" / "b.gift").write_bytes(b"\xff")
    (bank / "sub" / "c.gift").write_text("just text", encoding="utf-8")
    (bank / "x.xml").write_text("<quiz/>")
    found = sources.read_texts(spark, str(bank))
    assert found.count() == 3
    assert sources.read_texts(spark, str(bank), recursive=False).count() == 1
    assert sources.find_files(spark, str(bank), sources.EXTENSIONS["texts"]).count() == 4
    questions = gift.parse(found.where("success"))
    made = report.Bank(found, questions, str(bank), 0.5)
    text = report.render(made)
    for part in ("Total de archivos GIFT: 3", "❌ Archivos inválidos: 1", "Short", "Nivel 1: 2 archivos", "c ", "just text"):
        assert part in text
    document = json.loads(report.json_text(made))
    counters = document["stats"]
    assert counters["totalQuestions"] == 3 and counters["byType"] == {"Short": 2, "Description": 1}
    assert counters["filesByDepth"] == {"0": 1, "1": 2} and counters["byTag"] == {"t": 1} and counters["byCategory"] == {"c": 1}
    assert [e["filepath"][-6:] for e in counters["parseErrors"]] == ["b.gift"]
    assert [len(document[k]) for k in ("issues", "duplicates", "descriptions")] == [1, 1, 1]
    assert document["duplicates"][0]["question1"]["title"] == "Q1" and document["duplicates"][0]["question2"]["type"] == "Short"
    report.write_lines(report.json_lines(made), str(tmp_path / "json"))
    parts = sorted((tmp_path / "json").glob("part-*"))
    assert json.loads("".join(p.read_text() for p in parts)) == document
    assert stats.category_files(questions).count() == 1
    out = tmp_path / "out"
    ingest.parse_new_files(spark, str(bank), str(out), str(tmp_path / "cp")).awaitTermination()
    (bank / "d.gift").write_text("N{=1}")
    ingest.parse_new_files(spark, str(bank), str(out), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(out))
    assert stored.count() == 5
    assert {r.type for r in stats.type_counts(stored).collect()} == {"Short", "Description"}


def test_copies_in_report(spark):
    """Each copy is named with the first of its class, though no other question resembles them; the total counts all pairs."""
    same = "::Capital:: Which city is the capital of France {=Paris}"
    near = "::Capital:: Which city is the capital of France today {=Paris}"
    texts = [("a.gift", same), ("b.gift", "::Capital:: Which city is the capital of France? {=PARIS}"), ("c.gift", same)]
    others = [("d.gift", "::X:: One word {=no}"), ("e.gift", "::Y:: Something else entirely {=yes}"), ("g.gift", "::Z:: Nothing of those {=so}")]
    for extra, n_pairs, total in (([], 0, 3), ([("f.gift", near)], 1, 6)):
        rows = [(p, True, None, c) for p, c in texts + others + extra]
        found = spark.createDataFrame(rows, "filepath string, success boolean, error string, content string")
        made = report.Bank(found, gift.parse(found), "", 0.7)
        text = report.render(made)
        section = text.split("🔄 PREGUNTAS DUPLICADAS O MUY SIMILARES")[1].split("💡")[0]
        assert f"Total de duplicados encontrados: {total}\nThreshold de similitud: 0.7\n\nDuplicado 1: Similitud = 1.000\n" in section
        assert "  Pregunta A (Short): Capital\n    Archivo: a.gift\n  Pregunta B (Short): Capital\n    Archivo: b.gift\n  Comando: meld -n 'a.gift' 'b.gift'\n" in section
        assert section.count("Duplicado ") == 2 + n_pairs
        document = json.loads(report.json_text(made))
        both = [(x["question1"]["filepath"], x["question2"]["filepath"]) for x in document["duplicates"]]
        assert both[:2] == [("a.gift", "b.gift"), ("a.gift", "c.gift")] and len(both) == 2 + n_pairs


def test_whole_report(spark):
    """The report of a small bank, line by line."""
    rows = [("d/a.gift", True, None, "::T:: Q one {=a}\n\n::T:: Q one {=a}"), ("d/s/b.gift", True, None, "{}\n\nplain\ntext"), ("d/x.gift", False, "gone", None), ("d/e.gift", True, None, "")]
    files = spark.createDataFrame(rows, "filepath string, success boolean, error string, content string")
    text = report.render(report.Bank(files, gift.parse(files.where("success")), "d", 0.5))
    rule = "-" * 80
    assert text.split("\n") == [
        "=" * 80, "INFORME DE EVALUACIÓN DE PREGUNTAS GIFT", "=" * 80, "",
        "📊 RESUMEN GENERAL", rule, "Total de archivos GIFT: 4", "  ✅ Archivos válidos: 3", "  ❌ Archivos inválidos: 1", "Total de preguntas: 4", "",
        "📝 TIPOS DE PREGUNTAS", rule, "  Short               :     2 ( 50.0%)", "  Description         :     1 ( 25.0%)", "  Essay               :     1 ( 25.0%)", "",
        "📂 CATEGORÍAS", rule, "  No se encontraron categorías", "",
        "🏷️  TAGS MÁS COMUNES", rule, "  No se encontraron tags", "",
        "✨ CALIDAD DE CONTENIDO", rule, "Preguntas con tags: 0", "Preguntas sin tags: 3", "Preguntas con feedback global: 0", "Preguntas sin feedback global: 3", "Preguntas vacías: 1", "",
        "📁 DISTRIBUCIÓN POR PROFUNDIDAD DE DIRECTORIOS", rule, "  Nivel 0: 3 archivos", "  Nivel 1: 1 archivos", "",
        "⚠️  PROBLEMAS DETECTADOS", rule, "Total de problemas: 3", "", "  ⚠️  d/e.gift: No contiene preguntas", "  ⚠️  d/s/b.gift: Pregunta sin título ni texto", "  ❌ d/x.gift: Error de parseo - gone", "",
        "❌ ERRORES DE PARSEO GIFT", rule, "  d/x.gift", "    Error: gone", "",
        "📄 PREGUNTAS TIPO DESCRIPTION (posibles problemas)", rule, "Total: 1", "Nota: Las preguntas tipo 'Description' no tienen respuestas.",
        "      Esto puede indicar un error en el formato de la pregunta.", "", "  📄 d/s/b.gift", "     Título: <sin título>", "     Texto: plain text...", "",
        "🔄 PREGUNTAS DUPLICADAS O MUY SIMILARES", rule, "Total de duplicados encontrados: 1", "Threshold de similitud: 0.5", "",
        "Duplicado 1: Similitud = 0.600", "  Pregunta A (Short): T", "    Archivo: d/a.gift", "  Pregunta B (Short): T", "    Archivo: d/a.gift", "  Comando: meld -n 'd/a.gift' 'd/a.gift'", "",
        "💡 RECOMENDACIONES", rule, "  • 75.0% de preguntas sin tags - considera añadir tags para mejor organización",
        "  • 75.0% de preguntas sin feedback global - el feedback ayuda al aprendizaje", "  • 1 preguntas vacías detectadas - requieren revisión",
        "  • 1 archivos con errores - necesitan corrección", "  • 1 preguntas duplicadas detectadas - considera revisar para eliminar redundancias", "", "=" * 80,
    ]
    with pytest.raises(ValueError):
        report.Bank(files, files, "", 1.5)


def test_commands(spark, tmp_path):
    """Each task from files on."""
    (tmp_path / "s").mkdir()
    (tmp_path / "A b.gift").write_text("::Tí T:: Q {=a ~b}\n\n::Tí T:: Q `x==1` {=a ~b}", encoding="utf-8")
    (tmp_path / "s" / "q.xml").write_text("<quiz><question><name><text>N &amp; M</text></name><questiontext><text><![CDATA[<b>x</b> `a==b`]]></text></questiontext><tags/></question></quiz>")
    (tmp_path / "n.md").write_text("`a==b` and\n```\n    c\n```\n")
    path = str(tmp_path)
    checked = {r.filepath.rsplit("/", 1)[1]: (r.success, r.n_questions) for r in commands.validate(spark, [path, f"{path}/none.gift"]).collect()}
    assert checked == {"A b.gift": (True, 2), "none.gift": (False, None)}
    assert commands.similar(spark, path, threshold=0.5).count() == 1
    assert commands.bank(spark, path).counters["total_questions"] == 2
    assert commands.format_files(spark, path).where("changed").count() == 1
    assert commands.format_files(spark, path, code=True, to_plain=False).where("changed").count() == 3
    assert {r.n_changes for r in commands.fix_code_characters(spark, path, to_plain=False).collect()} == {1}
    assert commands.fix_code_indents(spark, path).where("n_changes > 0").count() == 0
    new = lambda df: sorted(r.new_path.rsplit("/", 1)[1] for r in df.collect())
    assert new(commands.fix_names(spark, path)) == ["a_b.gift", "n.md", "q.xml"]
    assert new(commands.fix_names_from_titles(spark, path)) == ["n_m.xml", "ti_t.gift"]
    assert commands.fix_titles_from_names(spark, path).where("changed").count() == 2
    assert commands.html_to_markdown(spark, path).where("new_content like '%**x**%'").count() == 1
    assert new(commands.split(spark, path)) == ["tí_t.gift", "tí_t_2.gift"]
    assert [r.n_changes for r in commands.xml_cdata(spark, path).collect()] == [1]
    assert [r.n_changes for r in commands.xml_without_tags(spark, path).collect()] == [1]
    assert new(commands.xml_names(spark, path)) == ["n_m.xml"]


@pytest.fixture
def left(spark):
    """Runs a function; gives its result and the names of the working tables that it leaves on disk."""

    def run(function, *args):
        folder = Path(work.new_path(spark, "x").removeprefix("file:")).parent
        before = set(folder.iterdir())
        return function(*args), {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before}

    return run


def test_tables_left_by_named_pairs(spark, tmp_path, monkeypatch, left):
    """Keys met in rounds give the same pairs, and what they were made of is off the disk before pairs get their names."""
    monkeypatch.setattr(similar, "ROUNDS_FROM", 0, raising=False)
    monkeypatch.setattr(similar, "ROUNDS", 3, raising=False)
    _, want = brute_similar(TEXTS, 0.85)
    rows = [(k, f"f{k}", "Short", t, "", [], None) for k, t in TEXTS.items()]
    kind = "question_id long, filepath string, qtype string, title string, t string, tags array<string>, match_pairs array<struct<subquestion struct<fmt string, text string>, subanswer string>>"
    made = spark.createDataFrame(rows, kind).selectExpr(
        "question_id", "filepath", "1 as ordinal", "qtype", "title", "named_struct('fmt', 'html', 'text', t) as stem", "tags", "match_pairs",
        "cast(null as array<struct<is_correct: boolean, weight: double, text: struct<fmt: string, text: string>, feedback: struct<fmt: string, text: string>>>) as choices",
    )
    made.write.parquet(str(tmp_path / "questions.parquet"))
    found, tables = left(catalog.similar_named, spark, str(tmp_path))
    assert {(r.a, r.b) for r in found.collect()} == set(want)
    assert not tables & {"word-sets", "word-counts", "near", "candidates", "vectors"}


def test_tables_left_by_links(spark, left):
    """Texts get their links after the tables that these were counted from are off the disk; a prepared corpus keeps its own."""
    table = similar.cleaned(spark.createDataFrame([*TEXTS.items(), (10, None)], "id long, text string"), "id", "text")
    clean, want = brute_similar(TEXTS, 0.85)
    found, tables = left(similar.links, table)
    assert {r.id: r.n_links for r in found.collect()} == {k: sum(k in p for p in want) for k in clean}
    assert not tables & {"word-sets", "word-counts", "near", "candidates", "vectors"}
    corpus = similar.prepare(table)
    assert similar.links(corpus).count() == len(clean) and corpus.sets.count() == 7


def test_links_clean_each_text_once(spark):
    """The pass over the texts, which is most of the work on long ones, is not repeated for their hashes."""
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)

    def same(text: str) -> str:
        calls.add(1)
        return text

    clean, want = brute_similar(TEXTS, 0.85)
    table = spark.createDataFrame(list(clean.items()), "id long, clean string")
    found = similar.links(table.select("id", F.udf(same)("clean").alias("clean")))
    assert {r.id: r.n_links for r in found.collect()} == {k: sum(k in p for p in want) for k in clean}
    assert calls.value == len(clean)


def test_shuffle_files_of_the_last_job_are_freed(spark):
    """Also those of the job that ended just before."""
    import time

    folders = [Path(str(f)) for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    n_bytes = lambda: sum(p.stat().st_size for f in folders for p in f.rglob("shuffle_*.data") if p.exists())
    work.free_shuffles(spark)
    time.sleep(1)
    before = n_bytes()
    work.stored(spark.range(1_000_000).selectExpr("xxhash64(id) as h").repartition(4, "h"), "freed")
    assert n_bytes() > before + 1_000_000
    work.free_shuffles(spark)
    for _ in range(50):
        if n_bytes() <= before:
            break
        time.sleep(0.1)
    assert n_bytes() <= before


def test_tables_left_by_duplicates(spark, left):
    """Once the duplicates are counted, their word sets are off the disk, and the rows still come out."""
    rows = [("a.gift", True, None, "::T:: Q one two three {=a}\n\n::T:: Q one two three {=a}\n\n::U:: Other words here {=b}\n\n::V:: Four more {=c}\n\n::W:: Nothing alike {=d}")]
    files = spark.createDataFrame(rows, "filepath string, success boolean, error string, content string")
    bank = report.Bank(files, gift.parse(files))
    n, tables = left(lambda: bank.n_duplicates)
    assert n == 1 and bank.duplicates.count() == 1
    assert not tables & {"word-sets", "word-counts", "near", "candidates", "vectors"}
