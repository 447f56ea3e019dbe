"""The bank report, as text and as JSON, from aggregated tables.

Issues, errors, descriptions, duplicates and even tags can be as many as the
bank has questions, so both outputs are tables of lines with an order, which
``write_lines`` sorts and writes in the cluster; only ``render`` and
``json_text`` bring them to the driver, for banks that people read.

Duplicates are the pairs of similar questions between classes of copies, and
each further copy with the first of its class; the total counts all pairs of
questions, those between copies too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulamill.operators import similar, stats
from aulamill.operators.work import ranked, stored

WIDTH = 80
# The sections' headings, in order.
SECTIONS = [
    "📊 RESUMEN GENERAL",
    "📝 TIPOS DE PREGUNTAS",
    "📂 CATEGORÍAS",
    "🏷️  TAGS MÁS COMUNES",
    "✨ CALIDAD DE CONTENIDO",
    "📁 DISTRIBUCIÓN POR PROFUNDIDAD DE DIRECTORIOS",
    "⚠️  PROBLEMAS DETECTADOS",
    "❌ ERRORES DE PARSEO GIFT",
    "📄 PREGUNTAS TIPO DESCRIPTION (posibles problemas)",
    "🔄 PREGUNTAS DUPLICADAS O MUY SIMILARES",
    "💡 RECOMENDACIONES",
]
# What stands in a section without rows, and lines that begin or end the report's sections.
NOTHING = {1: "  No hay preguntas", 2: "  No se encontraron categorías", 3: "  No se encontraron tags"}
TITLE = "INFORME DE EVALUACIÓN DE PREGUNTAS GIFT"
DESCRIPTION_NOTES = [
    "Nota: Las preguntas tipo 'Description' no tienen respuestas.",
    "      Esto puede indicar un error en el formato de la pregunta.",
]
WELL = "  • ¡Todo se ve bien! No se detectaron problemas significativos"
# What an issue is called.
ISSUES = {
    "empty": "Pregunta sin título ni texto",
    "mc_without_correct": "Pregunta MC sin respuesta correcta",
    "matching_below_two_pairs": "Pregunta Matching con menos de 2 pares",
    "short_without_answers": "Pregunta Short sin respuestas",
}


@dataclass
class Bank:
    """Parsed files and questions of a bank, and what the report needs of them.

    Questions are named by ``question_id`` where they have one, else by file and ordinal.
    """

    files: DataFrame  # filepath, success, error
    questions: DataFrame  # as parsed
    base: str = ""
    threshold: float = 0.85

    def __post_init__(self):
        if not 0 <= self.threshold <= 1:
            raise ValueError("the threshold is between 0 and 1")

    @cached_property
    def keyed(self) -> DataFrame:
        if "question_id" in self.questions.columns:
            return self.questions.withColumn("key", F.lpad(F.col("question_id").cast("string"), 19, "0"))
        return self.questions.withColumn("key", F.concat_ws("#", "filepath", F.lpad(F.col("ordinal").cast("string"), 9, "0")))

    @cached_property
    def corpus(self) -> similar.Corpus:
        """The texts of the questions in the duplicate search."""
        full = stats.full_texts(self.keyed)
        return similar.prepare(similar.cleaned(full, "key", "full_text"))

    @cached_property
    def pairs(self) -> DataFrame:
        """(a, b, similarity): similar questions, classes of copies as one."""
        return stored(similar.similar_pairs(self.corpus, self.threshold).select("a", "b", "similarity"), "pairs-of-bank")

    @cached_property
    def copies(self) -> DataFrame:
        """(class_id, id, n_members, similarity): each copy but the first of its class."""
        return stored(similar.copies(self.corpus, self.threshold), "copies-of-bank")

    @cached_property
    def n_duplicates(self) -> int:
        """Pairs of similar questions, all copies counted."""
        sizes = self.corpus._groups.select(F.col("class_id").alias("id"), "n_members")
        sided = self.pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
        between = sided.agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0))).head()[0]
        # Of n copies, n - 1 are listed; each stands for n / 2 pairs.
        inside = int(self.copies.agg(F.coalesce(F.sum("n_members"), F.lit(0)) / 2).head()[0])
        self.corpus.drop()  # pairs and copies are stored, and the rest of the report reads only those
        return between + inside

    @cached_property
    def duplicates(self) -> DataFrame:
        """(a, b, similarity, and filepath, title, type of both, nth): most similar first."""
        both = self.pairs.unionByName(self.copies.select(F.col("class_id").alias("a"), F.col("id").alias("b"), "similarity"))
        named = similar.with_questions(both, self.keyed, "key")
        order = F.concat_ws(" ", F.format_string("%.6f", F.lit(9.0) - F.round("similarity", 6)), "a", "b")
        return ranked(named.withColumn("order", order), [], "order")

    @cached_property
    def issues(self) -> DataFrame:
        """(filepath, place, issue): findings of all kinds, as they are called."""
        name = F.create_map(*[F.lit(x) for pair in ISSUES.items() for x in pair])[F.col("issue")]
        place = lambda n, rule: F.concat(F.lpad(n, 9, "0"), rule)
        found = stats.issues(self.questions).select(
            "filepath",
            place(F.col("ordinal").cast("string"), F.when(F.col("issue") == "empty", "0").otherwise("1")).alias("place"),
            F.concat(
                F.lit("⚠️  "), F.col("filepath"), F.lit(": "), name,
                F.when(F.col("issue") != "empty", F.concat(F.lit(" - "), F.col("label"))).otherwise(""),
            ).alias("issue"),
        )
        none = stats.files_without_questions(self.files, self.questions).select(
            "filepath", F.lit("").alias("place"), F.concat(F.lit("⚠️  "), F.col("filepath"), F.lit(": No contiene preguntas")).alias("issue")
        )
        broken = self.files.where(~F.col("success")).select(
            "filepath", F.lit("").alias("place"),
            F.concat(F.lit("❌ "), F.col("filepath"), F.lit(": Error de parseo - "), F.col("error")).alias("issue"),
        )
        return stored(found.unionByName(none).unionByName(broken), "issues-of-bank")

    @cached_property
    def counters(self) -> dict:
        """All counters of files, questions, issues and duplicates: one row of numbers."""
        return {
            **stats.file_counts(self.files).head().asDict(), **stats.content_quality(self.questions).head().asDict(),
            "n_issues": self.issues.count(), "n_duplicates": self.n_duplicates,
            "n_descriptions": self.questions.where("type = 'Description'").count(),
        }


def _rows(section: int, rows: DataFrame, order1, order2, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), order1.cast("string").alias("order1"), order2.cast("string").alias("order2"), line.alias("line"))


def _said(spark, section: int, lines: list[str], before: bool = True) -> DataFrame:
    """Lines of a section before its rows, or after them."""
    data = [(section, "" if before else "\x7f\x7f", f"{i:03d}", line) for i, line in enumerate(lines)]
    return spark.createDataFrame(data, "section int, order1 string, order2 string, line string")


def report_lines(bank: Bank) -> DataFrame:
    """(section, order1, order2, line): the report's lines, unsorted; a row can hold several lines."""
    q, n, spark = bank.questions, bank.counters, bank.questions.sparkSession
    most = lambda c: F.format_string("%012d", F.lit(10**11) - F.col(c))
    col, text, none = F.col, F.lit, F.lit("")
    cut = lambda c, length: F.substring(F.coalesce(c, F.lit("")), 1, length)
    parts = [
        _rows(1, stats.type_counts(q), most("n"), col("type"), F.format_string("  %-20s: %5d (%5.1f%%)", "type", "n", "percent")),
        _rows(2, stats.category_counts(q), most("n"), col("category"), F.format_string("  %-60s: %4d", cut(col("category"), 60), col("n"))),
        _rows(3, stats.tag_counts(q), most("n"), col("tag"), F.format_string("  %-30s: %4d", "tag", "n")),
        _rows(5, stats.depth_counts(bank.files, bank.base), F.format_string("%06d", "depth"), none, F.format_string("  Nivel %d: %d archivos", "depth", "n_files")),
        _rows(6, bank.issues, col("filepath"), col("place"), F.concat(text("  "), col("issue"))),
        _rows(7, bank.files.where(~col("success")), col("filepath"), none, F.concat(text("  "), col("filepath"), text("\n    Error: "), col("error"))),
        _rows(8, stats.descriptions(q), col("filepath"), F.format_string("%09d", "ordinal"), F.concat(
            text("  📄 "), col("filepath"), text("\n     Título: "), col("title"),
            F.when(col("text") != "<sin texto>", F.concat(text("\n     Texto: "), cut(F.replace("text", text("\n"), text(" ")), 80), text("..."))).otherwise(""),
            text("\n"),
        )),
        _rows(9, bank.duplicates, F.format_string("%012d", "nth"), none, F.concat(
            F.format_string("Duplicado %d: Similitud = %.3f\n", col("nth") + 1, col("similarity")),
            *(x for name, side in (("A", "a"), ("B", "b")) for x in (
                text(f"  Pregunta {name} ("), col(f"type_{side}"), text("): "), cut(col(f"title_{side}"), 70), text("\n    Archivo: "), col(f"filepath_{side}"), text("\n"),
            )),
            text("  Comando: meld -n '"), col("filepath_a"), text("' '"), col("filepath_b"), text("'\n"),
        )),
    ]
    share = lambda c: f"{n[c] / n['total_questions'] * 100 if n['total_questions'] else 0:.1f}"
    said = {
        0: [f"Total de archivos GIFT: {n['total_files']}", f"  ✅ Archivos válidos: {n['valid_files']}", f"  ❌ Archivos inválidos: {n['invalid_files']}", f"Total de preguntas: {n['total_questions']}"],
        4: [
            f"Preguntas con tags: {n['with_tags']}", f"Preguntas sin tags: {n['without_tags']}", f"Preguntas con feedback global: {n['with_feedback']}",
            f"Preguntas sin feedback global: {n['without_feedback']}", f"Preguntas vacías: {n['empty_questions']}",
        ],
        6: [f"Total de problemas: {n['n_issues']}", ""] if n["n_issues"] else [],
        8: [f"Total: {n['n_descriptions']}", *DESCRIPTION_NOTES, ""] if n["n_descriptions"] else [],
        9: [f"Total de duplicados encontrados: {n['n_duplicates']}", f"Threshold de similitud: {bank.threshold}", ""] if n["n_duplicates"] else [],
        10: [line for wanted, line in (
            (n["without_tags"], f"  • {share('without_tags')}% de preguntas sin tags - considera añadir tags para mejor organización"),
            (n["without_feedback"], f"  • {share('without_feedback')}% de preguntas sin feedback global - el feedback ayuda al aprendizaje"),
            (n["empty_questions"], f"  • {n['empty_questions']} preguntas vacías detectadas - requieren revisión"),
            (n["invalid_files"], f"  • {n['invalid_files']} archivos con errores - necesitan corrección"),
            (n["n_duplicates"], f"  • {n['n_duplicates']} preguntas duplicadas detectadas - considera revisar para eliminar redundancias"),
            (not (n["n_issues"] or n["invalid_files"] or n["n_duplicates"]), WELL),
        ) if wanted],
    }
    parts += [_said(spark, section, lines) for section, lines in said.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in their order as text files whose names sort in that order."""
    order = ["section", "order1", "order2"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def render(bank: Bank) -> str:
    """The report as one text. Its length follows the number of findings, so use it for banks that people read."""
    by_section: dict[int, list[str]] = {}
    for r in report_lines(bank).orderBy("section", "order1", "order2").collect():
        by_section.setdefault(r["section"], []).append(r["line"])
    lines = ["=" * WIDTH, TITLE, "=" * WIDTH, ""]
    for number, heading in enumerate(SECTIONS):
        found = by_section.get(number, [])
        if not found and number in (6, 7, 8, 9):
            continue
        lines += [heading, "-" * WIDTH, *(found or [NOTHING[number]] if number in NOTHING else found)]
        lines += [] if number in (8, 9) else [""]  # their rows end with an empty line each
    return "\n".join([*lines, "=" * WIDTH])


#: The text between the rows of a JSON document; None stands for rows, and names in braces for counters.
JSON_PARTS = [
    '{"stats": {"totalFiles": {total_files}, "validFiles": {valid_files}, "invalidFiles": {invalid_files}, "totalQuestions": {total_questions}, "byType": {',
    None, '}, "byCategory": {', None, '}, "withTags": {with_tags}, "withoutTags": {without_tags}, "byTag": {', None,
    '}, "withFeedback": {with_feedback}, "withoutFeedback": {without_feedback}, "emptyQuestions": {empty_questions}, "parseErrors": [',
    None, '], "filesByDepth": {', None, '}}, "issues": [', None, '], "duplicates": [', None, '], "descriptions": [', None, "]}",
]


def json_lines(bank: Bank) -> DataFrame:
    """(section, order1, order2, line): lines of a JSON document, unsorted; in their order they are one valid document."""
    q, n, spark = bank.questions, bank.counters, bank.questions.sparkSession
    col, none = F.col, F.lit("")
    most = lambda c: F.format_string("%012d", F.lit(10**11) - F.col(c))

    def quoted(c: Column) -> Column:
        both = F.to_json(F.array(F.coalesce(c.cast("string"), F.lit("null"))))
        return F.substr(both, F.lit(2), F.length(both) - 2)

    def entry(key: str, count: str) -> Column:
        return F.concat(quoted(col(key)), F.lit(": "), col(count).cast("string"))

    side = lambda x: F.struct(*(col(f"{c}_{x}").alias(c) for c in ("filepath", "title", "type")))
    rows = [
        _rows(1, stats.type_counts(q), most("n"), col("type"), entry("type", "n")),
        _rows(3, stats.category_counts(q), most("n"), col("category"), entry("category", "n")),
        _rows(5, stats.tag_counts(q), most("n"), col("tag"), entry("tag", "n")),
        _rows(7, bank.files.where(~col("success")), col("filepath"), none, F.to_json(F.struct("filepath", F.struct(col("error").alias("message")).alias("error")))),
        _rows(9, stats.depth_counts(bank.files, bank.base), F.format_string("%06d", "depth"), none, entry("depth", "n_files")),
        _rows(11, bank.issues, col("filepath"), F.concat("place", "issue"), quoted(col("issue"))),
        _rows(13, bank.duplicates, F.format_string("%012d", "nth"), none, F.to_json(F.struct("similarity", side("a").alias("question1"), side("b").alias("question2")))),
        _rows(15, stats.descriptions(q), col("filepath"), F.format_string("%09d", "ordinal"), F.to_json(F.struct("filepath", "title", "text"))),
    ]
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    out = stored(out.withColumn("order1", F.coalesce("order1", F.lit(""))).withColumn("order2", F.coalesce("order2", F.lit(""))), "json-rows")
    numbered = ranked(out.withColumn("order", F.concat_ws("\x01", "order1", "order2", "line")), ["section"], "order")
    comma = F.when(col("nth") > 0, F.concat(F.lit(","), col("line"))).otherwise(col("line"))
    fixed = []
    for i, part in enumerate(JSON_PARTS):
        if part is not None:
            for name, value in n.items():
                part = part.replace(f"{{{name}}}", str(value))
            fixed.append((i, "", "", part))
    return numbered.select("section", F.format_string("%012d", "nth").alias("order1"), F.lit("").alias("order2"), comma.alias("line")).unionByName(
        spark.createDataFrame(fixed, "section int, order1 string, order2 string, line string")
    )


def json_text(bank: Bank) -> str:
    """The JSON document as one text, for banks that people read."""
    rows = json_lines(bank).orderBy("section", "order1", "order2").collect()
    return "\n".join(r["line"] for r in rows)
