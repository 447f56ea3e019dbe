"""GIFT text to typed questions.

A file's text is cut into chunks at blank lines and category lines; a chunk
with content is a question. Comments carry over to the next chunk that has
content, which is the only order-dependent step (one window per file). All else
is expressions on the block, so blocks of one file can be parsed on many
executors.

Defined cases: null and empty texts have no questions; comments that no content
follows are lost; braces are found without regard to escapes; what looks like
no known form is a Description.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aulamill.functions.text import BLANK, SPACE, has_text, newlines, replace_all, strip

FORMATTED = "struct<format:string,text:string>"
CHOICES = f"array<struct<is_correct:boolean,weight:double,text:{FORMATTED},feedback:{FORMATTED}>>"
PAIRS = f"array<struct<subquestion:{FORMATTED},subanswer:string>>"

# Escapes and what they stand for; the first protects a doubled backslash until the last.
ESCAPES = [
    ("\\\\", "\x00"), ("\\:", ":"), ("\\#", "#"), ("\\=", "="), ("\\{", "{"), ("\\}", "}"), ("\\~", "~"), ("\\n", "\n"), ("\x00", "\\"),
]

# The forms of a weight, of a true/false answer with its feedback, of where that is parted, and of a pair.
WEIGHT = r"%[+-]?\d+(?:\.\d+)?%"
TRUE_FALSE = rf"(?is)^(TRUE|FALSE|T|F){SPACE}*(?:#(.*))?\z"
FEEDBACK_SPLIT = r"(?<!#)#(?!###)"
PAIR = rf"=([^->=~]*)->{SPACE}*([^=~\n\r]+)"


def unescape(text: Column) -> Column:
    return replace_all(text, ESCAPES)


def formatted(text: Column) -> Column:
    return F.struct(F.lit("moodle").alias("format"), unescape(strip(text)).alias("text"))


def blocks(files: DataFrame, path: str = "filepath", content: str = "content") -> DataFrame:
    """(filepath, place, category, text, comments): one row per question block and category; place orders them."""
    own_line = F.regexp_replace(
        newlines(F.col(content)), rf"(?md)^({BLANK}*\$CATEGORY:[^\n]*)$", "\n\n$1\n\n"
    )
    # No pattern here repeats a group: Java does that by recursion, which a long text would end with its stack.
    emptied = F.regexp_replace(own_line, rf"(?md)^{BLANK}+$", "")
    chunks = files.select(F.col(path).alias("filepath"), F.posexplode(F.split(emptied, r"\n{2,}", -1)).alias("pos", "chunk"))
    lines = F.filter(F.split("chunk", "\n", -1), has_text)
    chunks = chunks.select(
        "filepath",
        "pos",
        F.filter(lines, lambda s: ~s.rlike(rf"^{SPACE}*//")).alias("body"),
        F.transform(
            F.filter(lines, lambda s: s.rlike(rf"^{SPACE}*//")), lambda s: F.substr(strip(s), F.lit(3))
        ).alias("comments"),
    )
    is_category = (F.size("body") == 1) & F.try_element_at("body", F.lit(1)).rlike(rf"^{SPACE}*\$CATEGORY:")
    chunks = chunks.withColumn("category", F.coalesce(is_category, F.lit(False)))
    taker = (F.size("body") > 0) & ~F.col("category")
    # The next chunk with content takes the comments of those before it that have none. A frame that grows from
    # the end costs one step a row; one that reaches to the end would be read anew for each.
    ahead = Window.partitionBy("filepath").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goes_to = F.last(F.when(taker, F.col("pos")), ignorenulls=True).over(ahead)
    chunks = chunks.withColumn("goes_to", F.when(F.col("category"), F.col("pos")).otherwise(goes_to))
    held = (
        chunks.where((F.size("body") > 0) | ((F.size("comments") > 0) & F.col("goes_to").isNotNull()))
        .groupBy("filepath", "goes_to")
        .agg(
            F.max_by("body", F.size("body")).alias("body"),
            F.bool_or("category").alias("category"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "comments"))), lambda x: x["comments"])).alias(
                "comments"
            ),
        )
    )
    return held.select(
        "filepath", F.col("goes_to").alias("place"), "category", F.array_join("body", "\n").alias("text"), "comments"
    )


def _parts(segments: Column, gap: str) -> Column:
    form = rf"(?s)^([=~]){gap}({WEIGHT})?{gap}([^#]*)(?:#(.*))?\z"
    return F.transform(
        segments,
        lambda s: F.struct(
            s.startswith("=").alias("is_correct"),
            F.regexp_extract(s, form, 2).alias("weight"),
            F.regexp_extract(s, form, 3).alias("text"),
            F.regexp_extract(s, form, 4).alias("feedback"),
        ),
    )


def _choices(found: DataFrame) -> DataFrame:
    """Adds ``choices`` from ``kind`` and ``cut``; each step is a column, so none is computed twice."""
    numerical, cut = F.col("kind") == "Numerical", F.col("cut")
    raw = lambda t: F.when(has_text(t), F.struct(F.lit("moodle").alias("format"), strip(t).alias("text")))
    found = found.withColumn(
        "segments", F.when(F.col("kind").isin("Numerical", "choice"), F.regexp_extract_all(cut, F.lit("[=~][^=~]*"), F.lit(0)))
    )
    segments = F.col("segments")
    found = found.withColumn(
        "parts",
        F.when(numerical, _parts(segments, "")).otherwise(
            F.filter(_parts(segments, f"{SPACE}*"), lambda p: has_text(p["text"]))
        ),
    )
    choice = lambda value: lambda p: F.struct(
        p["is_correct"].alias("is_correct"),
        F.when(p["weight"] != "", F.replace(p["weight"], F.lit("%"), F.lit("")).cast("double")).alias("weight"),
        value(p["text"]).alias("text"),
        F.when(p["feedback"] != "", formatted(p["feedback"])).alias("feedback"),
    )
    whole = F.array(
        F.struct(
            F.lit(True).alias("is_correct"),
            F.lit(None).cast("double").alias("weight"),
            F.when(numerical, raw(cut)).otherwise(formatted(cut)).alias("text"),
            F.lit(None).cast(FORMATTED).alias("feedback"),
        )
    )
    chosen = F.when(numerical, F.transform("parts", choice(raw))).otherwise(F.transform("parts", choice(formatted)))
    choices = F.when(F.size("parts") > 0, chosen).when(segments.isNotNull() & has_text(cut), whole)
    return found.withColumn("choices", choices.cast(CHOICES))


def parse_blocks(found: DataFrame) -> DataFrame:
    """Typed questions of ``blocks``."""
    text = F.col("text")
    # A title goes from two colons, which no third follows, to the next two; single ones belong to it.
    marked = text.startswith("::") & ~text.startswith(":::")
    found = found.withColumn("title_end", F.when(marked, F.locate("::", text, 3)).otherwise(0))
    end = F.col("title_end")
    found = found.withColumn(
        "title",
        F.when(F.col("category"), strip(F.substr(strip(text), F.lit(11)))).otherwise(
            F.when(end > 0, strip(F.substr(text, F.lit(3), end - 3)))
        ),
    ).withColumn("rest", F.when(end > 0, F.substr(text, end + 2)).otherwise(text))
    rest = F.col("rest")
    first = F.instr(rest, "{")
    last = F.length(rest) + 1 - F.instr(F.reverse(rest), "}")  # position of the last one
    found = found.withColumn("has_block", (first > 0) & rest.contains("}")).withColumns(
        {
            "before": strip(F.substr(rest, F.lit(1), first - 1)),
            "answers": strip(F.when(last > first, F.substr(rest, first + 1, last - first - 1)).otherwise("")),
            "after": strip(F.substr(rest, last + 1)),
        }
    )
    before, after = F.col("before"), F.col("after")
    stem_form = r"(?s)^\[(html|markdown|plain|moodle)\](.*)\z"
    prefixed = before.rlike(stem_form)
    stem_text = F.when(prefixed, F.regexp_extract(before, stem_form, 2)).otherwise(before)
    stem_text = F.when(after != "", F.concat(stem_text, F.lit(" _____ "), after)).otherwise(stem_text)
    stem = F.when(
        F.col("has_block"),
        F.struct(
            F.when(prefixed, F.regexp_extract(before, stem_form, 1)).otherwise("moodle").alias("format"),
            unescape(strip(stem_text)).alias("text"),
        ),
    ).otherwise(formatted(rest))
    answers = F.col("answers")
    kind = (
        F.when(F.col("category"), "Category")
        .when(~F.col("has_block"), "Description")
        .when(answers == "", "Essay")
        .when(answers.rlike(TRUE_FALSE), "TF")
        .when(answers.startswith("#"), "Numerical")
        .when(answers.contains("->"), "Matching")
        .otherwise("choice")
    )
    # The generator keeps a later filter on a parsed column from being pushed down as copies of the steps so far.
    first_part = F.struct(
        "category", "title", "has_block", "answers", "after", kind.alias("kind"), F.when(~F.col("category"), stem).alias("stem")
    )
    found = found.select("filepath", "place", "comments", F.inline(F.array(first_part)))
    kind = F.col("kind")
    # The leading # of a numerical block is not part of it.
    found = found.withColumn("inner", F.when(kind == "Numerical", F.substr(answers, F.lit(2))).otherwise(answers))
    is_tf, has_choices = kind == "TF", kind.isin("Numerical", "choice")
    found = found.withColumns(
        {
            "overall": F.when(
                is_tf | has_choices | (kind == "Matching"), F.regexp_extract("inner", r"(?s)####(.+)\z", 1)
            ),
            "cut": F.regexp_replace("inner", r"(?s)####.+\z", ""),
        }
    )
    tf_notes = F.filter(
        F.split(F.regexp_extract(answers, TRUE_FALSE, 2), FEEDBACK_SPLIT, -1),
        lambda p: has_text(p) & ~strip(p).startswith("###"),
    )
    pairs = F.when(
        kind == "Matching",
        F.zip_with(
            F.regexp_extract_all("cut", F.lit(PAIR), F.lit(1)),
            F.regexp_extract_all("cut", F.lit(PAIR), F.lit(2)),
            lambda a, b: F.struct(formatted(a).alias("subquestion"), unescape(strip(b)).alias("subanswer")),
        ),
    )
    found = _choices(found).withColumns(
        {
            "pairs": pairs.cast(PAIRS),
            "notes": F.when(is_tf, tf_notes),
            "tags": F.flatten(
                F.transform(
                    "comments",
                    lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\[tag:([^\]]+)\]"), F.lit(1)), strip),
                )
            ),
            "ids": F.filter(
                F.transform("comments", lambda c: F.regexp_extract(c, r"\[id:([^\]]+)\]", 1)), lambda x: x != ""
            ),
        }
    )
    mc = F.when(F.forall("choices", lambda c: c["is_correct"]), "Short").otherwise("MC")
    chosen = F.when(kind != "choice", kind).when(F.col("choices").isNull(), "Essay").otherwise(mc)
    note = lambda i: F.when(F.size("notes") >= i, formatted(F.try_element_at("notes", F.lit(i))))
    plain = ~F.col("category")
    typed = found.select(
        "filepath",
        "place",
        chosen.alias("type"),
        F.nullif("title", F.lit("")).alias("title"),
        "stem",
        F.when(plain, strip(F.try_element_at("ids", F.lit(-1)))).alias("id"),
        F.when(plain & (F.size("tags") > 0), F.col("tags")).alias("tags"),
        (F.col("has_block") & (after != "") & plain).alias("has_embedded_answers"),
        F.when(F.col("overall") != "", formatted(F.col("overall"))).alias("global_feedback"),
        "choices",
        F.when(F.size("pairs") > 0, F.col("pairs")).alias("match_pairs"),
        F.when(is_tf, answers.rlike("(?i)^T")).alias("is_true"),
        note(1).alias("true_feedback"),
        note(2).alias("false_feedback"),
    )
    order = Window.partitionBy("filepath").orderBy("place")
    numbered = typed.withColumn("ordinal", F.row_number().over(order) - 1)
    return numbered.select("filepath", "ordinal", *typed.columns[2:])


def parse(files: DataFrame, path: str = "filepath", content: str = "content") -> DataFrame:
    """Typed questions of GIFT files given as (path, content)."""
    return parse_blocks(blocks(files, path, content))


def wire(questions: DataFrame) -> DataFrame:
    """(filepath, ordinal, json): each question as JSON with the wire names, empty fields left out.

    Stored tables may name the fields of their structs otherwise.
    """
    full = lambda c, kind: F.when(F.size(c) > 0, F.col(c)).cast(kind)
    text = lambda c: F.col(c).cast(FORMATTED)
    return questions.select(
        "filepath",
        "ordinal",
        F.to_json(
            F.struct(
                "type",
                F.nullif("title", F.lit("")).alias("title"),
                text("stem").alias("stem"),
                F.nullif("id", F.lit("")).alias("id"),
                full("tags", "array<string>").alias("tags"),
                F.when(F.col("has_embedded_answers"), F.lit(True)).alias("hasEmbeddedAnswers"),
                text("global_feedback").alias("globalFeedback"),
                full("choices", CHOICES).alias("choices"),
                full("match_pairs", PAIRS).alias("matchPairs"),
                F.col("is_true").alias("isTrue"),
                text("true_feedback").alias("trueFeedback"),
                text("false_feedback").alias("falseFeedback"),
            )
        ).alias("json"),
    )


def summary(questions: DataFrame) -> DataFrame:
    """What a listing shows of each question; counts only where the type has them."""
    length = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    kind, n, pairs = F.col("type"), length("choices"), length("match_pairs")
    return questions.select(
        "filepath",
        "ordinal",
        "type",
        "title",
        "id",
        F.coalesce("tags", F.expr("cast(array() as array<string>)")).alias("tags"),
        F.col("global_feedback").isNotNull().alias("hasGlobalFeedback"),
        F.coalesce("has_embedded_answers", F.lit(False)).alias("hasEmbeddedAnswers"),
        F.when(kind == "MC", n).alias("choicesCount"),
        F.when(kind == "MC", length(F.filter("choices", lambda c: c["is_correct"]))).alias("correctChoices"),
        F.when(kind == "TF", F.col("is_true")).alias("isTrue"),
        F.when(kind == "Matching", pairs).alias("matchPairsCount"),
        F.when(kind.isin("Short", "Numerical"), n).alias("answersCount"),
    )
