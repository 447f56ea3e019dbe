"""The parser: known cases and each quirk of the format."""

import json

import pytest

from aulamill.operators import gift, stats


def parse(spark, *texts):
    files = spark.createDataFrame([(f"f{i}.gift", t) for i, t in enumerate(texts)], "filepath string, content string")
    return gift.parse(files).orderBy("filepath", "ordinal").collect()


def one(spark, text):
    rows = parse(spark, text)
    assert len(rows) == 1
    return rows[0]


def test_title_and_type(spark):
    q = one(spark, "::Title:: Question {=Ans ~Wrong}")
    assert (q.title, q.type, q.stem.text, q.stem.format) == ("Title", "MC", "Question", "moodle")
    assert [(c.is_correct, c.text.text) for c in q.choices] == [(True, "Ans"), (False, "Wrong")]


def test_two_questions(spark):
    assert [(q.title, q.ordinal) for q in parse(spark, "::Q1:: Q1 {=A}\n\n::Q2:: Q2 {=B}")] == [("Q1", 0), ("Q2", 1)]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("X{}", "Essay"),
        ("X{TRUE}", "TF"),
        ("X{false}", "TF"),
        ("X{#5:0}", "Numerical"),
        ("X{####g}", "Numerical"),
        ("X{=a -> 1 =b -> 2}", "Matching"),
        ("X{=a =b}", "Short"),
        ("X{a}", "Short"),
        ("X{=a ~b}", "MC"),
        ("just text", "Description"),
        ("X } y { z", "Essay"),
        ("$CATEGORY: a/b", "Category"),
    ],
)
def test_types(spark, text, kind):
    assert one(spark, text).type == kind


def test_true_false_feedback(spark):
    q = one(spark, "X{TRUE#yes#no}")
    assert (q.is_true, q.true_feedback.text, q.false_feedback.text) == (True, "yes", "no")
    q = one(spark, "X{T#a#b####g}")
    assert (q.global_feedback.text, q.true_feedback.text, q.false_feedback.text) == ("g", "a", "b####g")


def test_matching_pairs(spark):
    pairs = lambda t: [(p.subquestion.text, p.subanswer) for p in one(spark, t).match_pairs]
    assert pairs("X{=a -> 1 =b -> 2}") == [("a", "1"), ("b", "2")]
    assert pairs("X{=a-b -> 1 =c -> 2}") == [("c", "2")]
    assert pairs("X{=p->x ~q}") == [("p", "x")]


def test_numerical(spark):
    q = one(spark, "X{#5:0}")
    assert [(c.is_correct, c.text.text) for c in q.choices] == [(True, "5:0")]
    assert one(spark, "X{####g}").choices[0].text.text == "###g"
    q = one(spark, "X{#=1:0.5#near =%50%2}")
    assert [(c.text.text, c.weight, c.feedback and c.feedback.text) for c in q.choices] == [("1:0.5", None, "near"), ("2", 50.0, None)]


def test_weights_and_feedback(spark):
    q = one(spark, "X{~%50%a ~%50%b ~c}")
    assert [(c.text.text, c.weight) for c in q.choices] == [("a", 50.0), ("b", 50.0), ("c", None)]
    q = one(spark, "X{=a#x = 5 ~b}")
    assert [c.text.text for c in q.choices] == ["a", "5", "b"]
    assert q.choices[0].feedback.text == "x"


def test_embedded_answer_and_format(spark):
    q = one(spark, "[html]A {=b} c")
    assert (q.stem.text, q.stem.format, q.has_embedded_answers, q.type) == ("A _____ c", "html", True, "Short")


def test_comments_carry_over(spark):
    q = one(spark, "// [id:7] [tag:t1] [tag: t2 ]\nX{=a}")
    assert (q.id, q.tags) == ("7", ["t1", "t2"])
    rows = parse(spark, "// [id:1]\n\n$CATEGORY: c\nX{=a}\n// [id:2]\nmore\n\n// [id:9]")
    assert [(r.type, r.id) for r in rows] == [("Category", None), ("Short", "2")]
    assert rows[0].title == "c"
    rows = parse(spark, "A{=a}\n$CATEGORY: x\nB{=b}")
    assert [r.type for r in rows] == ["Short", "Category", "Short"]


def test_escapes(spark):
    q = one(spark, r"A\: b \\n \# {=1}")
    assert q.stem.text == "A: b \\n #"


def test_edges(spark):
    assert parse(spark, "", None, "\n\n// only\n") == []
    long = "palabra " * 20000
    assert one(spark, f"{long}{{=a}}").stem.text == long.strip()
    rows = parse(spark, "::T::Q{=A}\r\n\r\n::U::R{=B}\r")
    assert [r.title for r in rows] == ["T", "U"]


def test_wire_and_summary(spark):
    files = spark.createDataFrame([("a.gift", "// [id:7]\n::T::S{=x ~y####g}\n\nD")], "filepath string, content string")
    questions = gift.parse(files)
    first, second = (json.loads(r.json) for r in gift.wire(questions).orderBy("ordinal").collect())
    assert set(first) == {"type", "title", "stem", "id", "globalFeedback", "choices"}
    assert set(second) == {"type", "stem"}
    rows = gift.summary(questions).orderBy("ordinal").collect()
    assert (rows[0].choicesCount, rows[0].correctChoices, rows[0].hasGlobalFeedback) == (2, 1, True)
    assert (rows[1].choicesCount, rows[1].answersCount) == (None, None)


def test_statistics(spark):
    texts = [
        ("b/a.gift", "$CATEGORY: c\n::Q1:: Text {=A}\n\n// [tag:x] [tag:x]\n::Q2:: Text {~A ~B####f}"),
        ("b/d/e.gift", "X{=a -> 1}\n\nplain"),
        ("b/d/f.gift", ""),
    ]
    files = spark.createDataFrame(texts, "filepath string, content string")
    q = gift.parse(files).cache()
    assert {(r.type, r.n, r.percent) for r in stats.type_counts(q).collect()} == {
        ("Short", 1, 25.0), ("MC", 1, 25.0), ("Matching", 1, 25.0), ("Description", 1, 25.0)
    }
    assert [(r.tag, r.n) for r in stats.tag_counts(q).collect()] == [("x", 2)]
    r = stats.content_quality(q).head()
    assert (r.total_questions, r.with_tags, r.without_tags, r.with_feedback, r.without_feedback, r.empty_questions) == (4, 1, 2, 1, 2, 0)
    assert {(r.issue, r.label) for r in stats.issues(q).collect()} == {
        ("mc_without_correct", "Q2"), ("matching_below_two_pairs", "<sin título>")
    }
    assert {(r.depth, r.n_files) for r in stats.depth_counts(files, "b").collect()} == {(0, 1), (1, 2)}
    assert [r.category for r in stats.category_counts(q).collect()] == ["c"]
    assert len(stats.descriptions(q).collect()) == 1


def test_invalid_files(spark):
    files = spark.createDataFrame(
        [("a.gift", b"X{=a}"), ("b.gift", b"\xff\xfe"), ("c.gift", None)], "filepath string, content binary"
    )
    parsed = stats.parsed_files(files)
    assert {(r.filepath, r.success) for r in parsed.collect()} == {("a.gift", True), ("b.gift", False), ("c.gift", False)}
    counts = stats.file_counts(parsed).head()
    assert (counts.total_files, counts.valid_files, counts.invalid_files) == (3, 1, 2)
    assert [r.filepath for r in stats.files_without_questions(parsed, gift.parse(parsed.where("success"))).collect()] == []
