"""The core's driver queries, each over whole tables, and their SQL for comparison."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aulamill.functions import text as X
from aulamill.operators import enrich, gift, rawcsv, similar, stats
from aulamill.operators.work import stored
from aulamill.plans import changes, report
from aulamill.sources.files import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: White space as a class that Java and RE2 read alike.
S = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
STRIP = rf"'^{S}+|{S}+$', '', 'g'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return stats.from_table(read_table(spark, d, "questions"))


def _documents(spark: SparkSession, d: str, *formats: str) -> DataFrame:
    """Documents as files: (doc_id, filepath, content)."""
    docs = read_table(spark, d, "documents").where("text is not null")
    if formats:
        docs = docs.where(F.col("fmt").isin(*formats))
    return docs.select(
        "doc_id", F.concat(F.lit("docs/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".gift")).alias("filepath"),
        F.col("text").alias("content"),
    )


def _doc_id() -> F.Column:
    return F.regexp_extract("filepath", r"(\d+)\.gift$", 1).cast("long").alias("doc_id")


# ---- statistics -----------------------------------------------------------


@query(
    """select qtype as type, count(*) as n,
    round(count(*)::double / (sum(count(*)) over ())::double * 100, 6) as percent
    from questions where qtype <> 'Category' group by qtype"""
)
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.type_counts(_questions(spark, d))


@query(
    """select coalesce(nullif(title, ''), 'Sin categoría') as category, count(*) as n, count(distinct filepath) as n_files
    from questions where qtype = 'Category' group by 1"""
)
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.category_counts(_questions(spark, d))


@query(
    """select coalesce(nullif(title, ''), 'Sin categoría') as category, filepath, count(*) as n
    from questions where qtype = 'Category' group by 1, 2"""
)
def category_files(spark: SparkSession, d: str) -> DataFrame:
    return stats.category_files(_questions(spark, d))


@query(
    """select tag, count(*) as n from (select unnest(tags) as tag from questions
    where qtype not in ('Category', 'Description')) group by tag"""
)
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.tag_counts(_questions(spark, d))


@query(
    """select count(*) filter (qtype <> 'Category') as total_questions,
    count(*) filter (c and coalesce(len(tags), 0) > 0) as with_tags,
    count(*) filter (c and coalesce(len(tags), 0) = 0) as without_tags,
    count(*) filter (c and global_feedback is not null) as with_feedback,
    count(*) filter (c and global_feedback is null) as without_feedback,
    count(*) filter (c and coalesce(title, '') = '' and coalesce(stem.text, '') = '') as empty_questions
    from (select *, qtype not in ('Category', 'Description') as c from questions)"""
)
def content_quality(spark: SparkSession, d: str) -> DataFrame:
    return stats.content_quality(_questions(spark, d))


@query(
    """select length(filepath) - length(replace(filepath, '/', '')) as depth, count(*) as n_files
    from (select distinct filepath from questions) group by 1"""
)
def depth_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.depth_counts(read_table(spark, d, "questions").select("filepath").distinct())


@query(
    """with q as (select *, coalesce(len(list_filter(choices, lambda c: c.is_correct)), 0) as correct,
      coalesce(list_sum(list_transform(list_filter(choices, lambda c: c.is_correct or coalesce(c.weight > 0, false)),
        lambda c: coalesce(c.weight, case when c.is_correct then 100.0 else 0.0 end))), 0) as total
      from questions where qtype not in ('Category', 'Description'))
    select filepath, ordinal, issue, coalesce(nullif(title, '')[1:50], '<sin título>') as label from (
      select *, unnest(list_filter([
        case when coalesce(title, '') = '' and coalesce(stem.text, '') = '' then 'empty' end,
        case when qtype = 'MC' and correct = 0 and total < 95 then 'mc_without_correct'
          when qtype = 'Matching' and coalesce(len(match_pairs), 0) < 2 then 'matching_below_two_pairs'
          when qtype = 'Short' and coalesce(len(choices), 0) = 0 then 'short_without_answers' end
      ], lambda x: x is not null)) as issue from q)"""
)
def question_issues(spark: SparkSession, d: str) -> DataFrame:
    return stats.issues(_questions(spark, d))


@query(
    """select filepath, ordinal, coalesce(nullif(title, ''), '<sin título>') as title,
    coalesce(nullif(stem.text, '')[1:100], '<sin texto>') as text from questions where qtype = 'Description'"""
)
def description_texts(spark: SparkSession, d: str) -> DataFrame:
    return stats.descriptions(_questions(spark, d))


@query(
    """select filepath, ordinal, qtype as type, title, id, coalesce(array_to_string(tags, '|'), '') as tags,
    global_feedback is not null as hasGlobalFeedback, coalesce(has_embedded_answers, false) as hasEmbeddedAnswers,
    case when qtype = 'MC' then coalesce(len(choices), 0) end as choicesCount,
    case when qtype = 'MC' then coalesce(len(list_filter(choices, lambda c: c.is_correct)), 0) end as correctChoices,
    case when qtype = 'TF' then is_true end as isTrue,
    case when qtype = 'Matching' then coalesce(len(match_pairs), 0) end as matchPairsCount,
    case when qtype in ('Short', 'Numerical') then coalesce(len(choices), 0) end as answersCount
    from questions"""
)
def question_summary(spark: SparkSession, d: str) -> DataFrame:
    return gift.summary(_questions(spark, d)).withColumn("tags", F.array_join("tags", "|"))


FULL_TEXT = """select question_id, filepath, ordinal, coalesce(title, '') || ' ' || coalesce(stem.text, '') || ' ' ||
    array_to_string(list_concat(
      coalesce(list_transform(list_filter(choices, lambda c: c.text is not null), lambda c: coalesce(c.text.text, '')), []),
      coalesce(flatten(list_transform(match_pairs, lambda p: [coalesce(p.subquestion.text, ''), coalesce(p.subanswer, '')])), [])
    ), ' ') as full_text from questions where qtype not in ('Category', 'Description')"""


@query(FULL_TEXT)
def full_texts(spark: SparkSession, d: str) -> DataFrame:
    return stats.full_texts(_questions(spark, d))


@query(
    """select question_id, json_extract_string(payload, '$.type') as type, json_extract_string(payload, '$.title') as title,
    json_extract_string(payload, '$.stem.format') as stem_format, json_extract_string(payload, '$.stem.text') as stem_text,
    json_extract_string(payload, '$.id') as id,
    coalesce(json_array_length(payload, '$.tags'), 0)::bigint as n_tags,
    coalesce(json_array_length(payload, '$.choices'), 0)::bigint as n_choices from question_wire"""
)
def wire_fields(spark: SparkSession, d: str) -> DataFrame:
    schema = "type string, title string, stem struct<format string, text string>, id string, tags array<string>, choices array<string>"
    rows = read_table(spark, d, "question_wire").select("question_id", F.from_json("payload", schema).alias("q"))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return rows.select(
        "question_id", "q.type", "q.title", F.col("q.stem.format").alias("stem_format"), F.col("q.stem.text").alias("stem_text"),
        "q.id", n("q.tags").alias("n_tags"), n("q.choices").alias("n_choices"),
    )


def _object_sql(*fields: tuple[str, str]) -> str:
    """A JSON object of (name, SQL of its JSON), without those that are null."""
    listed = ", ".join(f"'\"{name}\":' || {value}" for name, value in fields)
    return f"'{{' || array_to_string(list_filter([{listed}], lambda z: z is not null), ',') || '}}'"


def _formatted_sql(column: str) -> str:
    return f"case when {column} is not null then {_object_sql(('format', f'to_json({column}.fmt)'), ('text', f'to_json({column}.text)'))} end"


def _list_sql(column: str, name: str, each: str) -> str:
    return f"case when len({column}) > 0 then '[' || array_to_string(list_transform({column}, lambda {name}: {each}), ',') || ']' end"


CHOICE_JSON = _object_sql(
    ("is_correct", "c.is_correct::varchar"), ("weight", "to_json(c.weight)"), ("text", _formatted_sql("c.text")), ("feedback", _formatted_sql("c.feedback"))
)
PAIR_JSON = _object_sql(("subquestion", _formatted_sql("p.subquestion")), ("subanswer", "to_json(p.subanswer)"))
WIRE_JSON = _object_sql(
    ("type", "to_json(qtype)"), ("title", "to_json(nullif(title, ''))"), ("stem", _formatted_sql("stem")), ("id", "to_json(nullif(id, ''))"),
    ("tags", "case when len(tags) > 0 then to_json(tags) end"), ("hasEmbeddedAnswers", "case when has_embedded_answers then 'true' end"),
    ("globalFeedback", _formatted_sql("global_feedback")), ("choices", _list_sql("choices", "c", CHOICE_JSON)), ("matchPairs", _list_sql("match_pairs", "p", PAIR_JSON)),
    ("isTrue", "is_true::varchar"), ("trueFeedback", _formatted_sql("true_feedback")), ("falseFeedback", _formatted_sql("false_feedback")),
)


@query(f"select filepath, ordinal, {WIRE_JSON} as json from questions")
def wire_json(spark: SparkSession, d: str) -> DataFrame:
    """Stored questions in the JSON wire form."""
    return gift.wire(_questions(spark, d))


# ---- GIFT parsing of the documents ----------------------------------------

#: Blocks of GIFT documents as the parser cuts them, where a comment lies in its question's block.
BLOCKS_SQL = rf"""
    docs as (select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as text
      from documents where fmt = 'gift' and text is not null),
    chunk as (select doc_id, unnest(string_split(regexp_replace(text, '\n([\t\x0b-\r\x1c-\x20\x{{85}}\p{{Z}}]*\n)+', chr(1), 'g'), chr(1))) as chunk,
      unnest(range(len(string_split(regexp_replace(text, '\n([\t\x0b-\r\x1c-\x20\x{{85}}\p{{Z}}]*\n)+', chr(1), 'g'), chr(1))))) as pos from docs),
    line as (select doc_id, pos, list_filter(string_split(chunk, chr(10)), lambda s: regexp_matches(s, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]')) as lines from chunk),
    body as (select doc_id, pos, list_filter(lines, lambda s: not regexp_matches(s, '^{S}*//')) as body,
      list_transform(list_filter(lines, lambda s: regexp_matches(s, '^{S}*//')), lambda s: substr(regexp_replace(s, '^{S}+', ''), 3)) as comments from line),
    block as (select doc_id, row_number() over (partition by doc_id order by pos) - 1 as ordinal,
      array_to_string(body, chr(10)) as text, array_to_string(comments, chr(10)) as comments from body where len(body) > 0)"""
PARTS_SQL = rf"""{BLOCKS_SQL},
    titled as (select doc_id, ordinal, comments,
      case when regexp_matches(text, '(?s)^::[^:]+(?::[^:]+)*::') then regexp_extract(text, '(?s)^::([^:]+(?::[^:]+)*)::', 1) end as title,
      case when regexp_matches(text, '(?s)^::[^:]+(?::[^:]+)*::') then regexp_replace(text, '(?s)^::[^:]+(?::[^:]+)*::', '') else text end as rest from block),
    parts as (select *, instr(rest, '{{') > 0 and instr(rest, '}}') > 0 as has_block,
      regexp_replace(regexp_extract(rest, '(?s)^[^{{]*\{{(.*)\}}[^}}]*$', 1), '^{S}+|{S}+$', '', 'g') as answers from titled),
    kinds as (select *, case when not has_block then 'Description' when answers = '' then 'Essay'
      when regexp_matches(answers, '(?is)^(TRUE|FALSE|T|F){S}*(#.*)?$') then 'TF'
      when answers[1:1] = '#' then 'Numerical' when contains(answers, '->') then 'Matching' else 'choice' end as kind,
      regexp_replace(answers, '(?s)####.+$', '') as cut from parts),
    segs as (select *, list_filter(regexp_extract_all(cut, '[=~][^=~]*'),
      lambda s: regexp_matches(regexp_replace(regexp_replace(s, '(?s)#.*$', ''), '^[=~]{S}*(%[+-]?\d+(\.\d+)?%)?', ''), '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]')) as seg from kinds)"""
TYPE_SQL = """case when kind <> 'choice' then kind when len(seg) = 0 and not regexp_matches(cut, '\\S') then 'Essay'
      when len(list_filter(seg, lambda s: s[1:1] <> '=')) = 0 then 'Short' else 'MC' end"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return gift.parse(_documents(spark, d, "gift"))


@query(
    rf"""with {PARTS_SQL} select type, count(*) as n, round(count(*)::double / (sum(count(*)) over ())::double * 100, 6) as percent
    from (select {TYPE_SQL} as type from segs) group by type"""
)
def gift_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.type_counts(_parsed(spark, d))


@query(
    rf"""with {PARTS_SQL} select doc_id, ordinal::int as ordinal, {TYPE_SQL} as type,
    nullif(regexp_replace(title, '^{S}+|{S}+$', '', 'g'), '') as title,
    array_to_string(list_transform(regexp_extract_all(comments, '\[tag:([^\]]+)\]', 1), lambda t: regexp_replace(t, '^{S}+|{S}+$', '', 'g')), '|') as tags
    from segs"""
)
def gift_questions(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select(
        _doc_id(), "ordinal", "type", "title", F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags")
    )


#: The text of a choice without its sign, weight and feedback.
CHOICE_TEXT = rf"regexp_replace(regexp_replace(regexp_replace(s, '(?s)#.*$', ''), '^[=~]{S}*(%[+-]?\d+(\.\d+)?%)?', ''), {STRIP})"
#: Escapes undone, as a chain for one text.
UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace(replace({}, chr(92) || chr(92), chr(1)), chr(92) || ':', ':'), chr(92) || '#', '#'), chr(92) || '=', '='), chr(92) || '{{', '{{'), chr(92) || '}}', '}}'), chr(92) || '~', '~'), chr(92) || 'n', chr(10)), chr(1), chr(92))"


@query(
    rf"""with {PARTS_SQL} select doc_id, ordinal::int as ordinal, (n - 1)::int as pos, s[1:1] = '=' as is_correct,
    try_cast(nullif(replace(regexp_extract(s, '^[=~]{S}*(%[+-]?\d+(?:\.\d+)?%)?', 1), '%', ''), '') as double) as weight,
    {UNESCAPE.format(CHOICE_TEXT)} as text
    from (select *, unnest(seg) as s, unnest(range(1, len(seg) + 1)) as n from segs where kind = 'choice')
    union all select doc_id, ordinal::int, 0, true, null, {UNESCAPE.format(f"regexp_replace(cut, {STRIP})")} from segs
    where kind = 'choice' and len(seg) = 0 and regexp_matches(cut, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]')"""
)
def gift_choices(spark: SparkSession, d: str) -> DataFrame:
    """Choices of multiple-choice and short questions."""
    rows = _parsed(spark, d).where("type in ('MC', 'Short')").select(_doc_id(), "ordinal", F.posexplode("choices").alias("pos", "c"))
    return rows.select("doc_id", "ordinal", "pos", "c.is_correct", "c.weight", F.col("c.text.text").alias("text"))


@query(
    rf"""with {PARTS_SQL} select doc_id, ordinal::int as ordinal, (n - 1)::int as pos,
    regexp_replace(l, '^{S}+|{S}+$', '', 'g') as subquestion, regexp_replace(r, '^{S}+|{S}+$', '', 'g') as subanswer from (
      select *, unnest(regexp_extract_all(cut, '={S}*([^->=~]*?){S}*->{S}*([^=~\n\r]+)', 1)) as l,
      unnest(regexp_extract_all(cut, '={S}*([^->=~]*?){S}*->{S}*([^=~\n\r]+)', 2)) as r,
      unnest(range(1, len(regexp_extract_all(cut, '={S}*([^->=~]*?){S}*->{S}*([^=~\n\r]+)')) + 1)) as n from segs where kind = 'Matching')"""
)
def gift_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _parsed(spark, d).where("type = 'Matching'").select(_doc_id(), "ordinal", F.posexplode("match_pairs").alias("pos", "p"))
    return rows.select("doc_id", "ordinal", "pos", F.col("p.subquestion.text").alias("subquestion"), F.col("p.subanswer").alias("subanswer"))


#: Stems of blocks: the text around the answers, and the format it names.
STEMS_SQL = rf"""{PARTS_SQL},
    around as (select *, regexp_replace(case when has_block then regexp_extract(rest, '(?s)^([^{{]*)\{{', 1) else rest end, {STRIP}) as before,
      case when has_block then regexp_replace(regexp_extract(rest, '(?s)\}}([^}}]*)$', 1), {STRIP}) else '' end as after from segs),
    stems as (select *, case when has_block and regexp_matches(before, '^\[(?:html|markdown|plain|moodle)\]') then regexp_extract(before, '^\[([a-z]+)\]', 1) else 'moodle' end as format,
      case when has_block then regexp_replace(before, '^\[(?:html|markdown|plain|moodle)\]', '') else before end || case when after <> '' then ' _____ ' || after else '' end as stem from around)"""


@query(
    rf"""with {STEMS_SQL} select doc_id, ordinal::int as ordinal, format, {UNESCAPE.format(f"regexp_replace(stem, {STRIP})")} as text, has_block and after <> '' as embedded,
    regexp_replace(regexp_extract_all(comments, '\[id:([^\]]+)\]', 1)[-1], {STRIP}) as id from stems"""
)
def gift_stems(spark: SparkSession, d: str) -> DataFrame:
    """The stem of each question with its format, whether answers stand in it, and the id its comments give."""
    return _parsed(spark, d).select(
        _doc_id(), "ordinal", F.col("stem.format").alias("format"), F.col("stem.text").alias("text"), F.col("has_embedded_answers").alias("embedded"), "id"
    )


@query(
    rf"""with built as (select question_id, array_to_string(list_transform(list_filter(choices, lambda c: c.text.text is not null), lambda c: case when c.is_correct then '=' else '~' end
      || coalesce('%' || c.weight || '%', '') || c.text.text || coalesce('#' || c.feedback.text, '')), ' ') as cut from questions where qtype = 'Numerical'),
    seg as (select *, regexp_extract_all(regexp_replace(cut, '(?s)####.+$', ''), '[=~][^=~]*') as s from built)
    select question_id, (n - 1)::int as pos, s[n][1:1] = '=' as is_correct,
    try_cast(nullif(replace(regexp_extract(s[n], '^[=~](%[+-]?\d+(?:\.\d+)?%)?', 1), '%', ''), '') as double) as weight,
    nullif(regexp_replace(regexp_replace(regexp_replace(s[n], '(?s)#.*$', ''), '^[=~](%[+-]?\d+(\.\d+)?%)?', ''), {STRIP}), '') as text
    from (select *, unnest(range(1, len(s) + 1)) as n from seg)"""
)
def gift_numerical(spark: SparkSession, d: str) -> DataFrame:
    """Stored numerical questions written as GIFT and parsed again: choices as text."""
    each = F.transform(
        F.filter("choices", lambda c: c["text"]["text"].isNotNull()),
        lambda c: F.concat(
            F.when(c["is_correct"], "=").otherwise("~"),
            F.coalesce(F.concat(F.lit("%"), c["weight"].cast("string"), F.lit("%")), F.lit("")),
            c["text"]["text"],
            F.coalesce(F.concat(F.lit("#"), c["feedback"]["text"]), F.lit("")),
        ),
    )
    built = read_table(spark, d, "questions").where("qtype = 'Numerical'").select("question_id", F.array_join(each, " ").alias("cut"))
    files = built.select(
        F.col("question_id").cast("string").alias("filepath"), F.concat(F.lit("N {#"), "cut", F.lit("}")).alias("content")
    )
    rows = gift.parse(files).where("type = 'Numerical'").select(F.col("filepath").cast("long").alias("question_id"), F.posexplode("choices").alias("pos", "c"))
    return rows.select("question_id", "pos", "c.is_correct", "c.weight", F.col("c.text.text").alias("text"))


@query(
    rf"""with {PARTS_SQL}, tf as (select doc_id, ordinal, answers, regexp_extract(answers, '(?is)^(?:TRUE|FALSE|T|F){S}*#(.*)$', 1) as said from kinds where kind = 'TF'),
    notes as (select *, list_filter(list_transform(string_split(replace(said, '####', chr(2)), '#'), lambda p: regexp_replace(replace(p, chr(2), '####'), {STRIP})),
      lambda p: p <> '' and p[1:3] <> '###') as note from tf)
    select doc_id, ordinal::int as ordinal, upper(answers[1:1]) = 'T' as is_true, {UNESCAPE.format("note[1]")} as true_feedback, {UNESCAPE.format("note[2]")} as false_feedback,
    {UNESCAPE.format(f"nullif(regexp_replace(regexp_extract(answers, '(?s)####(.+)$', 1), {STRIP}), '')")} as global_feedback from notes"""
)
def gift_feedback(spark: SparkSession, d: str) -> DataFrame:
    """True/false questions with their feedback."""
    return _parsed(spark, d).where("type = 'TF'").select(
        _doc_id(), "ordinal", "is_true", F.col("true_feedback.text").alias("true_feedback"),
        F.col("false_feedback.text").alias("false_feedback"), F.col("global_feedback.text").alias("global_feedback"),
    )


# ---- similarity -----------------------------------------------------------

CLEAN = "trim(regexp_replace(lower({}), '[^a-záéíóúñü0-9]+', ' ', 'g'))"
DOC_WORDS = f"""
    clean as (select doc_id as id, {CLEAN.format("text")} as clean from documents where text is not null),
    tok as (select id, unnest(list_filter(string_split(clean, ' '), lambda w: w <> '')) as word from clean),
    n as (select count(*)::double as n from clean),
    df as (select word, count(distinct id) as df from tok group by word)"""


def _clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return similar.cleaned(read_table(spark, d, "documents"), "doc_id", "text")


def _clean_questions(spark: SparkSession, d: str) -> DataFrame:
    return similar.cleaned(stats.full_texts(_questions(spark, d)), "question_id", "full_text")


@query(f"select doc_id as id, {CLEAN.format('text')} as clean from documents where text is not null")
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return _clean_documents(spark, d)


@query(
    f"""with {DOC_WORDS} select c.id, coalesce(t.n, 0)::bigint as n_tokens, coalesce(t.w, 0)::bigint as n_words from clean c
    left join (select id, count(*) as n, count(distinct word) as w from tok group by id) t using (id)"""
)
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return similar.token_counts(_clean_documents(spark, d))


@query(f"with {DOC_WORDS} select word, df, round(ln(n / (1.0 + df)), 9) as idf from df, n")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return similar.doc_freq(_clean_documents(spark, d)).select("word", "df", F.round("idf", 9).alias("idf"))


@query(
    f"""with {DOC_WORDS}, keep as (select min(id) as id from clean group by clean),
    cnt as (select id, word, count(*) as c, sum(count(*)) over (partition by id) as total from tok where id in (select id from keep) group by id, word)
    select id as class_id, word, round(c::double / total::double, 9) as tf, round(c::double / total::double * ln(n / (1.0 + df)), 9) as tfidf
    from cnt join df using (word), n"""
)
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return similar.weights(_clean_documents(spark, d)).select(
        "class_id", "word", F.round("tf", 9).alias("tf"), F.round("tfidf", 9).alias("tfidf")
    )


WORD_VECTORS = f"""
    clean as (select question_id as id, {CLEAN.format("full_text")} as clean from texts),
    class as (select clean, min(id) as id, count(*) as m from clean group by clean),
    tok as (select id, m, unnest(list_filter(string_split(clean, ' '), lambda w: w <> '')) as word from class),
    cnt as (select id, m, word, count(*) as c, sum(count(*)) over (partition by id) as total from tok group by id, m, word),
    df as (select word, sum(m)::double as df from cnt group by word),
    vec as (select id, word, c::double / total::double * ln((select sum(m)::double from class) / (1.0 + df)) as v from cnt join df using (word)),
    norm as (select id, sqrt(sum(v * v)) as norm, count(*) as n from vec group by id)"""
QUESTION_WORDS = f"texts as ({FULL_TEXT}), {WORD_VECTORS}"
DOCUMENT_WORDS = f"texts as (select doc_id as question_id, text as full_text from documents where text is not null), {WORD_VECTORS}"
PAIR_SQL = """
    dots as (select a.id as a, b.id as b, sum(a.v * b.v) as dot, count(*) as o from vec a join vec b on a.word = b.word and a.id < b.id group by 1, 2),
    scored as (select a, b, o::double / (x.n + y.n - o) as jaccard, case when x.norm = 0 or y.norm = 0 then 0.0 else dot / (x.norm * y.norm) end as cosine
      from dots join norm x on x.id = a join norm y on y.id = b),
    pairs as (select *, cosine * 0.4 + jaccard * 0.6 as similarity from scored where cosine * 0.4 + jaccard * 0.6 >= 0.85)"""


#: Each copy but the first of its class; copies whose words all weigh nothing score 0.6.
COPIES_SQL = """copies as (select k.id as class_id, c.id, k.m as n_members, 1.0::double as similarity from clean c join class k using (clean)
      join norm x on x.id = k.id where x.norm > 0 and c.id <> k.id)"""


@query(
    f"with {QUESTION_WORDS}, {PAIR_SQL} select a, b, round(jaccard, 6) as jaccard, round(cosine, 6) as cosine, round(similarity, 6) as similarity from pairs"
)
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similar questions, between classes of equal clean text."""
    pairs = similar.similar_pairs(_clean_questions(spark, d))
    return pairs.select("a", "b", *(F.round(c, 6).alias(c) for c in ("jaccard", "cosine", "similarity")))


@query(f"with {DOCUMENT_WORDS}, {PAIR_SQL} select a, b, round(similarity, 6) as similarity from pairs")
def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    """Similar documents, between classes of equal clean text."""
    return similar.similar_pairs(_clean_documents(spark, d)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    f"with {DOCUMENT_WORDS} select c.id, k.id as class_id, k.m as n_members from clean c join class k using (clean)"
)
def similar_document_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the class whose smallest id stands for it in ``similar_documents``."""
    return similar.membership(_clean_documents(spark, d))


@query(
    f"""with {DOCUMENT_WORDS}, {PAIR_SQL}, both_ways as (select a as id, b as other from pairs union all select b, a from pairs),
    outside as (select p.id, sum(k.m) as n from both_ways p join class k on k.id = p.other group by p.id)
    select c.id, k.id as class_id, (coalesce(o.n, 0) + case when coalesce(x.norm, 0) > 0 then k.m - 1 else 0 end)::bigint as n_links
    from clean c join class k using (clean) left join outside o on o.id = k.id left join norm x on x.id = k.id"""
)
def similar_document_links(spark: SparkSession, d: str) -> DataFrame:
    """Each document with its class and the number of documents it is similar to."""
    return similar.links(_clean_documents(spark, d)).select("id", "class_id", "n_links")


@query(
    f"with {QUESTION_WORDS} select c.id, k.id as class_id, k.m as n_members from clean c join class k using (clean)"
)
def similar_classes(spark: SparkSession, d: str) -> DataFrame:
    return similar.membership(_clean_questions(spark, d))


@query(
    f"""with {QUESTION_WORDS}, {PAIR_SQL}, both_ways as (select a as id, b as other from pairs union all select b, a from pairs),
    outside as (select p.id, sum(k.m) as n from both_ways p join class k on k.id = p.other group by p.id)
    select c.id, k.id as class_id, (coalesce(o.n, 0) + case when coalesce(x.norm, 0) > 0 then k.m - 1 else 0 end)::bigint as n_links
    from clean c join class k using (clean) left join outside o on o.id = k.id left join norm x on x.id = k.id"""
)
def similar_links(spark: SparkSession, d: str) -> DataFrame:
    """Each question with its class and the number of questions it is similar to."""
    return similar.links(_clean_questions(spark, d))


@query(
    f"""with {QUESTION_WORDS}, {PAIR_SQL}, {COPIES_SQL} select a, b, round(similarity, 6) as similarity, x.filepath as filepath_a, x.title as title_a, x.qtype as type_a,
    y.filepath as filepath_b, y.title as title_b, y.qtype as type_b
    from (select a, b, similarity from pairs union all select class_id, id, similarity from copies) join questions x on x.question_id = a join questions y on y.question_id = b"""
)
def similar_named(spark: SparkSession, d: str) -> DataFrame:
    """Similar questions with their files, titles and types: pairs between classes, and each copy with the first of its class."""
    corpus = similar.prepare(_clean_questions(spark, d))
    pairs = similar.similar_pairs(corpus).select("a", "b", "similarity")
    copies = similar.copies(corpus).select(F.col("class_id").alias("a"), F.col("id").alias("b"), "similarity")
    rounded = stored(pairs.unionByName(copies).withColumn("similarity", F.round("similarity", 6)), "pairs")
    corpus.drop()
    return similar.with_questions(rounded, _questions(spark, d))


@query(f"with {QUESTION_WORDS}, {COPIES_SQL} select class_id, id, n_members, similarity from copies")
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each copy of a question with the first of its class."""
    return similar.copies(_clean_questions(spark, d))


# ---- text transforms ------------------------------------------------------

def _html_sql(column: str) -> str:
    for pattern, markdown in X.HTML_RULES:
        pattern = pattern.replace("\\x85", "\\x{85}")
        markdown = markdown.replace("$1", "\\1")
        column = f"regexp_replace({column}, '{pattern}', '{markdown}', 'g')"
    return f"regexp_replace({column}, {STRIP})"


def _chain_sql(column: str, pairs) -> str:
    for old, new in pairs:
        column = "replace({}, '{}', '{}')".format(column, old.replace("'", "''"), new.replace("'", "''"))
    return column


@query(f"select doc_id, {_html_sql('text')} as markdown from documents where text is not null")
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select(
        "doc_id", X.html_to_markdown(F.col("text")).alias("markdown")
    )


@query(f"select text_id, {_chain_sql('text', X.TO_PLAIN + X.TO_ENTITY)} as plain from formatted_text where text is not null")
def characters_to_plain(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "formatted_text").where("text is not null").select(
        "text_id", X.map_characters(F.col("text"), True).alias("plain")
    )


WIDE = X.ENTITY_TO_WIDE + [(p, w) for w, p in X.TO_PLAIN if p not in ("\n", "\t")]


@query(f"select text_id, {_chain_sql('text', WIDE)} as wide from formatted_text where text is not null")
def characters_to_wide(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "formatted_text").where("text is not null").select(
        "text_id", X.map_characters(F.col("text"), False).alias("wide")
    )


@query(
    rf"""with t as (select text_id, string_split(regexp_replace(text, '`[^`\n]+`', chr(1), 'g'), chr(1)) as o,
      regexp_extract_all(text, '`[^`\n]+`') as m from formatted_text where text is not null and not contains(text, '```'))
    select text_id, array_to_string(list_transform(range(1, len(o) + 1), lambda i: o[i] || coalesce({_chain_sql("m[i]", WIDE)}, '')), '') as mapped from t"""
)
def code_spans_to_wide(spark: SparkSession, d: str) -> DataFrame:
    """Characters inside code spans and fences as full-width ones. The SQL follows only on texts without fences."""
    rows = read_table(spark, d, "formatted_text").where("text is not null")
    return rows.select("text_id", X.map_code(F.col("text"), False).alias("mapped"))


@query(
    rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents where text is not null),
    f as (select *, regexp_matches(line, '^{S}*```') as fence from l),
    k as (select *, not fence and sum(fence::int) over (partition by doc_id order by i) % 2 = 1 as code, len(regexp_extract(line, '^ *')) // 4 as groups from f)
    select doc_id, string_agg(case when code then repeat('····', groups) || line[groups * 4 + 1:] else line end, chr(10) order by i) as indented,
    coalesce(sum(groups) filter (code), 0)::int as n from k group by doc_id"""
)
def code_indents(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", X.indent_code(F.col("text")).alias("indented"), X.count_indents(F.col("text")).alias("n"))


@query(
    rf"""with t as (select doc_id, text, regexp_extract_all(text, '(?s)<text[^>]*>.*?</text>') as m from documents where fmt = 'xml' and text is not null and not regexp_matches(text, '<text[^>]*/>'))
    select doc_id, len(list_filter(m, lambda b: regexp_matches(regexp_extract(b, '(?s)^<text[^>]*>(.*?)</text>$', 1), '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]')
      and not regexp_matches(b, '(?s)^<text[^>]*>{S}*<!\[CDATA\['))) as n_missing from t"""
)
def cdata_missing(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks without CDATA. The SQL follows only on XML without an empty <text/>."""
    rows = read_table(spark, d, "documents").where("fmt = 'xml' and text is not null")
    return rows.select("doc_id", X.count_missing_cdata(F.col("text")).cast("long").alias("n_missing"))


NEEDS_CDATA = rf"""regexp_matches(regexp_extract(b, '(?s)^<text[^>]*>(.*?)</text>$', 1), '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]')
      and not regexp_matches(b, '(?s)^<text[^>]*>{S}*<!\[CDATA\[')"""


def _segments_sql(change: str) -> str:
    """A text put together again from the parts o outside and ``change`` of each part b of m inside."""
    return rf"""array_to_string(list_transform(range(1, len(o) + 1), lambda i: o[i] || coalesce(list_transform(m[i:i], lambda b: {change})[1], '')), '')"""


@query(
    rf"""with t as (select doc_id, string_split(regexp_replace(text, '(?s)<text(?:{S}[^>]*[^>/])?>.*?</text>', chr(1), 'g'), chr(1)) as o,
      regexp_extract_all(text, '(?s)<text(?:{S}[^>]*[^>/])?>.*?</text>') as m from documents where fmt = 'xml' and text is not null)
    select doc_id, {_segments_sql(f"case when {NEEDS_CDATA} then regexp_replace(b, '(?s)^(<text[^>]*>)(.*?)(</text>)$', '{chr(92)}1<![CDATA[{chr(92)}2]]>{chr(92)}3') else b end")} as xml from t"""
)
def cdata_ensured(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where("fmt = 'xml' and text is not null")
    return rows.select("doc_id", X.ensure_cdata(F.col("text")).alias("xml"))


@query(
    rf"""with t as (select doc_id, text, string_split(text, '</question>') as q from documents where fmt = 'xml' and text is not null),
    u as (select doc_id, q, list_transform(q[:-2], lambda b: regexp_matches(b, '(?s)<question[ >].*<tags(?:{S}[^>]*)?/?>')) as had from t)
    select doc_id, array_to_string(list_transform(range(1, len(q) + 1), lambda i: case when i < len(q) and had[i]
      then regexp_replace(q[i], '(?s)^(.*?<question[ >].*?)(?:<tags(?:{S}[^>]*)?/>|<tags(?:{S}[^>]*)?>.*?</tags>)', '\1') else q[i] end), '</question>') as xml,
    len(list_filter(had, lambda h: h))::int as n from u"""
)
def tags_removed(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where("fmt = 'xml' and text is not null")
    return rows.select("doc_id", X.remove_tags(F.col("text")).alias("xml"), X.count_tags(F.col("text")).alias("n"))


#: Characters that decompose to one ASCII character (kinds of space, wide forms, raised digits), and that character; accents aside.
SINGLE = [(c, unicodedata.normalize("NFKD", c)) for c in map(chr, [*range(0xA0, 0x100), *range(0x2000, 0x2100), *range(0x3000, 0x3001), *range(0xFF01, 0xFF5F)])]
SINGLE = [(c, plain) for c, plain in SINGLE if len(plain) == 1 and plain.isascii() and plain not in "'\\"]
PLAIN_SQL = "strip_accents(replace(replace(translate(title, '{}', '{}'), '…', '...'), '⩵', '=='))".format(*("".join(x) for x in zip(*SINGLE)))


@query(
    rf"""select question_id, lower(regexp_replace(regexp_replace(regexp_replace({PLAIN_SQL}, '[^A-Za-z0-9_\s-]', '', 'g'), '^\s+|\s+$', '', 'g'), '[-\s]+', '_', 'g')) as slug
    from questions where title is not null"""
)
def slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of all titles."""
    rows = read_table(spark, d, "questions").where("title is not null")
    return rows.select("question_id", X.slugify("title").alias("slug"))


@query(
    rf"""select question_id, lower(regexp_replace(regexp_replace(regexp_replace(title, '[^\p{{L}}\p{{N}}_\t-\r\x1c-\x20\x{{85}}\p{{Z}}-]', '', 'g'), {STRIP}), '[-\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', '_', 'g')[1:100]) as name
    from questions where title is not null"""
)
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "questions").where("title is not null").select(
        "question_id", X.sanitize_filename(F.col("title")).alias("name")
    )


@query(
    """select filepath, upper(replace(s, '_', ' ')[1:1]) || lower(replace(s, '_', ' ')[2:]) as title
    from (select distinct filepath, regexp_extract(filepath, '([^/]*?)(?:\\.[^./]*)?$', 1) as s from questions)"""
)
def titles_from_names(spark: SparkSession, d: str) -> DataFrame:
    rows = changes.with_parts(read_table(spark, d, "questions").select("filepath").distinct())
    return rows.select("filepath", X.title_from_name(F.col("stem")).alias("title"))


@query()
def gift_formatted(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d, "gift")
    return rows.select("doc_id", X.format_gift(F.col("content")).alias("formatted"), X.format_gift(F.col("content"), True).alias("correct_first"))


CDATA_PARTS = r"""string_split(regexp_replace(text, '(?s)<!\[CDATA\[.*?\]\]>', chr(1), 'g'), chr(1)) as o,
      regexp_extract_all(text, '(?s)<!\[CDATA\[.*?\]\]>') as m from documents where fmt = 'xml' and text is not null"""


@query(
    rf"""with t as (select doc_id, {CDATA_PARTS}) select doc_id, replace({_segments_sql("'<![CDATA[' || " + _html_sql("b[10:-4]") + " || ']]>'")},
    'format="html"', 'format="markdown"') as xml from t"""
)
def html_in_xml(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where("fmt = 'xml' and text is not null")
    return rows.select("doc_id", X.html_to_markdown_in_xml(F.col("text")).alias("xml"))


@query(
    rf"""with c as (select doc_id, {CDATA_PARTS}), b as (select doc_id, o, list_transform(m, lambda b: b) as m from c),
    parts as (select doc_id, o, m, list_transform(m, lambda b: string_split(regexp_replace(b, '`[^`\n]+`', chr(1), 'g'), chr(1))) as oo,
      list_transform(m, lambda b: regexp_extract_all(b, '`[^`\n]+`')) as mm from b)
    select doc_id, array_to_string(list_transform(range(1, len(o) + 1), lambda i: o[i] || case when i <= len(m) then
      array_to_string(list_transform(range(1, len(oo[i]) + 1), lambda j: oo[i][j] || coalesce({_chain_sql("mm[i][j]", WIDE)}, '')), '') else '' end), '') as xml from parts"""
)
def code_in_cdata(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where("fmt = 'xml' and text is not null")
    return rows.select("doc_id", X.map_code_in_cdata(F.col("text"), False).alias("xml"))


@query(
    rf"""select doc_id, nullif(regexp_replace(regexp_extract(text, '(?s)^::(.*?)::', 1), {STRIP}), '') as title
    from documents where fmt = 'gift' and text is not null and regexp_matches(text, '(?s)^::.*?::')"""
)
def gift_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where("fmt = 'gift' and text is not null")
    titled = rows.select("doc_id", F.nullif(X.gift_title(F.col("text")), F.lit("")).alias("title"), "text")
    return titled.where(F.col("text").rlike("(?s)^::.*?::")).drop("text")


@query(
    rf"""select doc_id, '::Nuevo $1::' || case when regexp_matches(text, '(?s)^::.*?::') then regexp_replace(text, '(?s)^::.*?::', '')
    else chr(10) || text end as gift from documents where fmt = 'gift' and text is not null"""
)
def gift_retitled(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where("fmt = 'gift' and text is not null")
    return rows.select("doc_id", X.set_gift_title(F.col("text"), F.lit("Nuevo $1")).alias("gift"))


@query(
    rf"""with n as (select doc_id, regexp_extract(text, '(?s)<name>.*?</name>') as xml from documents where fmt = 'xml' and text is not null),
    b as (select doc_id, replace(replace(regexp_extract(xml, '(?s)<text[^>]*>(.*?)</text>', 1), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as body from n),
    t as (select doc_id, body, regexp_replace(body, '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g') as inner_text from b)
    select doc_id, case when not regexp_matches(regexp_replace(body, '(?s)<!\[CDATA\[.*?\]\]>|&(?:amp|lt|gt|quot|apos);', '', 'g'), '[<&]') then
      nullif(regexp_replace(replace(replace(replace(replace(replace(inner_text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&'), {STRIP}), '') end as title from t"""
)
def xml_titles(spark: SparkSession, d: str) -> DataFrame:
    """The title in each document's name element, which is read as a document of its own."""
    rows = read_table(spark, d, "documents").where("fmt = 'xml' and text is not null")
    name = F.concat(F.lit("<quiz><question>"), F.regexp_extract("text", "(?s)<name>.*?</name>", 0), F.lit("</question></quiz>"))
    return rows.select("doc_id", X.xml_title(name).alias("title"))


@query()
def xml_document_titles(spark: SparkSession, d: str) -> DataFrame:
    """The title of each XML document; SQL can't tell which documents are broken."""
    rows = read_table(spark, d, "documents").where("fmt = 'xml' and text is not null")
    return rows.select("doc_id", X.xml_title(F.col("text")).alias("title"))


# ---- plans of changes and batches -----------------------------------------

SPLIT_SQL = rf"""
    src as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n{S}*\n', chr(1), 'g'), chr(1)),
      lambda s: regexp_replace(s, {STRIP})), lambda s: s <> '') as blocks from documents where fmt = 'gift' and text is not null)"""


@query(
    rf"""with {SPLIT_SQL} select doc_id, unnest(range(len(blocks)))::int as pos, unnest(blocks) as block from src"""
)
def gift_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d, "gift").select("doc_id", F.posexplode(X.gift_blocks(F.col("content"))).alias("pos", "block"))


@query(
    rf"""with {SPLIT_SQL}, b as (select doc_id, unnest(range(len(blocks))) as pos, unnest(blocks) as block from src),
    k as (select *, row_number() over (order by doc_id, pos) - 1 as n from b)
    select (n // 5)::bigint as batch_id, (n % 5)::int as slot, doc_id, pos::int as pos from k"""
)
def batches_of_five(spark: SparkSession, d: str) -> DataFrame:
    return enrich.batched(_documents(spark, d, "gift"), 5).select("batch_id", "slot", _doc_id(), "pos")


@query(
    rf"""with {SPLIT_SQL}, g as (select doc_id, nullif(regexp_replace(regexp_extract(text, '(?s)^::(.*?)::', 1), {STRIP}), '') as title from documents where fmt = 'gift' and text is not null),
    p as (select distinct filepath from questions)
    select 'split' as plan, sum(len(blocks))::bigint as n_rows, sum(len(blocks))::bigint as n_paths from src where len(blocks) > 1
    union all select 'title', count(*), count(*) from g where title is not null union all select 'slug', count(*), count(*) from p"""
)
def plan_names(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct new paths of each plan: no two rows of a plan write the same file."""
    plans = {"split": split_plan, "title": title_rename_plan, "slug": slug_rename_plan}
    counts = [
        plan(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("new_path").alias("n_paths")).select(F.lit(name).alias("plan"), "n_rows", "n_paths")
        for name, plan in plans.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query()
def split_plan(spark: SparkSession, d: str) -> DataFrame:
    return changes.split_files(_documents(spark, d, "gift"))


@query()
def slug_rename_plan(spark: SparkSession, d: str) -> DataFrame:
    return changes.rename_to_slug(read_table(spark, d, "questions").select("filepath").distinct())


@query()
def title_rename_plan(spark: SparkSession, d: str) -> DataFrame:
    return changes.rename_from_title(_documents(spark, d, "gift"))


@query()
def xml_rename_plan(spark: SparkSession, d: str) -> DataFrame:
    return changes.rename_xml(_documents(spark, d, "xml"))


@query(
    r"""with f as (select 'docs/' || lpad(doc_id::varchar, 12, '0') || '.gift' as filepath, lpad(doc_id::varchar, 12, '0') as title, text from documents where fmt = 'gift' and text is not null),
    n as (select *, '::' || title || '::' || case when regexp_matches(text, '(?s)^::.*?::') then regexp_replace(text, '(?s)^::.*?::', '') else chr(10) || text end as new_content from f)
    select filepath, title, new_content, new_content <> text as changed from n"""
)
def title_from_name_plan(spark: SparkSession, d: str) -> DataFrame:
    return changes.titles_from_names(_documents(spark, d, "gift"))


def _bank(spark: SparkSession, d: str) -> report.Bank:
    """The stored questions as a bank of files."""
    questions = _questions(spark, d)
    files = questions.select("filepath").distinct().select("filepath", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    return report.Bank(files, questions)


ISSUE_SQL = """issue as (select filepath, '⚠️  ' || filepath || ': ' || case issue when 'empty' then 'Pregunta sin título ni texto'
      when 'mc_without_correct' then 'Pregunta MC sin respuesta correcta - ' || label when 'matching_below_two_pairs' then 'Pregunta Matching con menos de 2 pares - ' || label
      else 'Pregunta Short sin respuestas - ' || label end as issue from (""" + SQL["question_issues"] + "))"
BANK_SQL = f"""{QUESTION_WORDS}, {PAIR_SQL}, {COPIES_SQL}, {ISSUE_SQL},
    rows_of as (select a, b, similarity from pairs union all select class_id, id, similarity from copies),
    duplicate as (select row_number() over (order by round(similarity, 6) desc, a, b) as nth, similarity, x.filepath as fa, coalesce(x.title, '') as ta, x.title as title_a, x.qtype as ka,
      y.filepath as fb, coalesce(y.title, '') as tb, y.title as title_b, y.qtype as kb from rows_of join questions x on x.question_id = a join questions y on y.question_id = b),
    t as ({SQL["type_counts"]}), c as ({SQL["category_counts"]}), g as ({SQL["tag_counts"]}), z as ({SQL["depth_counts"]}), e as ({SQL["description_texts"]}),
    w as (select (select count(*) from (select distinct filepath from questions)) as total_files, (select count(*) from issue) as n_issues, (select count(*) from e) as n_descriptions,
      (select coalesce(sum(p.m * q.m), 0)::bigint from pairs join class p on p.id = a join class q on q.id = b) + (select coalesce(sum(n_members), 0)::bigint from copies) // 2 as n_duplicates,
      x.* from ({SQL["content_quality"]}) x)"""


@query(
    f"""with {BANK_SQL}
    select 0 as section, unnest(['Total de archivos GIFT: ' || total_files, '  ✅ Archivos válidos: ' || total_files, '  ❌ Archivos inválidos: 0', 'Total de preguntas: ' || total_questions]) as line from w
    union all select 1, printf('  %-20s: %5d (%5.1f%%)', type, n, percent) from t union all select 2, printf('  %-60s: %4d', category[1:60], n) from c
    union all select 3, printf('  %-30s: %4d', coalesce(tag, 'null'), n) from g
    union all select 4, unnest(['Preguntas con tags: ' || with_tags, 'Preguntas sin tags: ' || without_tags, 'Preguntas con feedback global: ' || with_feedback,
      'Preguntas sin feedback global: ' || without_feedback, 'Preguntas vacías: ' || empty_questions]) from w
    union all select 5, printf('  Nivel %d: %d archivos', depth, n_files) from z
    union all select 6, unnest(['Total de problemas: ' || n_issues, '']) from w where n_issues > 0 union all select 6, '  ' || issue from issue
    union all select 8, unnest(['Total: ' || n_descriptions, {", ".join("'" + x.replace("'", "''") + "'" for x in report.DESCRIPTION_NOTES)}, '']) from w where n_descriptions > 0
    union all select 8, '  📄 ' || filepath || chr(10) || '     Título: ' || title || case when text <> '<sin texto>' then
      chr(10) || '     Texto: ' || replace(text, chr(10), ' ')[1:80] || '...' else '' end || chr(10) from e
    union all select 9, unnest(['Total de duplicados encontrados: ' || n_duplicates, 'Threshold de similitud: 0.85', '']) from w where n_duplicates > 0
    union all select 9, 'Duplicado ' || nth || printf(': Similitud = %.3f', similarity) || chr(10) || '  Pregunta A (' || ka || '): ' || ta[1:70] || chr(10) || '    Archivo: ' || fa || chr(10)
      || '  Pregunta B (' || kb || '): ' || tb[1:70] || chr(10) || '    Archivo: ' || fb || chr(10) || '  Comando: meld -n ' || chr(39) || fa || chr(39) || ' ' || chr(39) || fb || chr(39) || chr(10) from duplicate
    union all select 10, unnest(list_filter([
      case when without_tags > 0 then printf('  • %.1f%% de preguntas sin tags - considera añadir tags para mejor organización', without_tags / total_questions * 100) end,
      case when without_feedback > 0 then printf('  • %.1f%% de preguntas sin feedback global - el feedback ayuda al aprendizaje', without_feedback / total_questions * 100) end,
      case when empty_questions > 0 then '  • ' || empty_questions || ' preguntas vacías detectadas - requieren revisión' end,
      case when n_duplicates > 0 then '  • ' || n_duplicates || ' preguntas duplicadas detectadas - considera revisar para eliminar redundancias' end,
      case when n_issues = 0 and n_duplicates = 0 then '{report.WELL}' end], lambda x: x is not null)) from w"""
)
def bank_report(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the bank report."""
    return report.report_lines(_bank(spark, d)).select("section", "line")


@query(
    f"""with {BANK_SQL}, o as (
    select 0 as section, '"stats": {{"totalFiles": ' || total_files || ', "validFiles": ' || total_files || ', "invalidFiles": 0, "totalQuestions": ' || total_questions || ', "byType": {{' as line from w
    union all select 1, to_json(type) || ': ' || n from t union all select 3, to_json(category) || ': ' || n from c union all select 5, to_json(coalesce(tag, 'null')) || ': ' || n from g
    union all select 9, '"' || depth || '": ' || n_files from z union all select 11, to_json(issue)::varchar from issue
    union all select 13, '"question1":' || to_json({{'filepath': fa, 'title': title_a, 'type': ka}}) || ',"question2":' || to_json({{'filepath': fb, 'title': title_b, 'type': kb}}) from duplicate
    union all select 15, to_json({{'filepath': filepath, 'title': title, 'text': text}})::varchar from e)
    select section, case when section = 13 then replace(line, '"title":null,', '') else line end as line from o"""
)
def bank_json(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the JSON document, without the signs between them and without the similarities, whose last digits depend on the order of sums."""
    lines = report.json_lines(_bank(spark, d)).where("section in (0, 1, 3, 5, 9, 11, 13, 15)")
    bare = F.regexp_replace(F.regexp_replace("line", r"^,", ""), r'^\{"similarity":[-0-9.E]+,(.*)\}$', "$1")
    return lines.select("section", F.when(F.col("section") == 0, F.substr(bare, F.lit(2))).otherwise(bare).alias("line"))


@query(
    rf"""with {SPLIT_SQL} select 'docs/' || lpad(doc_id::varchar, 12, '0') || '.gift' as filepath, 'docs/' || lpad(doc_id::varchar, 12, '0') || '_improve.gift' as new_path,
    array_to_string(blocks, chr(10) || chr(10)) || chr(10) as new_content from src where len(blocks) > 0"""
)
def enriched_files(spark: SparkSession, d: str) -> DataFrame:
    """The batch path with the stand-in service that returns its input."""
    return enrich.outputs(enrich.enriched(_documents(spark, d, "gift")))


# ---- raw rows -------------------------------------------------------------

FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
RAW_SQL = rf"""
    t as (select line_id, try(decode(raw_line)) as s from raw_stats),
    f as (select *, case when s is null then 'encoding'
        when not regexp_matches(s, '(?s)^(?:"(?:[^"]|"")*"|[^",][^",]*|)(?:,(?:"(?:[^"]|"")*"|[^",]+|))*$') then 'quoting'
        when not regexp_matches(s, '(?s)^{FIELD}(?:,{FIELD}){{7}}$') or regexp_matches(s, '(?s)^(?:(?:"(?:[^"]|"")*"|[^",\r\n]*),)*[^",\r\n]*[\r\n]') then 'columns' end as early from t),
    g as (select *, regexp_extract(s, '(?s)^({FIELD}),({FIELD}),({FIELD}),({FIELD}),({FIELD}),({FIELD}),({FIELD}),({FIELD})$', ['a', 'b', 'c', 'd', 'e', 'f', 'p', 'h']) as r from f),
    h as (select line_id, early, list_transform([r.a, r.b, r.c, r.d, r.e, r.f, r.p, r.h],
      lambda x: case when x[1:1] = '"' then replace(x[2:-2], '""', '"') else x end) as v from g),
    k as (select *, case when early is not null then early when not (
      regexp_matches(v[1], '^[1-9][0-9]{{0,17}}$') and v[2] <> '' and not regexp_matches(v[2], '^{S}|{S}$')
      and regexp_matches(v[3], '^\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d$') and try_strptime(v[3], '%Y-%m-%d %H:%M:%S') is not null
      and regexp_matches(v[4], '^[0-9]{{1,9}}$') and regexp_matches(v[5], '^[0-9]{{1,9}}$') and regexp_matches(v[6], '^[0-9]{{1,9}}$')
      and regexp_matches(v[7], '^(?:|100(?:\.0{{1,4}})?|[0-9]{{1,2}}(?:\.[0-9]{{1,4}})?)$')) then 'value' end as failure from h)"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    columns = rawcsv.declared_columns(read_table(spark, d, "raw_column"))
    return rawcsv.read_records(read_table(spark, d, "raw_stats"), columns)


@query(f"with {RAW_SQL} select line_id, failure from k where failure is not null")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rawcsv.rejects(_raw(spark, d)).select("line_id", "failure")


@query(
    f"""with {RAW_SQL} select line_id, v[1]::bigint as scan_id, v[2] as root_dir, strptime(v[3], '%Y-%m-%d %H:%M:%S') as scanned_at,
    v[4]::bigint as total_files, v[5]::bigint as valid_files, v[6]::bigint as invalid_files, try_cast(nullif(v[7], '') as double) as with_tags_pct, v[8] as parse_errors
    from k where failure is null"""
)
def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows as the 8 typed columns of raw_column."""
    return rawcsv.valid_records(_raw(spark, d))
