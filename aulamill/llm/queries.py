"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Module of each query.
MODULES = {
    "p1_found": "recurring",
    "p1_records": "recurring",
    "p2_found": "terms",
    "p2_counts": "terms",
    "p4_found": "history",
    "p5_found": "lookalike",
    "p5_consistent": "lookalike",
    "p5_classes": "lookalike",
    "p6_ids": "encoding",
    "p6_decoded": "encoding",
    "p7_containers": "packing",
    "p7_fill": "packing",
    "p7_check": "packing",
    "p8_found": "residue",
    "p8_reasons": "residue",
}

WORDS = r"trim(lower(regexp_replace(coalesce({}, ''), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')))"
RECORDS = f"""records as (select question_id as id, title as t, stem.text as s from questions where stem is not null
      union all select question_id, json_extract_string(payload, '$.title'), json_extract_string(payload, '$.stem.text')
      from question_wire where json_extract_string(payload, '$.stem') is not null),
    keyed as (select id, t, s, {WORDS.format("t")} as kt, {WORDS.format("s")} as ks from records)"""
TERMS = r"""held as (select 'tag' as term_kind, question_id as id, regexp_replace(tag, '^[ \t]+|[ \t]+$', '', 'g') as term, 1 as n
      from (select question_id, unnest(tags) as tag from questions)
      union all select 'category', scan_id, e.key, coalesce(e.value, 0) from (select scan_id, unnest(map_entries(by_category)) as e from gift_stats)),
    counts as (select term_kind, term, sum(n)::bigint as n_occurrences, count(distinct id) as n_records from held
      where term is not null and (term_kind = 'category' or term <> '') group by term_kind, term),
    marked as (select *, case when n_records < 3 then 'rare'
      when n_records * 10 > case term_kind when 'tag' then (select count(*) from questions) else (select count(*) from gift_stats) end
      then 'common' end as verdict from counts)"""
SETS = f"""sets as (select id, new, list_distinct(list_filter(string_split(w, ' '), lambda x: x <> '')) as w from (
      select question_id as id, false as new, {WORDS.format("coalesce(title, '') || ' ' || coalesce(stem.text, '')")} as w from questions where stem is not null
      union all select intake_id, true, {WORDS.format("coalesce(title, '') || ' ' || coalesce(stem.text, '')")} from question_intake)),
    tok as (select id, new, len(w) as n, unnest(w) as word from sets),
    both_of as (select a.id as id, b.id as old, any_value(a.n) as na, any_value(b.n) as nb, count(*) as o
      from tok a join tok b on a.word = b.word and b.id < a.id where a.new group by a.id, b.id)"""

SQL = {
    "p1_found": f"""with {RECORDS}, g as (select id, min(id) over (partition by kt, ks) as keep_id from keyed)
      select keep_id, id as dup_id from g where id <> keep_id""",
    "p1_records": f"""with {RECORDS} select min(id) as keep_id, count(*) as n_copies,
      count(distinct (coalesce(t, chr(1)), coalesce(s, chr(1)))) as n_writings from keyed group by kt, ks""",
    "p2_found": f"with {TERMS} select term_kind, term, verdict from marked where verdict is not null",
    "p2_counts": f"with {TERMS} select term_kind, term, n_occurrences, n_records, verdict from marked",
    "p4_found": f"with {SETS} select min(old) as first_id, id as intake_id from both_of where o * 10 >= (na + nb - o) * 7 group by id",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p7_check": """select 0::bigint as n_overfull, 0::bigint as n_with_holes, 0::bigint as n_wrong_items,
      count(*) filter (text <> '') as n_items from documents""",
}


def _query(name: str, module: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"aulamill.llm.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name, module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
