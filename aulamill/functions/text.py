"""Text functions as column expressions. All stay in the JVM but NFKD slugs of
texts beyond ASCII and the titles of XML, which need a parser that survives broken documents.

White space and word characters are the Unicode ones; patterns name them in
full because Java's short classes are ASCII. Each function maps null to null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: White space within a line.
BLANK = r"[\t\x0b-\r\x1c-\x20\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"\p{L}\p{N}_"

# Special characters and their plain form, in the order of replacement.
TO_PLAIN = [
    ("⩵", "=="), ("＝", "="), ("＃", "#"), ("｛", "{"), ("｝", "}"), ("↵", "\n"), ("    ", "\t"), ("＞", ">"), ("＜", "<"),
    ("［", "["), ("］", "]"), ("（", "("), ("）", ")"), ("＊", "*"), ("＂", '"'), ("：", ":"),
]
# What is left over becomes an entity.
TO_ENTITY = [("＆", "&#38;"), ("＇", "&#39;"), ("　", "&nbsp;")]
# Entities and their full-width form, in the order of replacement.
ENTITY_TO_WIDE = [
    ("&lt;", "＜"), ("&gt;", "＞"), ("&amp;", "＆"), ("&quot;", "＂"), ("&apos;", "＇"), ("&#39;", "＇"), ("&#34;", "＂"), ("&#60;", "＜"),
    ("&#62;", "＞"), ("&#38;", "＆"), ("&nbsp;", "　"),
]


def newlines(text: Column) -> Column:
    r"""Every line end as \n, as text files are read."""
    return F.regexp_replace(text, r"\r\n?", "\n")


#: The characters of SPACE.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(r"[\t-\r\x1c-\x20\x85]", c) or unicodedata.category(c)[0] == "Z")


def strip(text: Column) -> Column:
    """Without white space at both ends; in time linear in the text, which a pattern for its end would not be."""
    return F.btrim(text, F.lit(SPACES))


def has_text(text: Column) -> Column:
    return text.rlike(NOT_SPACE)


def replace_all(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_text(text: Column) -> Column:
    """Lower case; everything but Spanish letters and digits is a single space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-záéíóúñü0-9]+", " "))


def tokens(clean: Column) -> Column:
    """Words of a clean text, repeats kept; the empty text has none."""
    return F.filter(F.split(clean, " "), lambda w: w != "")


# ---- segments -------------------------------------------------------------


def map_segments(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` to the matches of ``pattern`` and leave the rest as it is."""
    outside = F.split(text, pattern, -1)
    inside = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    return F.array_join(
        F.zip_with(outside, inside, lambda o, i: F.concat(F.coalesce(o, F.lit("")), F.coalesce(i, F.lit("")))), ""
    )


def count_changed(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """How many matches ``change`` alters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.size(F.filter(found, lambda m: change(m) != m))


# ---- character maps -------------------------------------------------------

FENCE = r"(?s)```[a-z]*\n.*?```"
INLINE = r"`[^`\n]+`"
CDATA = r"(?s)<!\[CDATA\[.*?\]\]>"


def map_characters(text: Column, to_plain: bool = True) -> Column:
    """Special characters to plain ones, or entities and plain characters to full-width ones."""
    if to_plain:
        return replace_all(text, TO_PLAIN + TO_ENTITY)
    back = [(plain, wide) for wide, plain in TO_PLAIN if plain not in ("\n", "\t")]
    return replace_all(text, ENTITY_TO_WIDE + back)


def _fence(to_plain: bool) -> Callable[[Column], Column]:
    def change(m: Column) -> Column:
        language = F.regexp_extract(m, r"^```([a-z]*)\n", 1)
        body = F.regexp_extract(m, r"(?s)^```[a-z]*\n(.*?)```\z", 1)
        return F.concat(F.lit("```"), language, F.lit("\n"), map_characters(body, to_plain), F.lit("\n```"))

    return change


def _inline(to_plain: bool) -> Callable[[Column], Column]:
    return lambda m: F.concat(
        F.lit("`"), map_characters(F.regexp_extract(m, r"^`([^`\n]+)`$", 1), to_plain), F.lit("`")
    )


def map_code(text: Column, to_plain: bool = True) -> Column:
    """Map characters in fenced and then in inline code. A fence gets a line break before its end each time."""
    return map_segments(map_segments(text, FENCE, _fence(to_plain)), INLINE, _inline(to_plain))


def count_mapped_code(text: Column, to_plain: bool = True) -> Column:
    """Number of code spans whose characters the mapping changes."""
    body = lambda m: F.regexp_extract(m, r"(?s)^```[a-z]*\n(.*?)```\z", 1)
    fences = F.size(
        F.filter(
            F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), lambda m: map_characters(body(m), to_plain) != body(m)
        )
    )
    return fences + count_changed(map_segments(text, FENCE, _fence(to_plain)), INLINE, _inline(to_plain))


def map_code_in_cdata(text: Column, to_plain: bool = True) -> Column:
    """Map characters in the code spans of CDATA sections only."""

    def change(m: Column) -> Column:
        body = F.regexp_extract(m, r"(?s)^<!\[CDATA\[(.*)\]\]>\z", 1)
        return F.concat(F.lit("<![CDATA["), map_code(body, to_plain), F.lit("]]>"))

    return map_segments(text, CDATA, change)


def count_mapped_code_in_cdata(text: Column, to_plain: bool = True) -> Column:
    """Number of code spans of CDATA sections whose characters the mapping changes."""
    bodies = F.transform(F.regexp_extract_all(text, F.lit(CDATA), F.lit(0)), lambda m: count_mapped_code(m, to_plain))
    return F.aggregate(bodies, F.lit(0), lambda n, x: n + x)


# ---- code indentation -----------------------------------------------------


#: From a line that opens a fence to the next one that closes it, or to the end.
FENCED = rf"(?smd)^{BLANK}*```.*?(?:\n{BLANK}*```[^\n]*|\z)"


def indent_code(text: Column) -> Column:
    """Each leading group of four spaces inside fences as four middle dots."""

    def change(m: Column) -> Column:
        lines = F.transform(
            F.split(m, "\n", -1),
            lambda s: F.when(strip(s).startswith("```"), s).otherwise(F.regexp_replace(s, r"\G {4}", "····")),
        )
        return F.array_join(lines, "\n")

    return map_segments(text, FENCED, change)


def count_indents(text: Column) -> Column:
    """Number of groups of four spaces that ``indent_code`` replaces."""
    code = F.flatten(
        F.transform(F.regexp_extract_all(text, F.lit(FENCED), F.lit(0)), lambda m: F.split(m, "\n", -1))
    )
    return F.aggregate(
        F.filter(code, lambda s: ~strip(s).startswith("```")),
        F.lit(0),
        lambda n, s: n + F.floor(F.length(F.regexp_extract(s, "^ *", 0)) / 4).cast("int"),
    )


# ---- HTML, XML ------------------------------------------------------------

# Tag patterns and their Markdown, in the order of replacement.
HTML_RULES = [
    (r"(?s)＜p＞(.*?)＜/p＞", "$1\n"),
    (r"(?s)＜code＞(.*?)＜/code＞", "`$1`"),
    (r"(?s)＜strong＞(.*?)＜/strong＞", "**$1**"),
    (r"(?s)＜pre＞(.*?)＜/pre＞", "```\n$1\n```"),
    (r"(?s)<code>(.*?)</code>", "`$1`"),
    (r"(?s)<p>(.*?)</p>", "$1\n"),
    (r"(?s)<strong>(.*?)</strong>", "**$1**"),
    (r"(?s)<b>(.*?)</b>", "**$1**"),
    (r"(?s)<pre>(.*?)</pre>", "```\n$1\n```"),
    (rf"<br{SPACE}*/?>", "\n"),
]


def html_to_markdown(text: Column) -> Column:
    for pattern, markdown in HTML_RULES:
        text = F.regexp_replace(text, pattern, markdown)
    return strip(text)


def html_to_markdown_in_xml(xml: Column) -> Column:
    """Convert inside CDATA sections, then declare every html format as markdown."""

    def change(m: Column) -> Column:
        body = F.regexp_extract(m, r"(?s)^<!\[CDATA\[(.*)\]\]>\z", 1)
        return F.concat(F.lit("<![CDATA["), html_to_markdown(body), F.lit("]]>"))

    return F.replace(map_segments(xml, CDATA, change), F.lit('format="html"'), F.lit('format="markdown"'))


def _blocks(safe: bool) -> str:
    """With ``safe`` an empty element (<text/>) opens no block; without, it does, as older banks were written."""
    opening = r"<text(?![^>]*/>)[^>]*>" if safe else r"<text[^>]*>"
    return rf"(?s){opening}.*?</text>"


def _needs_cdata(block: Column) -> Column:
    body = F.regexp_extract(block, r"(?s)^<text[^>]*>(.*?)</text>\z", 1)
    return has_text(body) & ~strip(body).startswith("<![CDATA[")


def ensure_cdata(xml: Column, safe: bool = True) -> Column:
    """Wrap the content of each non-blank text block in CDATA unless it is."""

    def change(m: Column) -> Column:
        wrapped = F.regexp_replace(m, r"(?s)^(<text[^>]*>)(.*?)(</text>)\z", r"$1<![CDATA[$2]]>$3")
        return F.when(_needs_cdata(m), wrapped).otherwise(m)

    return map_segments(xml, _blocks(safe), change)


def count_missing_cdata(xml: Column, safe: bool = True) -> Column:
    return F.size(F.filter(F.regexp_extract_all(xml, F.lit(_blocks(safe)), F.lit(0)), _needs_cdata))


#: CDATA sections and comments, whose content is no markup.
OPAQUE = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->"
QUESTION = rf"(?s)<question(?:{SPACE}[^>]*)?>.*?</question>"
TAG_SECTION = rf"(?s)<tags(?:{SPACE}[^>]*?)?(?:/>|>.*?</tags{SPACE}*>)"


def _markup(xml: Column) -> Column:
    r"""The text with \x01, which XML can't hold, for each < that opens nothing."""
    return map_segments(
        xml, OPAQUE, lambda m: F.concat(F.lit("<"), F.replace(F.substr(m, F.lit(2)), F.lit("<"), F.lit("\x01")))
    )


def remove_tags(xml: Column) -> Column:
    """Drop the first tags section of each question, in any of its forms; what CDATA or comments hold is no section."""
    cut = map_segments(_markup(xml), QUESTION, lambda q: F.concat(
        F.split(q, TAG_SECTION, 2)[0], F.coalesce(F.try_element_at(F.split(q, TAG_SECTION, 2), F.lit(2)), F.lit(""))
    ))
    return F.replace(cut, F.lit("\x01"), F.lit("<"))


def count_tags(xml: Column) -> Column:
    """Number of questions with a tags section."""
    return F.size(F.filter(F.regexp_extract_all(_markup(xml), F.lit(QUESTION), F.lit(0)), lambda q: q.rlike(TAG_SECTION)))


# ---- names and titles -----------------------------------------------------


def _slug(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return re.sub(r"[-\s]+", "_", re.sub(r"[^\w\s-]", "", plain).strip()).lower()


@F.pandas_udf(T.StringType())
def _slugs(texts: pd.Series) -> pd.Series:
    return texts.map(_slug, na_action="ignore").astype(object)


def _latin() -> tuple[str, str]:
    """Latin-1 letters that are an ASCII letter with an accent, and that letter."""
    both = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x100)]
    both = [(c, base) for c, base in both if base != c]
    return "".join(c for c, _ in both), "".join(base for _, base in both)


def slugify(text: Column | str) -> Column:
    """Lower-case ASCII slug with underscores; accents fall away. Only texts beyond Latin-1 letters go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    accented, bare = _latin()
    plain = F.translate(text, accented, bare)
    kept = strip(F.regexp_replace(plain, r"[^A-Za-z0-9_\t-\r\x1c-\x20-]", ""))
    simple = F.lower(F.regexp_replace(kept, r"[-\t-\r\x1c-\x20]+", "_"))
    ascii_only = ~plain.rlike(r"[^\x00-\x7f]")
    return F.when(ascii_only, simple).otherwise(_slugs(F.when(~ascii_only, text)))


def sanitize_filename(text: Column, max_length: int = 100) -> Column:
    """A file name with accents kept: signs dropped, spaces and hyphens as one underscore, cut, lower case."""
    kept = strip(F.regexp_replace(text, rf"[^{WORD}\t-\r\x1c-\x20\x85\p{{Z}}-]", ""))
    return F.lower(F.substring(F.regexp_replace(kept, r"[-\t-\r\x1c-\x20\x85\p{Z}]+", "_"), 1, max_length))


def title_from_name(stem: Column) -> Column:
    spaced = F.replace(stem, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substr(spaced, F.lit(2))))


def gift_title(text: Column) -> Column:
    """Title at the start of GIFT text; null where there is none."""
    found = F.regexp_extract(text, r"(?s)^::(.*?)::", 1)
    return F.when(text.rlike(r"(?s)^::.*?::"), strip(found))


def _xml_title(xml: str) -> str | None:
    try:
        root = ElementTree.fromstring(xml.lstrip("\ufeff"))
    except (ElementTree.ParseError, ValueError):
        return None
    found = root.find("name/text" if root.tag == "question" else ".//question/name/text")
    return (found.text or "").strip() or None if found is not None else None


@F.pandas_udf(T.StringType())
def xml_title(texts: pd.Series) -> pd.Series:
    """Name of the first question that has one, entities resolved; null where there is none or the XML is broken.

    A question that is a document by itself counts as one. In Python because the JVM's xpath functions end the job at a broken document.
    """
    return texts.map(_xml_title, na_action="ignore").astype(object)


def question_title(path: Column, content: Column) -> Column:
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.when(extension == "gift", gift_title(content)).when(extension == "xml", xml_title(content))


def set_gift_title(text: Column, title: Column) -> Column:
    """Replace the first title, or put one before the text."""
    rest = F.regexp_replace(text, r"(?s)^::.*?::", "")
    marked = F.concat(F.lit("::"), title, F.lit("::"))
    return F.when(text.rlike(r"(?s)^::.*?::"), F.concat(marked, rest)).otherwise(
        F.concat(marked, F.lit("\n"), text)
    )


def set_xml_title(xml: Column, title: Column) -> Column:
    """Replace the first name's text, keeping a CDATA section; unchanged without a name."""
    pattern = rf"(?s)^(.*?<name>{SPACE}*<text[^>]*>)(.*?)(</text>{SPACE}*</name>.*)\z"
    inner = F.regexp_extract(xml, pattern, 2)
    new = F.when(inner.contains("<![CDATA["), F.concat(F.lit("<![CDATA["), title, F.lit("]]>"))).otherwise(title)
    return F.when(
        xml.rlike(pattern), F.concat(F.regexp_extract(xml, pattern, 1), new, F.regexp_extract(xml, pattern, 3))
    ).otherwise(xml)


# ---- GIFT layout ----------------------------------------------------------


def gift_blocks(content: Column) -> Column:
    """Stripped, non-empty parts between blank lines."""
    return F.filter(F.transform(F.split(content, rf"\n{SPACE}*\n", -1), strip), lambda p: p != "")


#: Line ends as Python's splitlines knows them.
LINE_END = r"\r\n|[\n\x0b-\r\x1c-\x1e\x85\u2028\u2029]"
TITLED = r"(?s)^::(.*?)::"
OPENED = r"(?s)^(.*?)(?<!\\)\{(.*)\z"
CLOSED = r"(?s)^(.*)(?<!\\)\}(.*?)\z"


def _laid_out(blocks: Column, correct_first: bool) -> Column:
    """The blocks in the standard layout. Each transform is a step whose results the next one names."""
    filled = lambda a: F.filter(a, lambda s: s != "")
    stripped = lambda a: filled(F.transform(a, strip))
    # Notes are the lines before the first that is neither blank nor a comment nor a command.
    steps = F.transform(blocks, lambda b: F.split(b, LINE_END, -1))
    steps = F.transform(
        steps,
        lambda lines: F.struct(
            lines.alias("lines"),
            F.array_position(F.transform(lines, lambda s: has_text(s) & ~s.rlike(rf"^{SPACE}*(?://|\$)")), True).cast("int").alias("at"),
        ),
    )
    steps = F.transform(
        steps,
        lambda x: F.struct(
            stripped(F.when(x["at"] > 0, F.slice(x["lines"], F.lit(1), x["at"] - 1)).otherwise(x["lines"])).alias("notes"),
            strip(
                F.when(x["at"] > 0, F.array_join(F.slice(x["lines"], x["at"], F.size(x["lines"])), "\n")).otherwise("")
            ).alias("body"),
        ),
    )
    steps = F.transform(
        steps,
        lambda x: F.struct(
            x["notes"].alias("notes"),
            F.when(x["body"].rlike(TITLED), F.concat(F.lit("::"), strip(F.regexp_extract(x["body"], TITLED, 1)), F.lit("::")))
            .otherwise("")
            .alias("title"),
            strip(F.regexp_replace(x["body"], TITLED, "")).alias("body"),
        ),
    )
    steps = F.transform(
        steps,
        lambda x: F.struct(
            x["notes"].alias("notes"),
            x["title"].alias("title"),
            x["body"].rlike(OPENED).alias("opened"),
            strip(F.when(x["body"].rlike(OPENED), F.regexp_extract(x["body"], OPENED, 1)).otherwise(x["body"])).alias("stem"),
            F.regexp_extract(x["body"], OPENED, 2).alias("after"),
        ),
    )
    steps = F.transform(
        steps,
        lambda x: F.struct(
            x["notes"].alias("notes"),
            x["title"].alias("title"),
            x["opened"].alias("opened"),
            x["stem"].alias("stem"),
            stripped(
                F.split(F.when(x["after"].rlike(CLOSED), F.regexp_extract(x["after"], CLOSED, 1)).otherwise(x["after"]), LINE_END)
            ).alias("lines"),
            strip(F.when(x["opened"], F.regexp_extract(x["after"], CLOSED, 2)).otherwise("")).alias("tail"),
        ),
    )
    # A line that starts no answer goes on the one before.
    joined = lambda lines: F.regexp_replace(F.array_join(lines, "\n"), r"\n(?![=~#{])", " ")
    steps = F.transform(
        steps,
        lambda x: F.struct(
            x["notes"].alias("notes"),
            filled(F.array(x["title"], x["stem"])).alias("top"),
            x["opened"].alias("opened"),
            filled(F.split(joined(x["lines"]), "\n")).alias("answers"),
            x["tail"].alias("tail"),
        ),
    )

    def ordered(answers: Column) -> Column:
        if not correct_first:
            return answers
        right, wrong = F.filter(answers, lambda s: s.startswith("=")), F.filter(answers, lambda s: s.startswith("~"))
        other = F.filter(answers, lambda s: ~s.rlike("^[=~]"))
        return F.when((F.size(right) > 0) & (F.size(wrong) > 0), F.concat(right, wrong, other)).otherwise(answers)

    def put_together(x: Column) -> Column:
        indented = F.transform(ordered(x["answers"]), lambda s: F.concat(F.lit("    "), s))
        answers = F.concat(F.array(F.lit("{")), indented, F.array(F.lit("}")))
        parts = F.concat(x["notes"], x["top"], F.when(x["opened"], answers).otherwise(filled(F.array(F.lit("")))), filled(F.array(x["tail"])))
        return F.array_join(parts, "\n")

    return F.transform(steps, put_together)


def format_gift(content: Column, correct_first: bool = False) -> Column:
    """GIFT text in the standard layout: notes, title, stem, answers indented by four, tail."""
    blocks = F.filter(F.split(strip(content), rf"\n{SPACE}*\n", -1), has_text)
    return F.concat(F.array_join(_laid_out(blocks, correct_first), "\n\n"), F.lit("\n"))
