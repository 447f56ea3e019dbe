"""Documents with leftovers of templates, filler, or messages of servers instead of content.

Records of one template are aligned with each other, which shows where its
slots are; a slot that keeps a variable's name, an instruction or an empty
value where its siblings are filled is a leftover. In detail:

* Each document is cut into clauses. A clause's template is its function words
  with everything else as slots (its other words where it has none of them).
  The templates are counted over the corpus.
* A *mark* is what may be an unfilled slot: a chunk between sigils, as
  ``{{name}}``, ``%NAME%`` or ``[Your Name]``, an instruction to fill a place
  in, or a program's empty value. A mark is *aligned* when filled records, two
  at least, have the same template but for the mark: the same elements before
  it and after it, and up to two others or none in its place or behind it (an
  alignment with a bounded edit, made as an equi-join on hashes of both sides).
* A name that aligned marks hold is a variable's when it stands in several
  shapes of mark, or looks like an identifier, or is an instruction. Every mark
  that holds such a name is a leftover, so marks in records without siblings
  are found through those that have some. Emphasis, formulas and lists in
  brackets hold no such names.
* Lines at the end of a document, from the first that reads like a message of
  a server on, are aligned word by word: words that recur are the template, the
  others its slots. A template most of whose lines read like a message is one
  when it recurs; templates that recur on such pages and hardly elsewhere are
  their furniture; a document whose end is a run of both, with a message among
  them, is a page.
* Words that recur in endings with known filler words are filler words too, and
  an ending made of them is filler. Try-out phrases count where they recur.
* A line that recurs with several empty values in its slots is an unfilled one.

Lists of words only propose: what fills a place in, what servers say, what
try-outs are made of. What is shown as code or quotation is blanked first, and
marks beside words that speak about templates are left out.

Defined cases: null, empty and blank texts are no cases; each duplicate is a
case of its own, and repeated ids are reported once; texts of any length are
read whole, in time linear in their length; an empty table gives an empty
result; other columns are not read. What stands in one record of its kind has
nothing to be aligned with, so a small corpus shows less than a large one.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aulamill.operators.work import join_skewed, stored

# ---- what is shown, not said ----------------------------------------------

SHOWN = re.compile(
    r"```.*?(?:```|\Z)|`[^`\n]*`|«[^»\n]*»|“[^”\n]*”|(?<![\w=\"])\"[^\"\n]+\"(?!\w)|(?<!\w)'[^'\n]+'(?!\w)", re.S
)
# Words of texts that speak about templates, without accents.
ABOUT = re.compile(r"\b(?:syntax|sintaxis|sintaxe|placeholders?|marcador(?:es)? de posicion|handlebars|mustache|jinja)\b")

# ---- marks ----------------------------------------------------------------

NAME = r"[A-Za-z_][\w.]*\w"
FILTER = r"(?: *\|[^{}%\n]*)?"
SEVERAL = r"[^\W\d_]+(?: [^\W\d_]+)+"
#: Shapes of marks. Those marked certain are used for nothing else in prose.
SHAPES = {
    "{{}}": (rf"\{{\{{ *({NAME}){FILTER} *\}}\}}", True),
    "${}": (rf"\$\{{ *({NAME}){FILTER} *\}}", True),
    "#{}": (rf"#\{{ *({NAME}) *\}}", True),
    "{%%}": (rf"\{{% *({NAME}){FILTER} *%\}}", True),
    "<%%>": (rf"<%=? *({NAME}) *%>", True),
    "%()": (rf"%\(({NAME})\)[sdf]", True),
    "@@": (rf"@@({NAME})@@", True),
    "%%": (rf"%%({NAME})%%", True),
    "%": (r"(?<![\w%])%([A-Z][A-Z0-9_]*[A-Z0-9])%(?![\w%])", True),
    "$$": (rf"(?<![\w$\\])\$({NAME})\$(?![\w$])", False),
    "[[]]": (rf"\[\[ *({NAME}) *\]\]", False),
    "<<>>": (rf"<< *({NAME}) *>>", False),
    "__": (rf"(?<!\w)__({NAME})__(?!\w)", False),
    "[]": (rf"(?<![\w\[!])\[({NAME}|{SEVERAL})\](?![\](])", False),
    "<>": (rf"(?:&lt;|(?<![<\w])<)({NAME}|{SEVERAL})(?:&gt;|>(?!>))", False),
    "{}": (rf"(?<![\w{{$#%\\}}])\{{({NAME}|{SEVERAL})\}}(?!\}})", False),
}
SLOT = re.compile("|".join(p for p, _ in SHAPES.values()))
SIGIL = re.compile(r"[{$#<%@\[&(]|__|(?i:\b(?:todo|fixme|tbd): |\bx{3,} )")
SHAPE_LIST = list(SHAPES.items())
# Elements of the stored formats, which are no marks.
ELEMENTS = {
    "p", "b", "i", "em", "strong", "code", "pre", "br", "html", "body", "head", "title", "h1", "h2", "h3", "ul", "ol", "li", "span", "div",
    "text", "question", "questiontext", "answer", "name", "feedback", "generalfeedback", "tags", "tag", "quiz", "category", "table", "tr", "td",
    "markdown", "moodle", "plain",
}

# Words of instructions to fill a place, in Spanish, English and Portuguese, without accents.
PUT = "insertar|inserte|insert|inserir|insira|escriba|escribir|type|write|escreva|escrever|redactar|redigir|rellenar|fill|preencher|completar|complete|anadir|add|poner|put"
OPEN = "pendiente|pending|pendente|tbd|tba|todo|fixme|por definir|por completar|por hacer|to be done|to do|a definir|provisional"
HERE = "aqui va|aqui ira|aqui viene|aqui fica|aqui vai|aqui entra|here goes|goes here|here comes|aqui"
#: Instructions, by what they begin with; a chunk ends before the next one begins.
INSTRUCTIONS = {
    "[": re.compile(rf"\[(?:{PUT})\b[^\[\]\n]+\]|\[(?:{OPEN}):[^\[\]\n]+\]"),
    "<": re.compile(rf"<(?:{PUT})\b[^<>\n]+>|<(?:{OPEN}):[^<>\n]+>"),
    "&": re.compile(rf"&lt;(?:{PUT})\b[^<>&\n]+&gt;|&lt;(?:{OPEN}):[^<>&\n]+&gt;"),
    "(": re.compile(rf"\((?:{HERE}|{PUT})\b[^()\n]+\)|\((?:{OPEN}):[^()\n]+\)"),
    "x": re.compile(rf"x{{3,}} (?:(?:{OPEN})\b|[^x\n](?:[^x\n]|x(?!xx))* x{{3,}})"),
}
TO_DO = re.compile(rf"(?:todo|fixme|tbd): *(?:{PUT})\b")
IS_OPEN = re.compile(rf"\b(?:{OPEN})\b")
EMPTY_VALUE = re.compile(r"\[object Object\]|\b(?:undefined|null|NaN|None|nil)\b")

# ---- clauses --------------------------------------------------------------

CLAUSE = re.compile(r"[^.!?\n,;:{}=~#¿¡]+")
RUN = re.compile(r"\*(?: \*)+")
HELD = re.compile(r"\x02(\d+)\x03")
#: Filled records that a template needs, and elements that may stand where a mark does.
SIBLINGS, GAP = 2, 2
#: Size of the filter that tells whether a place may be a mark's.
PLACE_BITS = 1 << 24

# ---- lines of pages -------------------------------------------------------

TAGS = re.compile(r"<!\[CDATA\[|\]\]>|</?[A-Za-z][\w:-]*(?:[^<>\"]|\"[^\"<>]*\")*>|::(?:[^:\n]|:(?!:))*::|^\[(?:html|markdown|moodle|plain)\]|\{\}", re.M)
#: The longest sentence that a message has. Documents of lines up to this length weigh against furniture if they have no message.
LONGEST_MESSAGE = 18  # words
MESSAGE_SENTENCE = re.compile(r"(?:[^.!?\n]|[.](?=\S))+[.!?]*")
# What sentences that set a task begin with, and words of those that say what something is about, without accents.
TASK = re.compile(r"^(?:propon|proponha|propose|explica|explique|explain|describe|descreva)\b|\b(?:tratan? de|is about|are about|deals? with)\b")
#: A word is part of a template, and no slot's value, from so many documents and this share of them on.
SAME_WORD, SAME_SHARE = 3, 0.002
# What messages of servers and browsers say, without accents, lower case. The parts of a message,
# between the dots, stand in this order.
MESSAGES = r"""^(?:http/?[\d.]*|erro?r?|estado|status|codigo|code)\W*[45]\d\d\b
    ^[45]\d\d\b\W*(?:\w+\W*){1,5}$
    \b(?:session|sesion|sessao)\ (?:\w+\ ){0,2}(?:expir\w*|caducad\w*|timed\ out|terminad\w*)\b
    \b(?:enable|activ\w+|aktivier\w*|habilit\w+|ative|ligue|turn(?:ed)?\ (?:\w+\ )?on|allow|permita)\b ... \b(?:java ?script|scripts?|cookies?|secuencias\ de\ comandos)\b
    \b(?:java ?script|scripts?|cookies?|secuencias\ de\ comandos)\b ... \b(?:off|disabled|required|blocked|aktivier\w*|desactivad\w+|deshabilitad\w+|desligad\w+|desativad\w+|bloquead\w+|necesari\w+|obligatori\w+|turn\ them\ on)\b
    \b(?:needs?|requires?|necesita|requiere|precisa|necessita|requer)\b ... \b(?:java ?script|cookies?|scripts?)\b
    \b(?:browser|navegador)\b ... \b(?:not|no|nao)\b ... \b(?:scripts?|java ?script|cookies?)\b
    \b(?:page|pagina|seite|site|sitio)\b ... \b(?:not|no|nao|nicht)\b ... \b(?:exists?|existe|found|encontr\w+|gefunden)\b
    \b(?:can't|cannot|can\ not|couldn't|could\ not)\ find\ (?:that|the|this)\ page\b
    \b(?:page|pagina)\b ... \b(?:moved|movid[oa])\b
    \b(?:checking\ your\ browser|before\ accessing\ the\ site)\b
    ^just\ a\ moment\b
    \b(?:not\ found|no\ encontrad[oa]|nao\ encontrad[oa]|forbidden|prohibido|bad\ gateway|bad\ request|internal\ server\ error|too\ many\ requests)\b
    \b(?:service|server|servicio|servidor|servico)\b ... \b(?:unavailable|not\ available|no\ esta\ disponible|indisponivel|no\ disponible|nao\ esta\ disponivel|down|caido)\b
    \b(?:gateway|pasarela|connection|conexion|conexao|request|espera)\b ... \b(?:time[d-]?\ ?out|timeout|agotad\w+|esgotad\w+|refused|rechazad\w+|recusad\w+)
    \b(?:tiempo\ de\ espera|tempo\ limite)\b
    \b(?:access|acceso|acesso|permission|permiso)\b ... \b(?:denied|denegad\w+|negad\w+)\b
    \b(?:log|sign)\ in\b ... \b(?:to|again|once)\b
    \b(?:iniciar|inicie|inicia)\ (?:la\ )?(?:sesion|sessao)\b
    \bidentifi(?:cate|quese|que-se)\b
    \bfaca\ login\b
    \b(?:unexpected|internal|fatal)\ (?:\w+\ )?error\b
    \berr(?:or|o)\ (?:inesperado|interno|fatal)\b
    \bsomething\ went\ wrong\b
    \balgo\ (?:ha\ ido|salio|fue|correu)\ mal\b
    \b(?:could\ not|cannot|can't|failed\ to|no\ se\ ha\ podido|no\ se\ pudo|no\ se\ puede|nao\ foi\ possivel)\b ... \b(?:read|load|connect|open|show|shown|leer|cargar|conectar|abrir|mostrar|ler|carregar|ligar)
    ^traceback\b
    ^fatal\ error\b
    ^(?:uncaught\ )?\w*(?:error|exception)\b:
    \bcall\ to\ undefined\b
    ^file\b ... ,\ line\ [\d#]+
    \bstack\ trace\b
    \bon\ line\ [\d#]+$
    \b(?:under\ maintenance|en\ mantenimiento|em\ manutencao)\b"""
RULES = [[re.compile(part.replace("\\ ", " ")) for part in rule.strip().split(" ... ")] for rule in MESSAGES.split("\n")]
FIRST = re.compile("|".join(rule[0].pattern for rule in RULES))
WORDS = re.compile(r"\w+")

# ---- filler ---------------------------------------------------------------

# Function words; ordinary sentences of the languages hold some.
FUNCTION = set(
    """a al ao aos as com como con cual da das de del desde do dos e el em en entre es esta este in is it its la las le les lo los mas na nas no nos
    o of on or os para per pero por que se ser si sin sobre son su sua sus tal the their this to u um uma un una uno und was were what when which who why with y ya
    and are at be by for from has have how if into not that than then cada each qual quando quem seu mediante hay ha han e é à às pela pelo""".split()
)
# Words of the usual filler text that are no words of the languages here.
LATIN = set("lorem ipsum dolor amet consectetur adipiscing elit eiusmod incididunt aliqua veniam nostrud ullamco laboris nisi".split())
KEYBOARD = re.compile("asdf|qwer|zxcv|hjkl|sdfg")
# Try-out sentences, without accents, lower case, as a whole.
TRYOUT = re.compile(
    r"""^(?:(?:\w+\ ){0,2}(?:sample|example|dummy|placeholder|test|ejemplo|exemplo|prueba|teste|relleno)\ (?:text|texto|content|contenido|conteudo|question|pregunta|pergunta)
    |(?:text|texto|contenido|conteudo)\ de\ (?:ejemplo|exemplo|prueba|teste|relleno|muestra|amostra)
    |(?:text|texto|question|pregunta|pergunta|test|item)\b[\w\ ]{0,20}\b(?:prueba|test|teste|question)\b[\w\ ,]*\b(?:borrar|eliminar|delete|remove|apagar|ignorar|ignore)\b[\w\ ]*
    |(?:aqui|here|aca)\ (?:ira|va|viene|vai|ficara|fica|entra|goes|comes|estara)\ [\w\ ]{0,30}
    |[\w\ ]{0,30}\b(?:goes|comes|go)\ here)$""",
    re.X,
)
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


MARKS = re.compile("[\u0300-\u036f]+")


def plain(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return MARKS.sub("", unicodedata.normalize("NFD", text))


def words_of(line: str) -> str:
    """The words of a line, without accents and case, numbers as #."""
    return " ".join("#" if w[0].isdigit() else w for w in WORDS.findall(plain(line)))


def is_message(line: str) -> bool:
    """Whether a third of a line or more are sentences that read like a message of a server.

    A question, a task and a sentence longer than any message are none. Each rule is searched once, part by part.
    """
    total = reads = 0
    for sentence in MESSAGE_SENTENCE.findall(plain(line)):
        n = len(WORDS.findall(sentence))
        total += n
        if n > LONGEST_MESSAGE or "?" in sentence or "¿" in sentence or not FIRST.search(sentence := sentence.strip()) or TASK.search(sentence):
            continue
        for rule in RULES:
            at = 0
            for part in rule:
                found = part.search(sentence, at)
                if not found:
                    break
                at = found.end()
            else:
                reads += n
                break
    return reads > 0 and reads * 3 >= total


def marks(shown: str) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, shape, name, certain) of each mark in a text."""
    found, end = [], 0
    low = plain(shown) if SIGIL.search(shown) else ""
    if len(low) != len(shown):  # accents that are stored apart; instructions need the same places
        low = shown.lower() if len(shown.lower()) == len(shown) else shown
    for start in SIGIL.finditer(shown):
        at = start.start()
        if at < end:
            continue
        first = low[at]
        if first in "tfx":
            told = TO_DO.match(low, at) if first != "x" else INSTRUCTIONS["x"].match(low, at)
            if told and (first != "x" or IS_OPEN.search(told.group())):
                end = told.end()
                found.append((at, end, "open", WORDS.findall(told.group())[1] if first != "x" else "xxx", True))
            continue
        told = INSTRUCTIONS[first].match(low, at) if first in INSTRUCTIONS else None
        if told:
            end = told.end()
            found.append((at, end, f"{first} instruction", WORDS.findall(told.group().replace("&lt;", ""))[0], True))
            continue
        m = SLOT.match(shown, at)
        if m is None or shown.startswith("[object Object]", at):
            continue
        shape, (_, certain) = SHAPE_LIST[m.lastindex - 1]
        name = m.group(m.lastindex)
        if shape in ("<>", "[]", "{}") and name.lower() in ELEMENTS:
            continue
        end = m.end()
        found.append((at, end, shape, name, certain))
    return found


def identifier(name: str) -> bool:
    """Whether a name is one of a program rather than a word."""
    return "_" in name.strip("_") or "." in name or (name.isupper() and len(name) > 2) or name != name.lower() and name[1:] != name[1:].lower() and " " not in name


def elements(words: list[str]) -> list[str]:
    """The template of a clause: function words, and * for each run of others; with none of them, the words themselves."""
    kept = [w if w in FUNCTION else "*" for w in words]
    if not any(w != "*" for w in kept):
        kept = ["*" if w[0].isdigit() else w for w in words]
    return RUN.sub("*", " ".join(kept)).split(" ") if kept else []


PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)


def _sides(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all beginnings and of all ends of a template, each in time linear in its length."""
    import xxhash

    codes = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in parts), np.uint64, len(parts))
    powers = np.cumprod(np.full(len(parts), PRIME, np.uint64))
    zero = np.zeros(1, np.uint64)
    return np.concatenate([zero, np.cumsum(codes * powers)]), np.concatenate([np.cumsum(codes[::-1] * powers)[::-1], zero])


def _joined(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    mixed = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + after
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def split_keys(template: str) -> np.ndarray:
    """Keys of what stands before and after each place of a template where up to GAP elements may be left out."""
    parts = template.split(" ")
    before, after = _sides(parts)
    n = len(parts)
    return np.unique(np.concatenate([_joined(before[: n + 1 - gap], after[gap:]) for gap in range(min(GAP, n) + 1)]))


def mark_keys(clause: str) -> dict[int, list[int]]:
    """For each mark of a clause (by number), the keys of its surroundings, other marks left out or as slots."""
    pieces = HELD.split(clause)
    words = [WORDS.findall(p) for p in pieces[::2]]
    numbers = [int(p) for p in pieces[1::2]]
    found: dict[int, list[int]] = {}
    with_function = any(w in FUNCTION for ws in words for w in ws)

    def side(ws: list[str]) -> list[str]:
        kept = [(w if w in FUNCTION else "*") if with_function or w == "*" else "*" if w[0].isdigit() else w for w in ws]
        return RUN.sub("*", " ".join(kept)).split(" ") if kept else []

    for filler in ([], ["*"]) if len(numbers) > 1 else ([],):
        # The text before the i-th mark and after it; sums over all marks would be quadratic, so the sides grow by one.
        left: list[list[str]] = []
        sofar: list[str] = []
        for i, ws in enumerate(words[:-1]):
            sofar = sofar + ws if not i else sofar + filler + ws
            left.append(side(sofar))
        right: list[list[str]] = []
        sofar = []
        for i, ws in enumerate(reversed(words[1:])):
            sofar = ws + sofar if not i else ws + filler + sofar
            right.append(side(sofar))
        right.reverse()
        for number, before, after in zip(numbers, left, right, strict=True):
            if before[-1:] == ["*"] and after[:1] == ["*"]:
                after = after[1:]
            start = _sides(before)[0][-1:] if before else np.zeros(1, np.uint64)
            ends = _sides(after)[1] if after else np.zeros(1, np.uint64)
            for drop in range(min(GAP, len(after)) + 1):  # an instruction may go on behind the mark
                if before or len(after) > drop:
                    found.setdefault(number, []).append(int(_joined(start, ends[drop : drop + 1])[0]))
    return found


def tail(lines: list[str]) -> list[tuple[str, bool]]:
    """(words, reads like a message), last line first: from the first message on, or all of a document of short lines."""
    found = [(words_of(line), is_message(line)) for line in lines]
    first = next((i for i, (_, message) in enumerate(found) if message), None)
    if first is None and any(w.count(" ") >= LONGEST_MESSAGE for w, _ in found):
        return []
    return found[first or 0 :][::-1]


def tried_out(sentence: str) -> bool:
    """Whether a sentence is a try-out: a known one, or made of one word again and again and of rows of keys, before a known one."""
    words = WORDS.findall(sentence)
    rest, once, i = [], [], 0
    while i < len(words):
        end = i
        while end < len(words) and words[end] == words[i]:
            end += 1
        own = [w for w in words[i:end] if not KEYBOARD.search(w)]
        many = end - i >= 3 and len(words[i]) >= 2
        rest += [] if many else own
        once += own[:1] if many else own  # the last of a run may begin the known sentence
        i = end
    if not rest:
        return bool(words)
    if len(rest) == len(words):
        return bool(TRYOUT.match(sentence))
    return bool(TRYOUT.match(" ".join(rest)) or TRYOUT.match(" ".join(once)))


def ending(text: str) -> tuple[list[str], bool, list[str]]:
    """Words of the last sentences that have no function word, whether known filler words are among them, and the try-outs there."""
    words: list[str] = []
    known, tryouts = False, []
    for sentence in reversed(SENTENCE.findall(text)):
        sentence = sentence.strip(" .!?\t")
        own = WORDS.findall(sentence.lower())
        if not own:
            continue
        if tried_out(pieces := re.sub(r"[^\w ,]+", " ", plain(sentence)).strip()):
            rows = [KEYBOARD.findall(w) or [w] for w in WORDS.findall(pieces)]
            parts = [p for row in rows for p in row]
            unit = " ".join(sorted(set(parts)))
            tryouts += [unit] * (1 if len(parts) == len(set(parts)) else 2)  # one that repeats itself recurs by itself
            continue
        latin = sum(w in LATIN for w in own)
        if len(own) < 3 or any(w[0].isdigit() for w in own) or sum(w in FUNCTION for w in own) > latin:
            break
        words += own
        known |= latin > 0
    return words, known, tryouts


ANSWERS = re.compile(r"\{(?:\s*[=~][^\n{}=~]*)+\}\s*$")


def scan(text: str | None, templates: Counter | None = None) -> dict | None:
    """What may be residue in a text; None where nothing may be. ``templates`` gets those of its clauses without marks."""
    if not text or not text.strip():
        return None
    shown = SHOWN.sub(" ", text)
    found = marks(shown)
    body = shown
    if found:
        pieces, at = [], 0
        for i, (start, end, *_) in enumerate(found):
            pieces += [shown[at:start], f" \x02{i}\x03 "]
            at = end
        body = "".join([*pieces, shown[at:]])
    cut = ANSWERS.sub("", body)
    bare = TAGS.sub("\n", body)
    bare_cut = bare if cut == body else TAGS.sub("\n", cut)
    if "&" in bare:
        bare, bare_cut = html.unescape(bare), html.unescape(bare_cut)
    keys: dict[int, list[int]] = {}
    own: set[str] = set()
    about: set[int] = set()
    for line in plain(bare).split("\n"):
        for clause in CLAUSE.findall(line):
            if "\x02" in clause:
                keys |= mark_keys(clause)
                if ABOUT.search(clause):
                    about.update(map(int, HELD.findall(clause)))
            elif templates is not None and (words := WORDS.findall(clause)):
                own.add(" ".join(elements(words)))
    if templates is not None:
        templates.update(own)
    without = HELD.sub(" ", bare_cut)
    lines = [line for line in (x.strip() for x in without.split("\n")) if line]
    last = tail(lines)
    empties = [(words_of(EMPTY_VALUE.sub(" 0 ", x)), len(values), "[object Object]" in values) for x in lines if (values := EMPTY_VALUE.findall(x))]
    words, known, tryouts = ending("\n".join(lines))
    kept = [
        (shape, name.lower(), certain, identifier(name) or "instruction" in shape or shape == "open", keys.get(i, []))
        for i, (_, _, shape, name, certain) in enumerate(found)
        if i not in about
    ]
    if not (kept or last or empties or words or tryouts):
        return None
    return {"marks": kept, "tail": last, "empties": empties, "words": words, "known": known, "tryouts": tryouts}


MARK_TYPE = pa.struct([("shape", pa.string()), ("name", pa.string()), ("certain", pa.bool_()), ("named", pa.bool_()), ("keys", pa.list_(pa.int64()))])
TAIL_TYPE = pa.struct([("template", pa.string()), ("message", pa.bool_())])
EMPTY_TYPE = pa.struct([("template", pa.string()), ("n", pa.int32()), ("sure", pa.bool_())])
SCANNED = (
    "doc_id long, marks array<struct<shape string, name string, certain boolean, named boolean, keys array<long>>>,"
    " tail array<struct<template string, message boolean>>, empties array<struct<template string, n int, sure boolean>>,"
    " words array<string>, known boolean, tryouts array<string>, template string, n long"
)


def scanned(documents: DataFrame) -> DataFrame:
    """What may be residue, one row per document that has any of it; rows without an id count a template's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(MARK_TYPE), pa.list_(TAIL_TYPE), pa.list_(EMPTY_TYPE), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.string())]
        fields = ["marks", "tail", "empties", "words", "known", "tryouts"]
        names = [["shape", "name", "certain", "named", "keys"], ["template", "message"], ["template", "n", "sure"]]
        for batch in batches:
            templates: Counter = Counter()
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (found := scan(text, templates)) is not None:
                    for field, inner in zip(fields, names):
                        found[field] = [dict(zip(inner, x, strict=True)) for x in found[field]]
                    rows.append((key, found))
            n, m = len(rows), len(templates)
            columns = [pa.array([r[0] for r in rows] + [None] * m, pa.int64())]
            columns += [pa.array([r[1][f] for r in rows] + [None] * m, t) for f, t in zip(fields, types, strict=True)]
            columns += [pa.array([None] * n + list(templates), pa.string()), pa.array([None] * n + list(templates.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *fields, "template", "n"])

    return documents.select("doc_id", "text").mapInArrow(run, SCANNED)


# ---- alignment over the corpus --------------------------------------------


def filled_places(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(key): surroundings of marks that SIBLINGS records or more fill.

    Of the places of all templates only those that may be a mark's leave the
    task, by a filter of PLACE_BITS bits, whatever the data.
    """
    key = found.select(F.explode("keys").alias("key")).select(F.col("key").bitwiseAND(F.lit(PLACE_BITS - 1)).alias("bit"))
    words = key.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    )
    filter_bits = np.zeros(PLACE_BITS // 64, np.uint64)
    for r in words.collect():  # at most PLACE_BITS / 64 rows
        filter_bits[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    shared = found.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places = split_keys(text)
                bit = places.view(np.uint64) & np.uint64(PLACE_BITS - 1)
                places = places[(known[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
                keys.append(places)
                counts.append(np.full(len(places), n, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], ["key", "n"])

    each = templates.groupBy("template").agg(F.sum("n").alias("n")).mapInArrow(run, "key long, n long")
    return each.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= SIBLINGS).select("key")


def _joined_by(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the distinct keys of ``keyed``, hot ones split."""
    sizes = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_of_key")).join(keyed, key), "keys-in-both")
    total = sizes.agg(F.coalesce(F.sum("n_of_key"), F.lit(0))).head()[0]
    return join_skewed(rows, sizes, key, "n_of_key", total)


def unfilled_marks(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id) of documents with a mark that holds the name of a variable, as the aligned marks show it."""
    each = found.select("doc_id", "shape", "name", "certain", "named", F.explode("keys").alias("key"))
    aligned_marks = _joined_by(each, filled_places(found, templates), "key")
    several = F.countDistinct("shape") >= 2
    names = (
        aligned_marks.groupBy("name")
        .agg(
            several.alias("several"),
            F.bool_or(F.col("named") | F.col("certain")).alias("own"),
        )
        .where("several or own")
        .select("name")
    )
    return _joined_by(found.select("doc_id", "name"), names, "name").select("doc_id")


def aligned(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, message, template): lines with the words that don't recur cut to slots.

    A word belongs to a template when at least SAME_WORD documents, and
    SAME_SHARE of those with a tail, have it; all joins are over tails only.
    """
    words = lines.select("doc_id", "pos", "message", F.posexplode(F.split("template", " ")).alias("at", "word"))
    n_docs = lines.agg(F.countDistinct("doc_id")).head()[0]
    least = max(SAME_WORD, int(n_docs * SAME_SHARE))
    seen = words.groupBy("word").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("n"))
    frequent = stored(seen.where(F.col("docs") >= least).select("word", "n"), "tail-words")
    total = words.count()
    kept = join_skewed(words, frequent, "word", "n", total)
    # The words of one line come together again, those of one line of a document.
    built = kept.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    size = lines.select("doc_id", "pos", "message", F.size(F.split("template", " ")).alias("size"))
    template = F.concat_ws(
        " ", F.transform("w", lambda x: F.concat(x["at"].cast("string"), F.lit("."), x["word"])), F.col("size").cast("string")
    )
    return size.join(built, ["doc_id", "pos"], "left").select("doc_id", "pos", "message", template.alias("template"))


def page_templates(lines: DataFrame, least: int = 2) -> DataFrame:
    """(template, is_message, n): templates that recur and are a message or a page's furniture.

    A template without a fixed word - its length alone - is neither.
    """
    with_message = F.max(F.col("message").cast("int"))
    pages = lines.groupBy("doc_id").agg(with_message.alias("page"))
    seen = lines.where(F.col("template").contains(".")).join(pages, "doc_id").groupBy("template").agg(
        F.countDistinct("doc_id").alias("docs"),
        F.count(F.lit(1)).alias("n"),
        F.avg("page").alias("on_pages"),
        F.avg(F.col("message").cast("int")).alias("message"),
    )
    return seen.where((F.col("docs") >= least) & ((F.col("message") >= 0.5) | (F.col("on_pages") >= 0.6))).select(
        "template", (F.col("message") >= 0.5).alias("is_message"), "n"
    )


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, reason) of documents with residue; a document can have several reasons."""
    everything = stored(scanned(documents), "residue-scan")
    parts = everything.where("template is null").drop("template", "n")
    templates = everything.where("template is not null").select("template", "n")
    reason = lambda df, text: df.select("doc_id", F.lit(text).alias("reason"))

    found = stored(parts.select("doc_id", F.inline("marks")), "marks")
    slotted = reason(unfilled_marks(found, templates), "slot keeps its name")

    lines = parts.select("doc_id", F.posexplode("tail").alias("pos", "t")).select("doc_id", "pos", "t.template", "t.message")
    lines = stored(aligned(stored(lines.dropDuplicates(["doc_id", "pos"]), "tails")), "aligned-tails")
    kinds = stored(page_templates(lines), "page-templates")
    known = join_skewed(lines, kinds, "template", "n", lines.count()).select("doc_id", "pos", "is_message")
    # The run of known lines from the end: the lines before it are as many as its length only if none is missing.
    ranked = known.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "is_message"))).alias("run")  # at most the lines of one document
    )
    unbroken = F.filter("run", lambda x, i: x["pos"] == i)
    pages = reason(ranked.where(F.exists(unbroken, lambda x: x["is_message"])), "page of a server")

    empties = parts.select("doc_id", F.inline("empties"))
    hollow = empties.groupBy("template").agg(F.max("n").alias("most"), F.max("sure").alias("sure"), F.countDistinct("doc_id").alias("docs"))
    hollow = hollow.where("(most >= 2 or sure) and docs >= 2").select("template")
    unfilled = reason(_joined_by(empties.select("doc_id", "template"), hollow, "template"), "slot holds an empty value")

    tryouts = parts.select("doc_id", F.explode("tryouts").alias("sentence"))
    recurring = tryouts.groupBy("sentence").agg(F.count(F.lit(1)).alias("times")).where("times >= 2").select("sentence")
    tried = reason(_joined_by(tryouts, recurring, "sentence"), "try-out")

    words = parts.where("size(words) > 0").select("doc_id", "known", F.explode("words").alias("word"))
    filler = (
        words.distinct().groupBy("word").agg(F.avg(F.col("known").cast("int")).alias("share"), F.count(F.lit(1)).alias("docs"))
    ).where("share >= 0.5 and docs >= 3").select("word")
    counts = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    endings = _joined_by(words.select("doc_id", "word"), filler, "word").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_filler"))
    filled = reason(endings.join(counts, "doc_id").where("n_filler >= 4 and n_filler >= 0.8 * n"), "filler")
    return slotted.union(pages).union(unfilled).union(tried).union(filled).distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id").distinct()


def p8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases with what was found in them."""
    return residue(spark.read.parquet(f"{sf_dir}/documents.parquet"))
