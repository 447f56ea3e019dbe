"""Encoding, packing and residue."""

import os
import random
from collections import defaultdict

import pytest

from aulamill.llm import encoding, packing, residue

have_vocabulary = pytest.mark.skipif(not os.path.exists(encoding.VOCABULARY), reason="the public vocabulary is not here")

TEXTS = [
    "", None, "Hello world", "  spaces   here \n\n\t", "¿Qué componente? 12345 ３", "a" * 5000, "ab" * 3000, " " * 700, "<|endoftext|>", "naïve 𝔘𝔫𝔦 🜁 \U0001f469‍\U0001f52c",
    "\x00\x7f́e", "don't we'll I'M", "=" * 257 + "\r\n", "тест и очередь", "日本語テキスト" * 40,
]


# ---- p6


@have_vocabulary
def test_encoding_equals_public_library(spark):
    import tiktoken

    ranks = {t: i for i, t in enumerate(encoding.read_ranks(encoding.VOCABULARY))}
    exact = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("abcdefgh éñ.,0_\n") for _ in range(rng.randrange(300))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encoding.encoded(rows).collect()}
    assert got == {i: exact.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in encoding.counted(rows).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


@have_vocabulary
def test_round_trip_and_edges(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    back = {r.doc_id: r.text for r in encoding.decoded(encoding.encoded(rows)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encoding.encoded(spark.createDataFrame([], rows.schema)).count() == 0


@have_vocabulary
def test_every_token_is_its_own_encoding():
    tables = encoding.Tables(encoding.read_ranks(encoding.VOCABULARY))
    encoder = encoding.Encoder(tables)
    sample = random.Random(7).sample(range(len(tables.tokens)), 3000)
    assert all(list(encoder.merge(tables.tokens[i])) == [i] for i in sample)
    assert len(tables.pairs) == len(tables.tokens) - 256


def test_backtracking_on_a_small_vocabulary():
    """Merges by rank, one at a time, on every string of a small alphabet."""
    tokens = [bytes([c]) for c in b"abc"] + [b"ab", b"bc", b"aa", b"abab", b"cab", b"bcab", b"aab"]
    tables = encoding.Tables(tokens)
    encoder = encoding.Encoder(tables)

    def by_rank(data):
        parts = [tokens.index(bytes([c])) for c in data]
        while True:
            best = min(((tables.pairs[a << 20 | b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a << 20 | b in tables.pairs), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [best[0]]

    rng = random.Random(8)
    for _ in range(3000):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
        assert list(encoder.merge(data)) == by_rank(data)


# ---- p7


def best_fit_row_by_row(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(fit)] -= s
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_whole_and_tight(spark, seed):
    rng = random.Random(seed)
    capacity = [10, 64, 64, 1024][seed]
    sizes = [rng.choice([0, None, 1, 2, rng.randrange(1, capacity), capacity, rng.randrange(capacity, 4 * capacity)]) for _ in range(400)]
    if seed == 2:
        sizes = [7] * 300 + [None] * 3  # one size only
    items = spark.createDataFrame([(i // 2, n) for i, n in enumerate(sizes)], "doc_id long, n_tokens long")  # repeated ids
    rows = packing.packed(items, capacity=capacity).collect()
    fill, spans, parts = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in rows:
        assert 0 < r.n <= capacity
        fill[r.container_id] += r.n
        spans[r.container_id].append((r.position, r.position + r.n))
        parts[r.doc_id] += r.n
    assert all(f <= capacity for f in fill.values())
    for found in spans.values():
        found.sort()
        assert found[0][0] == 0 and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    want = defaultdict(int)
    for i, n in enumerate(sizes):
        if n:
            want[i // 2] += n
    assert dict(parts) == dict(want)
    assert sorted(fill) == list(range(len(fill)))
    whole = sum(n // capacity for n in sizes if n)
    rest = [n % capacity for n in sizes if n and n % capacity]
    assert len(fill) <= whole + best_fit_row_by_row(rest, capacity)
    assert sum(1 for r in rows) == whole + len(rest)


def test_packing_is_checked(spark):
    pieces = spark.createDataFrame([(0, 1, 0, 0, 6, 0), (0, 2, 0, 0, 5, 5), (1, 3, 0, 0, 4, 1), (2, 4, 0, 0, 2, 0)], "container_id long, doc_id long, piece long, start long, n long, position long")
    sizes = spark.createDataFrame([(1, 6), (2, 5), (3, 5), (4, 2), (5, 1), (6, 0)], "doc_id long, n_tokens long")
    row = packing.check_packing(pieces, sizes, capacity=8).head()
    assert (row.n_overfull, row.n_with_holes, row.n_wrong_items, row.n_items, row.n_containers) == (1, 2, 2, 5, 3)
    good = packing.check_packing(packing.packed(sizes, capacity=4), sizes, capacity=4).head()
    assert (good.n_overfull, good.n_with_holes, good.n_wrong_items, good.n_items) == (0, 0, 0, 5)


def test_packing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.packed(none).count() == 0
    one = spark.createDataFrame([(1, 3000, 5)], "doc_id long, n_tokens long, piece int")
    rows = packing.packed(one).orderBy("piece").collect()
    assert [(r.piece, r.start, r.n) for r in rows] == [(0, 0, 1024), (1, 1024, 1024), (2, 2048, 952)]


# ---- p8

PAGES = [
    "Home > Courses\n\nPlease enable JavaScript in your browser to view this quiz.",
    "Tu sesión ha caducado. Identifícate otra vez.\n« Volver",
    "<html><body><h1>Error 404</h1><p>La página que buscas no existe o se ha movido.</p></body></html>",
    "El sistema guarda la pila del gra\nAcceso denegado. Debe iniciar sesión para ver el cuestionario {}.",
    "::Título del tema::[html]<p>Su navegador no ejecuta scripts; la pregunta {} no se puede mostrar.</p>{{}}",
    "ERROR 503: EL SERVICIO NO ESTÁ DISPONIBLE. INTÉNTALO DE NUEVO DENTRO DE {} MINUTOS.",
]
#: Templates of records, what fills their slot, and marks that were left in it.
RECORDS = {
    "Querido {}, tu entrega llega tarde": (["Ana", "Luis", "Marta"], ["{{nombre}}", "${nombre}", "%FIRST_NAME%", "[Your Name]", "<nombre del alumno>", "<your name>", "[nombre del alumno]"]),
    "El filtro de los {} tardíos se vacía en el nodo": (["datos", "bloques", "avisos"], ["$tema$", "[[tema]]", "__TEMA__", "<<TEMA>>"]),
    "La tabla guarda {} en el disco para la clase": (["el hilo", "la pila", "una cola"], ["[INSERTAR el título AQUÍ]", "XXXX opción B PENDIENTE XXXX", "(aquí va la imagen)", "TODO: redactar la explicación", "{{ user.name | default('x') }}", "<ESCRIBA enunciado>", "&lt;ESCRIBA enunciado&gt;"]),
}
CASES = [
    "Hola undefined, tu nota en null es NaN.", "Hola null, tu nota en undefined es null.", "Hola [object Object], bienvenido", "Hola [object Object], bienvenido",
    "asdf asdf qwer Texto de ejemplo. asdf asdf qwer ", "test test test Test question, delete later. test test test ", "asdf" * 2500,  "asdf" * 2500 + " asdf asdf",
    "Pregunta de prueba, borrar luego. Pregunta de prueba, borrar luego. ", "::Un título::Aquí irá el texto definitivo. {=dapib ~rebit}", "Aquí irá el texto definitivo.",
    "El curso trata la pila.\nLorem ipsum velunt quimdo sedis. Vitare rebit amet lorem dapib. Quorsa rebit velunt sedis.",
    "Velunt quimdo sedis rebit. Vitare amet dapib rebit lorem.", "Quorsa sedis velunt rebit dapib. Ipsum vitare rebit quimdo.",
    *["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt."] * 3, "Dapib velunt quorsa vitare. Sedis amet quimdo.", "Rebit vitare dapib sedis quorsa velunt quimdo.",
]
CONTENT = [
    None, "", " \n\t", "Nota: es __importante__ repasar la pila del disco; `cout << x << endl;` muestra 57.", "Demuestra que $\\frac{6}{x}$ crece; usa $x$ como incógnita.",
    "Escribe una función que reciba [[1, 2], [3, 5]] y calcule el hilo.", "En la plantilla la expresión `{{ tema }}` se sustituye por el hilo.", "TODO el grupo debe entregar el hilo antes del 82.",
    "Al abrirlo un alumno lee «Acceso denegado. Debe iniciar sesión». ¿Qué permiso le falta?", "What happens when JavaScript is turned off in the browser? Give reasons.",
    "El texto «lorem ipsum» se usa como relleno. ¿Por qué lo evita?", "```\nTraceback (most recent call last):\nKeyError: 'x'\n```\n¿Qué causa el fallo?",
    "La función `printf(\"%s: %d\", a, 2)` muestra el hilo.", "Señal del disco lento", "Prueba del flujo alterno", "¿Qué indica el código 404 cuando pide el hilo?{=Que no existe ~Otra}",
    "Un servidor contesta 503 cada 81 minutos. Propón cómo avisaría de que el servicio no está disponible sin tocar el hilo del usuario ni la pila del disco lento de la red.",
]


def test_residue(spark):
    pages = [p.format(f"{w}{'abcdef'[i]}") for i, p in enumerate(PAGES) for w in ("Lorensa", "Mitoro", "Vakelu", "Zumita")]
    cases = pages + CASES + [t.format(m) for t, (_, left) in RECORDS.items() for m in left]
    filled = [t.format(w) for t, (words, _) in RECORDS.items() for w in words]
    rows = [(i, t, "x") for i, t in enumerate([*cases, *CONTENT, *filled])]
    table = spark.createDataFrame(rows, "doc_id long, text string, reason string")
    found = {r.doc_id for r in residue.residue(table).collect()}
    texts = [t for _, t, _ in rows]
    assert [texts[i][:80] for i in sorted(set(range(len(cases))) - found)] == []
    assert [texts[i][:80] for i in sorted(found - set(range(len(cases))))] == []


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("Just a moment... Checking your browser before accessing the site", True),
        ("We can't find that page", True),
        ("Bitte aktivieren Sie JavaScript in Ihrem Browser", True),
        ("Veuillez activer JavaScript", True),
        ("Serviço indisponível (504). Tente de novo em 367 minutos.", True),
        ("What happens when JavaScript is turned off in the browser? Give reasons.", False),
        ("La pregunta 439 trata de errores de sesión caducada.", False),
        ("Propón cómo avisaría de que el servicio no está disponible.", False),
    ],
)
def test_messages(text, message):
    assert residue.is_message(text) is message


def test_scan_is_linear():
    """Texts made to backtrack end at once."""
    import time

    units = ["asdf", "page no ", "[insert ", "xxx ", "{{a ", "'a ", '"a', "a:: ", "::a", "{=a", "a ", "<a \"b", "{{x_y}} a ", "(poner "]
    for text in [u * (2_000 if "x_y" in u else 100_000) for u in units] + ["asdf" * 2500 + ", hola"]:
        began = time.time()
        residue.scan(text)
        assert time.time() - began < 10, text[:10]


def test_alignment_finds_the_place():
    """A mark's surroundings are among those of templates with up to two more elements in its place, and no others."""
    place = lambda clause: residue.mark_keys(clause)[0][0]
    keys = set(residue.split_keys("el * para la * de *").tolist())
    assert place("el \x020\x03 para la copia de red") in keys
    assert place("el curso \x020\x03 bueno para la copia de red") in keys
    assert place("el curso para la copia \x020\x03 red") in keys
    assert place("el curso por la copia \x020\x03 red") not in keys
    assert place("el \x020\x03 de red") not in keys


def test_speaking_about_templates_is_no_case(spark):
    rows = [(i, f"The handlebars syntax {{{{title}}}} inserts a variable {i}.") for i in range(4)]
    rows += [(10 + i, f"The course {w} uses a pointer {i}.") for i, w in enumerate(["A", "B", "C"])]
    assert residue.residue(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_residue_edges(spark):
    schema = "doc_id long, text string"
    assert residue.residue(spark.createDataFrame([], schema)).count() == 0
    long = "La pila del disco se actualiza cada 5 segundos. " * 20_000
    rows = [(1, long), (1, long + "La pila del {{tema}} se actualiza"), (2, None), (3, "La pila del {{tema}} se actualiza"), (4, ""), (5, long), (6, "La pila del nodo se actualiza"), (7, "La pila del disco se actualiza")]
    assert {r.doc_id for r in residue.residue(spark.createDataFrame(rows, schema)).collect()} == {1, 3}
