"""Operators on records and terms against brute force, with their defined cases."""

import random
import re

import numpy as np
import pytest

from aulamill.llm import history, lookalike, recurring, terms

WORD = re.compile(r"[^\W_]+")


def words(text):
    return tuple(w.lower() for w in WORD.findall(text or ""))


# ---- p1


def test_repeats_equal_brute_force(spark):
    rng = random.Random(1)
    titles = [None, "", "A b", "a  B!", "á b", "c"]
    stems = ["Uno, dos.", "uno dos", "UNO DOS", "dos uno", "", "¿?", None, "x" * 50_000, "Uno dós"]
    rows = [(i, rng.choice(titles), rng.choice(stems)) for i in range(400)]
    records = spark.createDataFrame(rows, "rec_id long, title string, stem string")
    group = {}
    for i, t, s in rows:
        group.setdefault((words(t), words(s)), []).append(i)
    want = {(min(g), i) for g in group.values() for i in g if i != min(g)}
    assert {(r.keep_id, r.dup_id) for r in recurring.repeats(records).collect()} == want
    one = recurring.collapse(recurring.survivors(records)).collect()
    assert {(r.keep_id, r.n_copies) for r in one} == {(min(g), len(g)) for g in group.values()}


def test_repeats_read_json_in_any_order(spark):
    questions = spark.createDataFrame([(1, "T", ("plain", "Hola, mundo"), "x")], "question_id long, title string, stem struct<fmt:string,text:string>, rec_id string")
    wire = spark.createDataFrame(
        [
            (2, '{"stem": {"text": "HOLA mundo", "format": "html"}, "title": "t."}'),
            (3, '{"title":"T","type":"MC","stem":{"format":"x","text":"hola \\u006dundo"}}'),
            (4, '{"type":"Category","title":"T"}'),
        ],
        "question_id long, payload string",
    )
    found = recurring.repeats(recurring.question_records(questions, wire)).collect()
    assert {(r.keep_id, r.dup_id) for r in found} == {(1, 2), (1, 3)}
    none = spark.createDataFrame([], questions.schema)
    assert recurring.repeats(recurring.question_records(none)).count() == 0


def test_repeats_of_one_group(spark):
    """A group that holds nearly all rows, as copies of one writing, comes out whole."""
    rows = spark.range(300_000).selectExpr("id as rec_id", "'t' as title", "if(id % 100 = 0, concat('s ', id), 'same') as stem")
    assert recurring.repeats(rows).count() == 297_000 - 1


# ---- p2


def make_changes(spark, rows):
    data = [(s, "tag", [{"term": t, "occurrences": n, "records": 1} for t, n in found] if found is not None else None) for s, found in rows]
    return spark.createDataFrame(data, f"sign int, term_kind string, terms {terms.TERMS}")


def test_deltas_equal_recount(spark, tmp_path, monkeypatch):
    """Each step is a session of its own; a step that fails half way changes nothing; buckets split as the table grows."""
    rng = random.Random(2)
    monkeypatch.setattr(terms, "ROWS_PER_BUCKET", 4)
    live, path = {}, str(tmp_path / "counts")
    terms.TermCounts.create(spark, path, buckets=4)
    for step in range(4):
        state = terms.TermCounts.open(spark, path)
        delta = []
        for key in rng.sample(sorted(live), len(live) // 3):
            delta.append((-1, live.pop(key)))
        for key in rng.sample(sorted(live), len(live) // 3):  # changed: the old one out, the new one in
            delta.append((-1, live[key]))
            live[key] = [(f"t{rng.randrange(8)}", 2)]
            delta.append((1, live[key]))
        for i in range(40):
            found = None if i == 0 else [(t, rng.randrange(1, 4)) for t in rng.sample([f"t{j}" for j in range(60)], 3)]
            live[step, i] = found
            delta.append((1, found))
        if step == 2:
            with monkeypatch.context() as broken:
                broken.setattr(terms, "commit", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    state.apply(make_changes(spark, delta))
            state = terms.TermCounts.open(spark, path)
        state.apply(make_changes(spark, delta))
        occurrences, records = {}, {}
        for found in live.values():
            for t, n in found or []:
                occurrences[t] = occurrences.get(t, 0) + n
                records[t] = records.get(t, 0) + 1
        rows = state.counts().collect()
        got = {r.term: (r.n_occurrences, r.n_records) for r in rows if r.term is not None}
        assert got == {t: (occurrences[t], records[t]) for t in records}
        assert [r.n_records for r in rows if r.term is None] == [len(live)]
    assert state.state["buckets"] >= 16


def test_terms_of_records(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(
        [([" a\t", "a", "", None, " ", "B b"], {"k": 2, "": 1, "z": None}), (None, None), ([], {})],
        "tags array<string>, by_category map<string,long>",
    )
    got = rows.select(terms.tag_terms(F.col("tags")).alias("t"), terms.map_terms(F.col("by_category")).alias("m")).collect()
    assert sorted(map(tuple, got[0].t)) == [("B b", 1, 1), ("a", 1, 0), ("a", 1, 1)]
    assert {tuple(x) for x in got[0].m} == {("k", 2, 1), ("", 1, 1), ("z", 0, 1)}
    assert (got[1].t, got[1].m, got[2].t) == (None, None, [])


def test_verdicts(spark, tmp_path):
    state = terms.TermCounts.create(spark, str(tmp_path))
    assert terms.with_verdict(state.counts()).count() == 0
    state.apply(make_changes(spark, [(1, [("often", 1)] if i < 11 else [(f"r{i // 3}", 1)]) for i in range(100)]))
    marks = {r.term: r.verdict for r in terms.with_verdict(state.counts()).collect()}
    assert marks["often"] == "common" and marks["r5"] is None and marks["r33"] == "rare"


# ---- p4


def brute_first(old, new):
    sets = [(i, set(words(t))) for i, t in [*old, *new]]
    out = {}
    for i, t in new:
        s = set(words(t))
        ids = [j for j, o in sets if j < i and s and o and 10 * len(s & o) >= 7 * len(s | o)]
        if ids:
            out[i] = min(ids)
    return out


def texts(rng, n, start, pool, base=()):
    out = []
    for i in range(n):
        if base and rng.random() < 0.5:
            t = list(rng.choice(base))
            for _ in range(rng.randrange(0, max(2, len(t) // 3))):
                t[rng.randrange(len(t))] = rng.choice(pool)
        else:
            t = [rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 8, 20, 35, 120]))]
        out.append((start + i, " ".join(t)))
    return out


@pytest.mark.parametrize(("vocabulary", "rare"), [(40, True), (40, False), (400, False), (3000, True)])
def test_history_equals_brute_force(spark, monkeypatch, tmp_path, vocabulary, rare):
    """With few and many words, with and without rare ones; small limits exercise every way a pair can be met."""
    monkeypatch.setattr(history, "COMMON_LEAST", 5 if rare else 0)
    monkeypatch.setattr(history, "SLACK_SHARE", 0.7)
    rng = random.Random(vocabulary)
    pool = [f"w{i}" for i in range(vocabulary)]
    old = texts(rng, 150, 1, pool)
    base = [t.split() for _, t in old if t]
    batches = [texts(rng, 60, 1000 * b, pool, base) for b in (1, 2)]
    known = history.History.create(spark, str(tmp_path / "h"), as_sets(spark, old))
    got, sofar = {}, list(old)
    for batch in batches:
        got |= {r.id: r.first_id for r in known.check(as_sets(spark, batch)).collect()}
    want = {}
    for batch in batches:
        want |= brute_first(sofar, batch)
        sofar += batch
    assert got == want
    assert len(want) > 20
    known.close(delete=True)
    assert not (tmp_path / "h").exists()


def as_sets(spark, rows):
    data = [(i, t, None) for i, t in rows]
    table = spark.createDataFrame(data, "k long, title string, stem struct<fmt:string,text:string>")
    return history.normalised(table, "k")


def test_history_outlives_its_session(spark, monkeypatch, tmp_path):
    """State, new session, next batch; a batch that failed half way and one that is checked twice change nothing; refits keep results."""
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(200)]
    old = texts(rng, 40, 1, pool)
    base = [t.split() for _, t in old if t]
    batches = [texts(rng, 70, 1000 * b, pool, base) for b in (1, 2, 3, 4)]
    path, got, want, sofar, fits = str(tmp_path / "h"), {}, {}, list(old), set()
    history.History.create(spark, path, as_sets(spark, old)).close()
    for number, batch in enumerate(batches):
        known = history.History.open(spark, path)
        if number == 2:
            with monkeypatch.context() as broken:
                broken.setattr(known, "_append_pieces", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    known.check(as_sets(spark, batch))
            known.close()
            known = history.History.open(spark, path)
        for _ in range(2 if number == 1 else 1):
            found = {r.id: r.first_id for r in known.check(as_sets(spark, batch)).collect()}
        got |= found
        fits.add(known.state["generation"])
        known.close()
        want |= brute_first(sofar, batch)
        sofar += batch
    assert got == want and len(fits) > 1


def test_history_spreads_hot_pieces(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(history, "HOT_LEAST", 20)
    monkeypatch.setattr(history, "COMMON_LEAST", 0)
    rows = [(i, "a b c d e f g h i j k l " + f"m{i % 7} n{i % 11} o{i % 13}") for i in range(1, 600)]
    new = [(1000 + i, "a b c d e f g h i j k l " + f"m{i} n{i} o{i}") for i in range(5)]
    known = history.History.create(spark, str(tmp_path / "h"), as_sets(spark, rows))
    assert known.state["hot"]
    assert {r.id: r.first_id for r in known.check(as_sets(spark, new)).collect()} == brute_first(rows, new)
    known.close()


def test_hot_pieces_are_found_before_the_history_is_written(spark, monkeypatch, tmp_path):
    """Contents with hot pieces are cut and written once; nothing of a first try stays."""
    monkeypatch.setattr(history, "HOT_LEAST", 20)
    monkeypatch.setattr(history, "COMMON_LEAST", 0)
    rows = [(i, "a b c d e f g h i j k l " + f"m{i % 7} n{i % 11} o{i % 13}") for i in range(1, 600)]
    known = history.History.create(spark, str(tmp_path / "h"), as_sets(spark, rows))
    assert known.state["hot"] and [p.name for p in (tmp_path / "h" / "contents").glob("v=*")] == [f"v={v}" for v in known.state["contents"]]
    known.close()


def test_sets_without_common_words_share_no_key():
    """Texts that have two common words each, and a rare one, meet at no piece of theirs."""
    import pyarrow as pa

    words = pa.array([f"a b rare{i}" for i in range(1000)])
    telling = np.zeros(history.SLOTS, np.float16)
    _, hashes = history.word_sets(pa.array(["a b"]))
    telling[history._slot(hashes)] = 1
    *_, stored, looked = history.Sketcher(telling, 5.0).pieces(words, True, True)
    assert np.unique(stored[1], return_counts=True)[1].max() == 1 and len(looked[1]) == 1000


def test_history_edges(spark, tmp_path):
    none = spark.createDataFrame([], "id long, canon string")
    known = history.History.create(spark, str(tmp_path / "h"), none)
    assert known.check(none).count() == 0
    rows = [(10, "a b c"), (11, "a b c"), (12, " ".join(f"x{i}" for i in range(5000))), (13, "c b a"), (14, " ".join(f"x{i}" for i in range(5001)))]
    assert {(r.first_id, r.id) for r in known.check(as_sets(spark, rows)).collect()} == {(10, 11), (10, 13), (12, 14)}
    assert {(r.first_id, r.id) for r in known.check(as_sets(spark, [(20, "a b c")])).collect()} == {(10, 20)}
    known.close()
    source = spark.createDataFrame([(1, None, None), (2, "¿?", ("p", "")), (3, "T", ("p", None)), (4, "b a", ("p", "A b"))], "k long, title string, stem struct<fmt:string,text:string>")
    assert [(r.id, r.canon) for r in history.normalised(source, "k").collect()] == [(3, "t"), (4, "b a a b")]


def test_chance_repeats_count(spark, tmp_path):
    """Two independent questions that share exactly 0.7 of their words repeat each other by the definition, planted or not."""
    old = "Búsqueda del paquete entrante Según el manual Torpifen, el contador de los certificados caducados debe ejecutarse en orden inverso aunque el análisis de la consulta anidada termine antes. Completa: en Nitorqua, la caché de la sesión abierta equivale a _____ unidades."
    new = "Vector del paquete entrante en Melraren Según el manual Bririxa, la caché de los certificados caducados debe ejecutarse en orden inverso aunque el contador de las etiquetas ausentes termine antes. Completa: en Nelsodri, la búsqueda de la consulta anidada equivale a _____ unidades."
    assert brute_first([(1, old)], [(2, new)]) == {2: 1}
    known = history.History.create(spark, str(tmp_path / "h"), as_sets(spark, [(1, old)]))
    assert {r.id: r.first_id for r in known.check(as_sets(spark, [(2, new)])).collect()} == {2: 1}
    known.close()


def test_sketches_never_hide_a_pair():
    rng = np.random.default_rng(3)
    sketcher = history.Sketcher(np.zeros(history.SLOTS, np.float16), 5.0)
    import pyarrow as pa

    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = {f"w{i}" for i in rng.integers(0, 80, n)}
        b = set(list(a)[: max(1, int(len(a) * 0.9))]) | {f"v{i}" for i in rng.integers(0, 5, 2)}
        rows, found, _, size, _ = sketcher.measure(pa.array([" ".join(sorted(a)), " ".join(sorted(b))]))
        (x, y), (u, v) = (s.view(np.uint64) for s in sketcher.sketch(rows, found, size))
        differ = bin((int(x) ^ int(y)) >> history.SIZE_BITS).count("1") + bin(int(u) ^ int(v)).count("1")
        assert differ <= len(a ^ b)


# ---- p5


@pytest.mark.parametrize(
    ("one", "two", "same"),
    [
        ("Ｗｈｉｃｈ", "Which", True),
        ("сору", "copy", True),
        ("сора", "copa", True),
        ("é", "é", True),
        ("e", "é", False),
        ("a b　c", "a b c", True),
        ("a​b­", "ab", True),
        ("ﬁn", "fin", True),
        ("⩵", "==", True),
        ("x²", "x2", False),
        ("x²", "x²", True),
        ("O", "0", False),
        ("l", "I", False),
        ("а", "A", False),
        ("a  b", "a b", False),
        ("a\tb", "a b", False),
        ("Ω", "Ω", True),
        ("µ", "μ", True),
        ("ΑΒΕ", "ABE", True),
        ("αβγ", "aby", False),
        ("ñ", "n", False),
    ],
)
def test_skeletons(one, two, same):
    assert (lookalike.skeleton(one) == lookalike.skeleton(two)) is same
    assert lookalike.skeleton(lookalike.skeleton(one)) == lookalike.skeleton(one)


def test_ascii_stays():
    ascii_text = "".join(map(chr, range(128)))
    assert lookalike.skeleton(ascii_text + "é").startswith(ascii_text)
    assert len(lookalike.prototypes()) > 1000


def test_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    pool = ["Si", "Ѕi", "S​i", "si", "", None, "ｓi", "no", "nо", "z" * 3000, "z" * 2999 + "ｚ"]
    rows = [(i, rng.choice(pool), "x") for i in range(300)]
    table = spark.createDataFrame([*rows, (None, "Si", "x")], "text_id long, text string, look string")
    want = {
        (a, b)
        for a, s, _ in rows
        for b, t, _ in rows
        if a < b and s and t and s != t and lookalike.skeleton(s) == lookalike.skeleton(t)
    }
    for block, side in ((7, 2), (1000, 16)):
        found = [(r.text_id_a, r.text_id_b) for r in lookalike.lookalike_pairs(table, block, side).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    classes = {r.text_id: (r.class_id, r.n_links) for r in lookalike.lookalike_classes(table).collect()}
    form = {i: lookalike.skeleton(s) for i, s, _ in rows if s}
    assert classes == {i: (min(j for j in form if form[j] == form[i]), sum(i in p for p in want)) for i in form}
    plain = {r.text_id: r.skeleton for r in lookalike.consistent(table).collect() if r.text_id is not None}
    assert plain == {i: s and lookalike.skeleton(s) for i, s, _ in rows}
    none = spark.createDataFrame([], table.schema)
    assert lookalike.lookalike_pairs(none).count() == 0
