"""Texts that look the same but are stored with different characters.

Every text gets a skeleton: decompose, replace every character by its prototype
from the look-alike table, decompose again. Originals with equal skeletons look
the same. Only distinct texts are transformed, and a text of ASCII characters
is its own skeleton.

The table is built from rules over the whole of Unicode (marks without ink,
kinds of space, wide forms and ligatures) plus the fixed list of letters of
other alphabets that are drawn like a Latin letter. The list holds those that
common fonts draw alike; Coptic and Lisu letters and Greek small letters with a
shape of their own are different here. ASCII characters are never
replaced, so two different ones never look the same; superscript digits keep
their place, case and accents count, and each space stays one space.

Defined cases: null and empty texts have no skeleton and look like no other; a
text of characters without ink only has the empty skeleton and looks like
others of that kind; equal texts in several rows are no pair, but each of their
rows pairs with each row of a different writing; rows without an id take no
part in pairs; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aulamill.operators.work import digest, join_skewed, stored

# Letters of other alphabets drawn like a Latin letter, and the letter.
CYRILLIC = ("АВЕЅІЈКМНОРСТХҮԌԚԜаеорсухѕіјһԁԛԝѵ", "ABESIJKMHOPCTXYGQWaeopcyxsijhdqwv")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿοϳν", "ABEZHIKMNOPTYXJojv")
ARMENIAN = ("ՕՏօսհցո", "OSouhgn")
CHEROKEE = ("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᎠᎡᏀ", "ABCEHJKLMPSTVWZDRG")
# Signs that stand for several characters.
SIGNS = {"⩵": "=="}

#: Compatibility decompositions that only change how plain characters are drawn together or how wide.
PLAIN_KINDS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<small>")
#: Marks that have no ink though they are not format characters.
NO_INK = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0)


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """The look-alike table: code point -> prototype ('' for one without ink)."""
    table: dict[int, str] = {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3 or 0x3400 <= code <= 0x9FFF or 0x20000 <= code <= 0x3FFFF:
            continue
        char = chr(code)
        kind = unicodedata.category(char)
        if kind in ("Cf", "Cc") or code in NO_INK or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            table[code] = ""
        elif kind == "Zs":
            table[code] = " "
        elif kind not in ("Cn", "Co"):
            tag, _, parts = unicodedata.decomposition(char).partition(" ")
            if tag in PLAIN_KINDS:
                plain = "".join(chr(int(x, 16)) for x in parts.split())
                if not plain.startswith(" "):
                    table[code] = plain
    for strange, latin in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE):
        table.update({ord(s): c for s, c in zip(strange, latin, strict=True)})
    table.update({ord(s): plain for s, plain in SIGNS.items()})
    for code, plain in table.items():  # a prototype has no prototype of its own
        while (again := unicodedata.normalize("NFD", plain).translate(table)) != plain:
            plain = again
        table[code] = plain
    return table


def skeleton(text: str, table: dict[int, str] | None = None) -> str:
    """The form in which texts that look the same are equal."""
    if text.isascii():
        return text
    plain = unicodedata.normalize("NFD", text).translate(prototypes() if table is None else table)
    return unicodedata.normalize("NFD", plain)


def consistent(texts: DataFrame) -> DataFrame:
    """(text_id, text, skeleton) of every row; null and empty texts keep theirs. No shuffle."""
    table = texts.sparkSession.sparkContext.broadcast(prototypes())  # its size depends on Unicode only
    kind = texts.schema["text_id"].dataType.simpleString()

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            once = batch.column("text").dictionary_encode()
            forms = pa.array([t and skeleton(t, known) for t in once.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, forms.take(once.indices)], ["text_id", "text", "skeleton"])

    return texts.select("text_id", "text").mapInArrow(skeletons, f"text_id {kind}, text string, skeleton string")


def looks(texts: DataFrame) -> DataFrame:
    """(id, writing, look): digests of the text and of its skeleton, of rows with an id and a text."""
    rows = consistent(texts.where((F.length("text") > 0) & F.col("text_id").isNotNull()))
    return rows.select(F.col("text_id").alias("id"), digest("text").alias("writing"), digest("skeleton").alias("look"))


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """(text_id, class_id, n_links): each row's class, named by its smallest id, and how many rows look the same in other writing."""
    rows = stored(looks(texts), "looks")
    writings = stored(rows.groupBy("look", "writing").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "writings")
    classes = stored(
        writings.groupBy("look").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_writings")),
        "look-classes",
    )
    total = writings.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    per_writing = join_skewed(writings.drop("first"), classes, "look", "n_writings", total[1]).select(
        "writing", "n", F.col("n").alias("weight"), "class_id", "n_rows"
    )
    return join_skewed(rows.select("id", "writing"), stored(per_writing, "per-writing"), "writing", "weight", total[0]).select(
        F.col("id").alias("text_id"), "class_id", (F.col("n_rows") - F.col("n")).alias("n_links")
    )


def lookalike_pairs(texts: DataFrame, block: int = 1000, side: int = 16) -> DataFrame:
    """(text_id_a, text_id_b), a < b, of rows stored differently that look the same.

    Pairs are formed between writings. The ids of a writing lie in blocks of
    about ``block`` ids (a hash of the id picks the block, so a writing of any
    number of rows is spread). The blocks of a look are dealt into groups of
    about ``side``, and each pair of groups has a key of its own, so neither a
    hot writing nor a hot look meets in one task; ids are paired only as the
    result requires them.
    """
    rows = stored(looks(texts), "looks")
    sizes = stored(rows.groupBy("look", "writing").agg(F.count(F.lit(1)).alias("n")), "look-sizes")
    several = sizes.groupBy("look").agg(
        F.count(F.lit(1)).alias("n_writings"), F.sum(F.ceil(F.col("n") / block)).alias("n_blocks")
    ).where("n_writings > 1")
    several = stored(several, "looks-in-several-writings")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    kept = join_skewed(sizes, several, "look", "n_writings", total[1])
    kept = stored(kept.select("look", "writing", "n", F.col("n").alias("n_ids"), "n_blocks"), "writings-of-looks")
    slot = F.pmod(F.xxhash64("id"), F.ceil(F.col("n_ids") / block).cast("long"))
    blocks = (
        join_skewed(rows.select("id", "writing"), kept, "writing", "n", total[0])
        .groupBy("look", "writing", slot.alias("slot"), "n_blocks")
        .agg(F.collect_list("id").alias("ids"))  # about ``block`` of them
    )
    groups = F.ceil(F.col("n_blocks") / side).cast("long")
    own = F.pmod(F.xxhash64("writing", "slot"), groups)
    keyed = stored(
        blocks.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), groups.cast("int") - 1)))
        .select("look", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "writing", "ids"),
        "look-blocks",
    )
    left = keyed.where("own = p").select("look", "p", "q", F.col("writing").alias("wa"), F.col("ids").alias("ids_a"))
    right = keyed.where("own = q").select("look", "p", "q", F.col("writing").alias("wb"), F.col("ids").alias("ids_b"))
    units = left.join(right, ["look", "p", "q"]).where("wa < wb or (p < q and wa > wb)").select("ids_a", "ids_b")
    return (
        units.select(F.explode("ids_a").alias("x"), "ids_b")
        .select("x", F.explode("ids_b").alias("y"))
        .select(F.least("x", "y").alias("text_id_a"), F.greatest("x", "y").alias("text_id_b"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(spark.read.parquet(f"{sf_dir}/formatted_text.parquet"))


def p5_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's text in the consistent form."""
    texts = spark.read.parquet(f"{sf_dir}/formatted_text.parquet")
    return consistent(texts).select("text_id", F.col("skeleton").alias("consistent"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with its class of look and the number of rows that look the same in other writing."""
    return lookalike_classes(spark.read.parquet(f"{sf_dir}/formatted_text.parquet"))
