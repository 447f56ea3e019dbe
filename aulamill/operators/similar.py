"""Similar texts: 0.4 x TF-IDF cosine + 0.6 x Jaccard of the word sets, at or above a threshold.

Texts with equal clean text are one class; pairs are formed between classes, so
copies never multiply, and membership is its own table. As cosine is at most 1,
the score needs a Jaccard J of at least (threshold - 0.4) / 0.6, so two such
sets differ in at most (1 - J) / (1 + J) of their words. Either they share a
rare word, which is a key, or all their rare words are differences, and few
are left for the common words: these are dealt into groups, of which some must
be equal, so each set's most telling groups are keys too (a prefix filter on
groups). The few sets whose rare words leave more room than ``limit`` are
compared with all. Sketches of 128 bits drop most pairs where they meet,
before any list of words moves; as they tell little of long texts, longer ones
fitted to the mean length follow there. What is left is compared exactly, a
part of the pairs at a time; no cap drops a pair. Keys that very many sets
share are spread over several.

``prepare`` reads the texts once; every function here takes its result or the
texts themselves. A text or word that a third of all rows have is spread in
each join.

Defined cases: null texts are left out; texts without words are similar to
nothing; ties keep both; fewer than two texts give no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulamill.functions.text import clean_text, tokens
from aulamill.operators.work import Passing, digest, free_shuffles, join_skewed, stored

COSINE_SHARE = 0.4
#: A word is rare up to so many classes; more where the common ones would be above MOST_COMMON.
RARE, MOST_COMMON = 200, 1_000_000
#: The limit of slack is this quantile of a sample; it only steers the work, never the result.
SLACK_SHARE, SAMPLE = 0.998, 64
#: A key that more sets share is spread.
HOT = 20_000
#: Words whose frequencies are sent to the workers, and sets to compare that are broadcast; above, joins are shuffled.
VOCABULARY, CHOSEN = 4_000_000, 2_000_000
#: Bits of the longer sketch for each word of a mean set, their range, and bytes of longer sketches that are sent to the workers; above, they are joined.
LONG_TIMES, LONG_LEAST, LONG_MOST, LONG_BYTES = 4, 256, 4096, 64 << 20
#: Pairs whose words are on disk at once: so many, or a pair for each so many words of all sets.
SCORED, SCORED_WORDS = 100_000, 100
#: From so many sets on, keys are met in this many rounds, so that not all of them are on disk at once; each cuts the keys anew.
ROUNDS, ROUNDS_FROM = 2, 100_000
#: Numbers in a matrix that is held at once.
CELLS = 1 << 21
#: The size of a set in the lowest bits of its keys; sizes from FULL on are not compared there.
SIZE_BITS = 16
FULL = (1 << SIZE_BITS) - 1


def cleaned(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(id, clean)."""
    return texts.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), clean_text(F.col(text)).alias("clean"))


def token_counts(clean: DataFrame) -> DataFrame:
    """(id, n_tokens, n_words)."""
    words = tokens(F.col("clean"))
    return clean.select(
        "id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_words")
    )


def _counted_words(rows: DataFrame) -> DataFrame:
    """Adds ``counts``, array<struct<word, cnt>> of the list ``words``: one sort, then steps linear in it.

    Each step is a column of its own, so none is computed twice, and no row leaves its task.
    """
    runs = F.zip_with(
        "ordered",
        F.concat(F.array(F.lit(None).cast("string")), "ordered"),
        lambda w, last: F.struct(w.alias("word"), (~w.eqNullSafe(last) | w.isNull()).alias("new")),
    )  # one element more than words: the last marks the end
    starts = F.filter(
        F.transform("runs", lambda x, i: F.struct(x["word"].alias("word"), x["new"].alias("new"), i.alias("at"))), lambda x: x["new"]
    )
    lengths = F.zip_with(
        F.slice("starts", F.lit(1), F.size("starts") - 1),
        F.slice("starts", F.lit(2), F.size("starts")),
        lambda x, y: F.struct(x["word"].alias("word"), (y["at"] - x["at"]).cast("long").alias("cnt")),
    )
    steps = rows.withColumn("ordered", F.sort_array("words")).withColumn("runs", runs).withColumn("starts", starts)
    return steps.withColumn("counts", lengths).drop("ordered", "runs", "starts")


def _hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of clean texts as sorted hashes, with their counts."""
    import xxhash

    for batch in batches:
        n, texts = batch.num_rows, batch.column("clean")
        lists = pc.split_pattern(texts, " ")
        rows = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names)).view(np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        real = np.fromiter((w != "" for w in names), bool, len(names))[codes]
        rows, words = rows[real], hashes[codes[real]]
        n_tokens = np.bincount(rows, minlength=n)
        order = np.lexsort((words, rows))
        rows, words = rows[order], words[order]
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (words[1:] != words[:-1]))[: len(rows)])
        cnts = np.diff(np.append(first, len(rows))).astype(np.int32)
        ends = pa.array(np.append(0, np.cumsum(np.bincount(rows[first], minlength=n))).astype(np.int32))
        made = [pa.array(n_tokens), pa.ListArray.from_arrays(ends, pa.array(words[first])), pa.ListArray.from_arrays(ends, pa.array(cnts))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("nr", "class_id", "n_members", "hash")), *made],
            ["nr", "class_id", "n_members", "hash", "n_tokens", "words", "cnts"],
        )


def _flat(batch: pa.RecordBatch, values: str = "cnts") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, value) of the lists of a batch."""
    lists = batch.column("words")
    rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return rows, lists.flatten().to_numpy(zero_copy_only=False), batch.column(values).flatten().to_numpy(zero_copy_only=False) if values else None


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Keys:
    """Sketches and keys of sets of hashed words, for a Jaccard similarity; ``differ`` is its share of differences."""

    jaccard: float
    names: np.ndarray  # common words, sorted
    told: np.ndarray  # how much each tells
    limit: float = 0.0
    hot: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # keys, and how many groups of rows each gets

    @property
    def differ(self) -> float:
        return (1 - self.jaccard) / (1 + self.jaccard)

    def measure(self, rows: np.ndarray, words: np.ndarray, n: int):
        """(size, slack, whether it can be met by common words alone, and per word its place among the common ones or -1)."""
        at = np.minimum(np.searchsorted(self.names, words), max(len(self.names) - 1, 0))
        place = np.where(self.names[at] == words, at, -1) if len(self.names) else np.full(len(words), -1)
        size = np.bincount(rows, minlength=n)
        rare = np.bincount(rows[place < 0], minlength=n)
        return size, size * self.differ - rare, (size > 0) & (size - rare >= size * self.jaccard - 1e-9), place

    @staticmethod
    def sketch(rows: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits, of which each word turns one: bits that differ are words that differ."""
        bit = _mix(words.view(np.uint64)) >> np.uint64(57)
        signs = np.zeros((2, n), np.uint64)
        for i in range(2):
            mine = (bit >> np.uint64(6)) == i
            np.bitwise_xor.at(signs[i], rows[mine], np.uint64(1) << (bit[mine] & np.uint64(63)))
        return signs[0].view(np.int64), signs[1].view(np.int64)

    @staticmethod
    def long_sketch(rows: np.ndarray, words: np.ndarray, n: int, bits: int) -> np.ndarray:
        """The same of ``bits`` bits, a power of two: n rows of 64-bit numbers."""
        bit = (_mix(words.view(np.uint64) ^ np.uint64(0x2545F491)) & np.uint64(bits - 1)).astype(np.int64)
        signs = np.zeros(n * (bits // 64), np.uint64)
        np.bitwise_xor.at(signs, rows * (bits // 64) + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return signs.reshape(n, bits // 64)

    def keys(self, rows: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of the sets within the limit."""
        size, slack, grouped, place = self.measure(rows, words, n)
        line = rows
        easy = ~(grouped & (slack > self.limit))
        rare = (place < 0) & easy[rows]
        found = [(rows[rare], _mix(words[rare].view(np.uint64)))]
        groups = int((int(2 * self.limit + 1e-9) + 1) * 1.15) + 1
        most = np.floor(slack + self.limit + 1e-9).astype(np.int64)  # differences in common words
        wanted = np.flatnonzero(easy & grouped & (most >= 0))
        for mine in np.array_split(wanted, max(1, -(-len(wanted) * groups // CELLS))):
            at = np.full(n, -1)
            at[mine] = np.arange(len(mine))
            ours = (place >= 0) & (at[rows] >= 0)
            codes = words[ours].view(np.uint64)
            cell = at[rows[ours]] * groups + ((_mix(codes) >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
            sums, cells = np.zeros(len(mine) * groups, np.uint64), len(mine) * groups
            np.add.at(sums, cell, _mix(codes ^ np.uint64(0x5DEECE66D)))
            told = np.bincount(cell, weights=self.told[place[ours]], minlength=cells)
            held = np.bincount(cell, minlength=cells) > 0
            keys = _mix(sums + _mix(np.arange(cells, dtype=np.uint64) % np.uint64(groups) + np.uint64(1)))
            # One order of all groups of all sets: the most telling first, empty ones last.
            order = np.lexsort((keys, np.where(held, -told, np.inf), np.arange(cells) // groups)).reshape(-1, groups)
            taken = order[np.arange(groups)[None, :] <= most[mine][:, None]]
            found.append((mine[taken // groups], keys[taken]))
        rows, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        keys = (keys & ~np.uint64(FULL)).view(np.int64)
        if len(self.hot[0]):
            whole = np.zeros(n, np.uint64)  # a number of the set, the same for each of its keys
            np.add.at(whole, line, _mix(words.view(np.uint64)))
            at = np.minimum(np.searchsorted(self.hot[0], keys), len(self.hot[0]) - 1)
            times = np.where(self.hot[0][at] == keys, self.hot[1][at], 1)
            own = (_mix(whole[rows]) % times.astype(np.uint64)).astype(np.int64)
            other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            rows, keys, own, times = (np.repeat(x, times) for x in (rows, keys, own, times))
            pair = np.minimum(own, other) * times + np.maximum(own, other)
            spread = (_mix(keys.view(np.uint64) + _mix(pair.astype(np.uint64))) & ~np.uint64(FULL)).view(np.int64)
            keys = np.where(times > 1, spread, keys)
        return rows, keys | np.minimum(size[rows], FULL)


def _ones(x: np.ndarray) -> np.ndarray:
    """Bits set; numpy counts those of a signed number's absolute value."""
    return np.bitwise_count(x.view(np.uint64))


def _meet(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], differ: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b``, each (sketch, sketch, size), of the pairs whose sketches allow the similarity."""
    bits = _ones(a[0][:, None] ^ b[0][None, :]).astype(np.int16) + _ones(a[1][:, None] ^ b[1][None, :])
    sizes = a[2][:, None] + b[2][None, :]
    return np.nonzero(bits <= sizes * np.float32(differ) + np.float32(0.01))


def _long_bits(n_words: int, n_sets: int) -> int:
    """Bits of the longer sketch; 0 where the short one is as long."""
    bits = 1 << max(LONG_TIMES * n_words // max(n_sets, 1) - 1, 0).bit_length()
    return min(bits, LONG_MOST) if bits >= LONG_LEAST else 0


def _close(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], differ: float) -> np.ndarray:
    """Whether the longer sketches of rows, each (sketches, size), allow the similarity."""
    bits = np.bitwise_count(a[0] ^ b[0]).sum(axis=1, dtype=np.int64)
    return bits <= (a[1] + b[1]) * differ + 0.01


@dataclass
class Corpus:
    """Texts brought to classes, word frequencies and vectors, each computed once and stored."""

    clean: DataFrame  # id, clean

    @cached_property
    def _tables(self) -> Passing:
        return Passing(self.clean.sparkSession)

    def drop(self) -> None:
        """Delete the tables of word sets once nothing reads them; they are made anew if they are asked for again."""
        self._tables.drop()
        for name in ("sets", "word_counts", "_groups"):
            self.__dict__.pop(name, None)

    @cached_property
    def _hashed(self) -> DataFrame:
        """(id, hash)."""
        return stored(self.clean.select("id", digest("clean").alias("hash")), "text-hashes")

    def cleaned_once(self) -> None:
        """Make the sets and the hashes of all texts from one pass over the texts, where both are needed."""
        if "_hashed" in self.__dict__ or "sets" in self.__dict__:
            return
        passing, clean = Passing(self.clean.sparkSession), self.clean
        self.clean = passing.keep(clean, "clean")
        try:
            _ = self._hashed, self.sets
        finally:
            self.clean = clean
            passing.drop()

    @property
    def _distinct(self) -> DataFrame:
        return self.clean.groupBy("clean").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_members"))

    @cached_property
    def sets(self) -> DataFrame:
        """(nr, class_id, n_members, hash, n_tokens, words, cnts): one row per clean text; words are sorted 64-bit hashes."""
        rows = self._distinct.select(F.monotonically_increasing_id().alias("nr"), "class_id", "n_members", digest("clean").alias("hash"), "clean")
        kind = rows.schema["class_id"].dataType.simpleString()
        out = f"nr long, class_id {kind}, n_members long, hash binary, n_tokens long, words array<long>, cnts array<int>"
        found = self._tables.keep(rows.mapInArrow(_hashed_words, out), "word-sets")
        free_shuffles(found.sparkSession)
        return found

    @cached_property
    def _groups(self) -> DataFrame:
        """(hash, class_id, n_members, weight)."""
        return self.sets.select("hash", "class_id", "n_members", F.col("n_members").alias("weight"))

    @cached_property
    def n_texts(self) -> int:
        return self.sets.agg(F.coalesce(F.sum("n_members"), F.lit(0))).head()[0]

    @cached_property
    def word_counts(self) -> DataFrame:
        """(word, df, n): texts and classes that hold the hashed word, of the words of several texts."""
        words = self.sets.select("n_members", F.explode("words").alias("word")).groupBy("word")
        found = self._tables.keep(words.agg(F.sum("n_members").alias("df"), F.count(F.lit(1)).alias("n")).where("df > 1"), "word-counts")
        free_shuffles(found.sparkSession)
        return found

    def valued(self, chosen: DataFrame) -> DataFrame:
        """(nr, words, vals, norm) of rows of ``sets``: TF-IDF of each word, and the root of their squares' sum (null without words)."""
        n, spark = float(self.n_texts), chosen.sparkSession
        chosen = chosen.select("nr", "n_tokens", "words", "cnts")
        if self.word_counts.count() > VOCABULARY:
            long = chosen.select("nr", "n_tokens", F.explode(F.arrays_zip("words", "cnts")).alias("c")).select("nr", "n_tokens", "c.*")
            counts = self.word_counts.select(F.col("word").alias("words"), "df", F.col("n").alias("weight"))
            total = counts.agg(F.sum("weight")).head()[0]
            idf = F.log(F.lit(n) / (F.lit(1.0) + F.coalesce("df", F.lit(1))))
            once = long.join(counts.select("words"), "words", "left_anti").withColumn("df", F.lit(1).cast("long"))
            several = join_skewed(long, counts, "words", "weight", total).select(*long.columns, "df")
            items = several.unionByName(once).select("nr", F.struct("words", (F.col("cnts") / F.col("n_tokens") * idf).alias("v")).alias("x"))
            lists = items.groupBy("nr").agg(F.collect_list("x").alias("x"), F.sqrt(F.sum(F.col("x.v") * F.col("x.v"))).alias("norm"))
            return lists.select("nr", F.col("x.words").alias("words"), F.col("x.v").alias("vals"), "norm")
        known = self.word_counts.select("word", "df").orderBy("word").toArrow()
        sent = spark.sparkContext.broadcast((known["word"].to_numpy(), np.log(n / (1.0 + known["df"].to_numpy())) if n else np.zeros(0)))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, idf = sent.value
            for batch in batches:
                rows, words, cnts = _flat(batch)
                found = np.full(len(words), np.log(n / 2.0) if n else 0.0)
                if len(names):
                    at = np.minimum(np.searchsorted(names, words), len(names) - 1)
                    found = np.where(names[at] == words, idf[at], found)
                v = cnts / np.maximum(batch.column("n_tokens").to_numpy()[rows], 1) * found
                norm = np.sqrt(np.bincount(rows, weights=v * v, minlength=batch.num_rows))
                ends = pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=batch.num_rows))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (words, v)]
                empty = np.bincount(rows, minlength=batch.num_rows) == 0
                yield pa.RecordBatch.from_arrays([batch.column("nr"), *lists, pa.array(norm, mask=empty)], ["nr", "words", "vals", "norm"])

        return chosen.mapInArrow(weigh, "nr long, words array<long>, vals array<double>, norm double")

    @cached_property
    def classes(self) -> DataFrame:
        """(class_id, n_members, n_tokens, counts): one row per clean text; counts is array<struct<word, cnt>>."""
        counted = _counted_words(self._distinct.withColumn("words", tokens(F.col("clean"))))
        return stored(counted.select("class_id", "n_members", F.size("words").alias("n_tokens"), "counts"), "class-words")

    @cached_property
    def freq(self) -> DataFrame:
        """(word, df, idf, n_classes)."""
        words = self.classes.select("n_members", F.explode("counts").alias("c")).groupBy(F.col("c.word").alias("word"))
        counts = words.agg(F.sum("n_members").alias("df"), F.count(F.lit(1)).alias("n_classes"))
        n_texts = self.classes.agg(F.coalesce(F.sum("n_members"), F.lit(0))).head()[0]
        idf = F.log(F.lit(float(n_texts)) / (F.lit(1.0) + F.col("df")))
        return stored(counts.select("word", "df", idf.alias("idf"), "n_classes"), "word-frequencies")

    @cached_property
    def weights(self) -> DataFrame:
        """(class_id, word, tf, tfidf, df). A stop word is in nearly every text, so the join is split."""
        long = self.classes.select("class_id", "n_tokens", F.explode("counts").alias("c")).select("class_id", "n_tokens", "c.word", "c.cnt")
        total = self.freq.agg(F.coalesce(F.sum("n_classes"), F.lit(0))).head()[0]
        tf = F.col("cnt") / F.col("n_tokens")
        return join_skewed(long, self.freq, "word", "n_classes", total).select(
            "class_id", "word", tf.alias("tf"), (tf * F.col("idf")).alias("tfidf"), "df"
        )


def prepare(clean: DataFrame | Corpus) -> Corpus:
    """The texts ``(id, clean)`` ready for any number of the functions below."""
    return clean if isinstance(clean, Corpus) else Corpus(clean)


def membership(clean: DataFrame | Corpus) -> DataFrame:
    """(id, class_id, n_members): the smallest id of a class names it."""
    corpus = prepare(clean)
    return join_skewed(corpus._hashed.select("id", "hash"), corpus._groups, "hash", "weight", corpus.n_texts).select(
        "id", "class_id", "n_members"
    )


def doc_freq(clean: DataFrame | Corpus) -> DataFrame:
    """(word, df, idf): texts that hold the word; idf = ln(N / (1 + df)), not smoothed.

    A corpus counts its classes weighted by their members, which equals counting texts.
    """
    if isinstance(clean, Corpus):
        return clean.freq.select("word", "df", "idf")
    df = clean.select(F.explode(F.array_distinct(tokens(F.col("clean")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = clean.agg(F.count(F.lit(1)).cast("double").alias("n_texts"))
    return df.crossJoin(F.broadcast(total)).select(  # one row
        "word", "df", F.log(F.col("n_texts") / (F.lit(1.0) + F.col("df"))).alias("idf")
    )


def weights(clean: DataFrame | Corpus) -> DataFrame:
    """(class_id, word, tf, tfidf, df) of each distinct word of each class."""
    return prepare(clean).weights


def candidate_pairs(corpus: Corpus, jaccard: float, passing: Passing) -> DataFrame:
    """(a, b), a < b, of the numbers of classes that can reach the Jaccard similarity, if they share a word; kept in ``passing``."""
    sets, spark = corpus.sets.select("nr", "words"), corpus.sets.sparkSession
    jaccard = max(jaccard, 1e-6)
    n_words = corpus.word_counts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    common = corpus.word_counts.where(F.col("n") > max(RARE, n_words // MOST_COMMON)).select("word", "n").orderBy("word").toArrow()
    n_sets = sets.count()
    made = Keys(jaccard, common["word"].to_numpy(), np.log((n_sets + 1.0) / common["n"].to_numpy()))
    sent = spark.sparkContext.broadcast(made)
    some = sets if n_sets < SAMPLE * 1000 else sets.where(F.pmod(F.xxhash64("nr"), F.lit(SAMPLE)) == 0)

    def slacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, _ = _flat(batch, "")
            _, slack, grouped, _ = sent.value.measure(rows, words, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.ceil(slack[grouped] * 10).astype(np.int64))], ["tenth"])

    tenths = sorted(map(tuple, some.mapInArrow(slacks, "tenth long").groupBy("tenth").count().collect()))  # up to the longest text's
    seen, total, limit = 0, sum(n for _, n in tenths), 10
    for tenth, n in tenths:
        if seen < total * SLACK_SHARE:
            limit = max(10, tenth)
        seen += n
    made.limit = limit / 10
    sent = spark.sparkContext.broadcast(made)

    def cut(batches: Iterator[pa.RecordBatch], turn: int = 0, rounds: int = 1) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, _ = _flat(batch, "")
            at, keys = sent.value.keys(rows, words, batch.num_rows)
            if rounds > 1:
                mine = (keys >> SIZE_BITS) % rounds == turn
                at, keys = at[mine], keys[mine]
            signs = sent.value.sketch(rows, words, batch.num_rows)
            nrs = batch.column("nr").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, nrs[at], signs[0][at], signs[1][at])], ["key", "nr", "s", "t"])

    kinds = "key long, nr long, s long, t long"
    if n_sets > HOT:
        part = F.col("key").bitwiseAND(F.lit(~FULL)).alias("key")
        scale = 1 if n_sets < SAMPLE * 1000 else SAMPLE
        counts = some.mapInArrow(cut, kinds).select(part).groupBy("key").agg((F.count(F.lit(1)) * scale).alias("n"))
        least = max(HOT, n_sets // 50)
        hot = sorted(map(tuple, counts.where(F.col("n") > least).collect()))  # few: a set has some tens of keys
        if hot:
            keys, n = np.array(hot, np.int64).T
            made.hot = keys, -(-n // least) + 1
            sent = spark.sparkContext.broadcast(made)

    long_bits, differ = _long_bits(n_words, n_sets), made.differ

    def long_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, _ = _flat(batch, "")
            signs = Keys.long_sketch(rows, words, batch.num_rows, long_bits)
            sizes = np.bincount(rows, minlength=batch.num_rows)
            lists = pa.FixedSizeBinaryArray.from_buffers(pa.binary(signs.shape[1] * 8), len(signs), [None, pa.py_buffer(signs)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("nr"), pa.array(sizes), lists], ["nr", "n", "sign"])

    signed = sets.mapInArrow(long_sketches, "nr long, n long, sign binary") if long_bits else None
    known = None
    if long_bits and n_sets * long_bits // 8 <= LONG_BYTES:
        table = signed.orderBy("nr").toArrow().combine_chunks()
        known = spark.sparkContext.broadcast((table["nr"].to_numpy(), table["n"].to_numpy(), _signs(table["sign"], long_bits)))
        del table

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs that the longer sketches allow, where all workers have these."""
        if known is None:
            yield from batches
            return
        names, sizes, signs = known.value
        for batch in batches:
            for x in range(0, batch.num_rows, CELLS * 8 // long_bits):
                part = batch.slice(x, CELLS * 8 // long_bits)
                i, j = (np.searchsorted(names, part.column(c).to_numpy()) for c in ("a", "b"))
                yield part.filter(pa.array(_close((signs[i], sizes[i]), (signs[j], sizes[j]), differ)))

    def joined(pairs: DataFrame) -> DataFrame:
        """The same of distinct pairs, by joins."""
        if known is not None or not long_bits:
            return pairs

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = ((_signs(batch.column(f"sign_{x}"), long_bits), batch.column(f"n_{x}").to_numpy()) for x in "ab")
                yield batch.select(["a", "b"]).filter(pa.array(_close(a, b, differ)))

        for x in "ab":
            pairs = pairs.join(signed.select(F.col("nr").alias(x), F.col("n").alias(f"n_{x}"), F.col("sign").alias(f"sign_{x}")), x)
        return pairs.mapInArrow(compare, "a long, b long")

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of rows of one key; rows come in the order of keys, so a key's lie together."""
        rest = None
        for batch in batches:
            block = [batch.column(c).to_numpy() for c in ("key", "nr", "s", "t")]
            if rest is not None:
                block = [np.concatenate(x) for x in zip(rest, block, strict=True)]
            key = block[0] >> SIZE_BITS
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # its rows may go on
            rest = [x[last:] for x in block]
            yield from close(_pairs_of(*(x[:last] for x in block), sent.value.differ))
        if rest is not None:
            yield from close(_pairs_of(*rest, sent.value.differ))

    rounds, parts = ROUNDS if n_sets >= ROUNDS_FROM else 1, Passing(spark)
    for turn in range(rounds):
        keyed = sets.mapInArrow(partial(cut, turn=turn, rounds=rounds), kinds).repartition(F.shiftright("key", SIZE_BITS)).sortWithinPartitions("key")
        part = keyed.mapInArrow(pair_up, "a long, b long")
        if rounds > 1:
            part = parts.keep(joined(part.distinct()), "near")
            free_shuffles(spark)
        near = near.union(part) if turn else part

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, _ = _flat(batch, "")
            size, slack, grouped, _ = sent.value.measure(rows, words, batch.num_rows)
            keep = pa.array(grouped & (slack > sent.value.limit))
            signs = sent.value.sketch(rows, words, batch.num_rows)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (batch.column("nr"), *map(pa.array, (*signs, size)))], ["nr", "s", "t", "n"])

    roomy = [c.to_numpy() for c in sets.mapInArrow(hard, "nr long, s long, t long, n long").toArrow().columns]  # a share of 1 - SLACK_SHARE
    if len(roomy[0]):
        others = spark.sparkContext.broadcast(roomy)

        def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            other, *signs_b = others.value
            step = max(1, CELLS // 8 // len(other))
            for batch in batches:
                rows, words, _ = _flat(batch, "")
                nrs, mine = batch.column("nr").to_numpy(), (*sent.value.sketch(rows, words, batch.num_rows), np.bincount(rows, minlength=batch.num_rows))
                for x in range(0, len(nrs), step):
                    i, j = _meet(tuple(c[x : x + step] for c in mine), signs_b, sent.value.differ)
                    a, b = nrs[x + i], other[j]
                    keep = a != b
                    yield from close(iter([pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], ["a", "b"])]))

        near = near.union(sets.mapInArrow(against, "a long, b long"))
    found = passing.keep(joined(near.distinct()) if rounds == 1 or len(roomy[0]) else near.distinct(), "candidates")
    parts.drop()
    return found


def _signs(column: pa.Array | pa.ChunkedArray, bits: int) -> np.ndarray:
    """Longer sketches, one in a row."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.frombuffer(b"".join(b"".join(c.to_pylist()) for c in chunks), np.uint64).reshape(-1, bits // 64)


def _pairs_of(key: np.ndarray, nr: np.ndarray, s: np.ndarray, t: np.ndarray, differ: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows of equal keys, in blocks of bounded size."""
    size, key = key & FULL, key >> SIZE_BITS
    size = np.where(size == FULL, 1 << 30, size)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    n = np.diff(np.append(first, len(key)))
    out_a, out_b = [], []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        other = nr[i] != nr[j]
        i, j = i[other], j[other]
        out_a.append(np.minimum(nr[i], nr[j]))
        out_b.append(np.maximum(nr[i], nr[j]))

    # Small keys together, one distance of rows after the other; large ones as matrices.
    small = np.repeat(n <= 24, n)
    ks, at = key[small], np.flatnonzero(small)
    for step in range(1, 24):
        i = np.flatnonzero(ks[:-step] == ks[step:])
        if not len(i):
            break
        i, j = at[i], at[i + step]
        bits = _ones(s[i] ^ s[j]).astype(np.int16) + _ones(t[i] ^ t[j])
        ok = bits <= (size[i] + size[j]) * differ + 0.01
        keep(i[ok], j[ok])
    for begin, many in zip(first[n > 24].tolist(), n[n > 24].tolist(), strict=True):
        end, step = begin + many, max(1, min(many, CELLS // 8 // many)) if many < CELLS // 8 else 1
        for x in range(begin, end, step):
            for y in range(x, end, CELLS // 8):
                rows, cols = slice(x, min(x + step, end)), slice(y, min(y + CELLS // 8, end))
                i, j = _meet((s[rows], t[rows], size[rows]), (s[cols], t[cols], size[cols]), differ)
                i, j = i + x, j + y
                keep(i[i < j], j[i < j])
        if sum(map(len, out_a)) > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], ["a", "b"])
            out_a.clear()
            out_b.clear()
    if out_a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], ["a", "b"])


def _scored(pairs: DataFrame, corpus: Corpus, floor: float, passing: Passing) -> DataFrame:
    """(a, b, jaccard, cosine) of pairs at or above the Jaccard ``floor``: both lists are merged, in time linear in their words."""
    chosen = pairs.select(F.col("a").alias("nr")).union(pairs.select("b")).distinct()
    n_pairs = pairs.count()
    few = n_pairs <= CHOSEN // 2
    valued = corpus.valued(corpus.sets.join(F.broadcast(chosen) if few else chosen, "nr", "left_semi"))
    vectors = passing.keep(valued, "vectors")
    free_shuffles(pairs.sparkSession)
    sides = {x: vectors.select(F.col("nr").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("norm", "words", "vals"))) for x in "ab"}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {}
            for x in "ab":
                lists, values = batch.column(f"words_{x}"), batch.column(f"vals_{x}")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                rows = np.repeat(np.arange(batch.num_rows), sizes)
                flat[x] = rows, lists.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False), sizes
            rows, words, values = (np.concatenate([flat["a"][i], flat["b"][i]]) for i in range(3))
            order = np.lexsort((words, rows))
            rows, words, values = rows[order], words[order], values[order]
            both = np.flatnonzero((rows[1:] == rows[:-1]) & (words[1:] == words[:-1]))  # a list holds a word once
            common = np.bincount(rows[both], minlength=batch.num_rows)
            dot = np.bincount(rows[both], weights=values[both] * values[both + 1], minlength=batch.num_rows)
            norms = batch.column("norm_a").to_numpy(zero_copy_only=False) * batch.column("norm_b").to_numpy(zero_copy_only=False)
            jaccard = common / np.maximum(flat["a"][3] + flat["b"][3] - common, 1)
            cosine = np.divide(dot, norms, out=np.zeros(len(dot)), where=norms != 0)
            keep = pa.array((jaccard >= floor) & (common > 0))
            found = [batch.column("a"), batch.column("b"), pa.array(jaccard), pa.array(cosine)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in found], ["a", "b", "jaccard", "cosine"])

    def scored(part: DataFrame) -> DataFrame:
        return part.join(sides["a"], "a").join(sides["b"], "b").mapInArrow(merge, "a long, b long, jaccard double, cosine double")

    n_words = corpus.word_counts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    turns = -(-n_pairs // max(SCORED, n_words // SCORED_WORDS))
    if turns <= 1:
        return scored(pairs)
    for turn in range(turns):  # what a turn finds is short
        part = passing.keep(scored(pairs.where(F.pmod(F.xxhash64("a"), F.lit(turns)) == turn)), "scored-part")
        free_shuffles(pairs.sparkSession)
        found = found.union(part) if turn else part
    return found


def similar_pairs(clean: DataFrame | Corpus, threshold: float = 0.85) -> DataFrame:
    """(a, b, jaccard, cosine, similarity) of classes, a < b, with similarity at or above the threshold.

    Classes without words take no part. Members of one class are similar by
    their own score (1, or 0.6 where all their words weigh 0); see ``copies``.
    """
    floor = (threshold - COSINE_SHARE) / (1 - COSINE_SHARE)
    corpus = prepare(clean)
    passing = Passing(corpus.clean.sparkSession)
    scored = _scored(candidate_pairs(corpus, floor, passing), corpus, floor - 1e-9, passing)
    similarity = F.col("cosine") * COSINE_SHARE + F.col("jaccard") * (1 - COSINE_SHARE)
    found = stored(scored.withColumn("similarity", similarity).where(F.col("similarity") >= threshold), "scored")
    passing.drop()
    # Numbers to ids; a class in very many pairs is spread by the skew handling of the shuffled join.
    named = corpus.sets.select("nr", "class_id")
    for x in "ab":
        counts = found.groupBy(x).agg(F.count(F.lit(1)).alias("weight"))
        total = found.count()
        side = stored(named.join(F.broadcast(counts) if total <= CHOSEN else counts, F.col("nr") == F.col(x)).select(x, F.col("class_id").alias(f"id_{x}"), "weight"), "names")
        found = join_skewed(found, side, x, "weight", total)
    free_shuffles(corpus.clean.sparkSession)
    ids = (F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    return found.select(*ids, "jaccard", "cosine", "similarity")


def class_scores(clean: DataFrame | Corpus) -> DataFrame:
    """(class_id, n_members, similarity) of classes with several members: what two of its copies score."""
    corpus = prepare(clean)
    several = corpus.sets.where("n_members > 1")
    return (
        several.select("nr", "class_id", "n_members")
        .join(corpus.valued(several).select("nr", "norm"), "nr", "left")
        .select(
            "class_id",
            "n_members",
            F.when(F.col("norm").isNull(), 0.0)
            .when(F.col("norm") == 0, 1 - COSINE_SHARE)
            .otherwise(1.0)
            .alias("similarity"),
        )
    )


def copies(clean: DataFrame | Corpus, threshold: float = 0.85) -> DataFrame:
    """(class_id, id, n_members, similarity): each copy of a class but the first, where copies are similar among themselves."""
    corpus = prepare(clean)
    scores = stored(class_scores(corpus).where(F.col("similarity") >= threshold).withColumn("weight", F.col("n_members")), "copies")
    free_shuffles(scores.sparkSession)
    total = scores.agg(F.coalesce(F.sum("weight"), F.lit(0))).head()[0]
    rows = membership(corpus).where("n_members > 1 and id <> class_id").select("class_id", "id")
    return join_skewed(rows, scores, "class_id", "weight", total).select("class_id", "id", "n_members", "similarity")


def links(clean: DataFrame | Corpus, threshold: float = 0.85) -> DataFrame:
    """(id, class_id, n_links): for each text its class and the number of texts it is similar to."""
    corpus = prepare(clean)
    corpus.cleaned_once()
    pairs = stored(similar_pairs(corpus, threshold).select("a", "b"), "similar-pairs")
    free_shuffles(pairs.sparkSession)
    sizes = corpus._groups.select("hash", "class_id", "n_members")
    both = pairs.union(pairs.select("b", "a")).toDF("class_id", "other")
    outside = (
        both.join(sizes.select(F.col("class_id").alias("other"), "n_members"), "other")
        .groupBy("class_id")
        .agg(F.sum("n_members").alias("outside"))
    )
    inside = class_scores(corpus).where(F.col("similarity") >= threshold).select(
        "class_id", (F.col("n_members") - 1).alias("inside")
    )
    per_class = sizes.join(outside, "class_id", "left").join(inside, "class_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counted = stored(
        per_class.select("hash", "class_id", F.col("n_members").alias("weight"), (zero("outside") + zero("inside")).alias("n_links")), "links"
    )
    # A text finds its class and the class's number by one join on the content's hash.
    texts, total = corpus._hashed, corpus.n_texts
    if corpus is clean:
        free_shuffles(pairs.sparkSession)
    else:
        corpus.drop()
    return join_skewed(texts, counted, "hash", "weight", total).select("id", "class_id", "n_links")


def with_questions(pairs: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Pairs (a, b, similarity) with the file, title and type of both questions. A question in very many pairs is no hot key."""

    def join_side(rows: DataFrame, name: str) -> DataFrame:
        side = questions.select(F.col(key).alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("filepath", "title", "type")))
        counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("weight"))
        named = stored(counts.join(side, name), f"side-{name}")
        free_shuffles(named.sparkSession)
        total = named.agg(F.coalesce(F.sum("weight"), F.lit(0))).head()[0]
        return join_skewed(rows, named, name, "weight", total)

    return join_side(join_side(stored(pairs, "pairs"), "a"), "b")
