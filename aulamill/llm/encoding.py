"""Encoding of texts with a public byte-level BPE vocabulary, in linear time.

The encoder needs only the vocabulary's ranks. An Aho-Corasick automaton over
the tokens' bytes gives the longest token at each position; the encoder takes
it if the pair with the token before is compatible (no merge of a lower rank
would have joined across or inside the two), else the next shorter prefix that
is a token, and steps back when none is left. A bit per position remembers dead
ends, so each position is left at most once and a run of any length stays
linear. The result equals the exact merges by rank.

Tables are made once on the driver and broadcast: their size depends on the
vocabulary (about 50,000 entries), never on the data. Pieces between the
pattern's borders recur, so each worker keeps the ids of recent short pieces in
a cache of bounded size.

Defined cases: null and empty texts give the empty list; strings that look like
special tokens are ordinary text; texts of any length are encoded whole; an
empty table gives an empty result; columns other than the id and the text are
not read.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabulary lies by default.
VOCABULARY = os.environ.get("AULAMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHED_PIECES = 150_000
CACHED_LENGTH = 64
CACHED_PAIRS = 400_000
#: Ids in one batch sent back to the JVM.
BATCH_IDS = 2_000_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from lines of base64 token and rank."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    return [tokens[i] for i in range(len(tokens))]


class Tables:
    """What the encoder looks up, derived from the tokens in rank order."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.pairs: dict[int, int] = {}
        n = len(tokens)
        self.left, self.right, self.prefix = array("i", range(n)), array("i", range(n)), array("i", [-1]) * n
        ids = {t: i for i, t in enumerate(tokens)}
        for i, token in enumerate(tokens):
            for cut in range(len(token) - 1, 0, -1):
                if (shorter := ids.get(token[:cut])) is not None:
                    self.prefix[i] = shorter
                    break
        for i, token in enumerate(tokens):
            # A token is made by the one merge of two older tokens that nothing older would have prevented.
            shorter = self.prefix[i]
            while shorter >= 0:
                rest = ids.get(token[len(tokens[shorter]) :])
                if shorter < i and rest is not None and rest < i and self.compatible(shorter, rest):
                    self.left[i], self.right[i] = shorter, rest
                    self.pairs[shorter << 20 | rest] = i
                    break
                shorter = self.prefix[shorter]

    def compatible(self, one: int, two: int) -> bool:
        """Whether the merges that build the two tokens leave the border between them alone."""
        left, right, pairs = self.left, self.right, self.pairs
        limit = 1 << 30
        while True:
            joined = pairs.get(one << 20 | two)
            if joined is not None and joined < limit:
                return False
            # Undo the younger of the two merges; what touches the border comes next.
            if one > two:
                if right[one] == one:
                    if left[two] == two:
                        return True
                    limit, two = two + 1, left[two]
                else:
                    limit, one = one, right[one]
            elif left[two] == two:
                if right[one] == one:
                    return True
                limit, one = one, right[one]
            else:
                limit, two = two + 1, left[two]


class Encoder(dict):
    """Ids of a piece as bytes of 32-bit integers; a dict, so cached pieces need one lookup."""

    def __init__(self, tables: Tables):
        import ahocorasick
        import regex

        super().__init__()
        self.tables = tables
        self.split = regex.compile(PATTERN).findall
        self.lengths = [len(t) for t in tables.tokens]
        self.known_pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(tables.tokens):
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece.encode("utf-8", "surrogatepass")).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def follows(self, one: int, two: int) -> bool:
        key = one << 20 | two
        known = self.known_pairs.get(key)
        if known is None:
            if len(self.known_pairs) >= CACHED_PAIRS:
                self.known_pairs.clear()
            known = self.known_pairs[key] = self.tables.compatible(one, two)
        return known

    def merge(self, data: bytes) -> array:
        """The ids of a piece by backtracking over longest matches."""
        n, lengths, prefix = len(data), self.lengths, self.tables.prefix
        longest = [0] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # later ends are longer matches
        alive = bytearray(b"\1") * (n + 1)
        out = array("i")
        at, token = 0, longest[0] if n else -1
        while token >= 0 and at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + lengths[token]
                if alive[end] and (last < 0 or self.follows(last, token)):
                    out.append(token)
                    at = end
                    token = longest[end] if end < n else -1
                    break
                token = prefix[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= lengths[token]
                token = prefix[token]
                while token < 0 and out:  # the one before has no shorter form either
                    alive[at] = 0
                    token = out.pop()
                    at -= lengths[token]
                    token = prefix[token]
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.split(text)))


class Decoder:
    """Bytes of ids by an offset table into the joined token bytes."""

    def __init__(self, tokens: list[bytes]):
        self.joined = b"".join(tokens)
        self.offsets = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=self.offsets[1:])

    def decode(self, ids) -> str:
        starts, ends = self.offsets[:-1], self.offsets[1:]
        return b"".join(self.joined[starts[i] : ends[i]] for i in ids).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder_for(tables) -> Encoder:
    """The worker's encoder of broadcast tables; built once per worker and vocabulary."""
    key, value = tables.value
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(value)
    return _encoders[key]


def shared_tables(spark: SparkSession, path: str = VOCABULARY):
    return spark.sparkContext.broadcast((path, Tables(read_ranks(path))))


def encoded(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row."""
    tables = shared_tables(texts.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tables)
        for batch in batches:
            begin, parts, ends, total = 0, [], [0], 0
            values = batch.column(1).to_pylist()
            for i, value in enumerate(values):
                part = encoder.encode(value)
                total += len(part) // 4
                parts.append(part)
                ends.append(total)
                if total >= BATCH_IDS or i + 1 == len(values):
                    ids = pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32))
                    )
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(parts)), ids], [key, "ids"])
                    begin, parts, ends, total = i + 1, [], [0], 0

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def counted(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row, without sending the ids back."""
    tables = shared_tables(texts.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tables)
        for batch in batches:
            sizes = pa.array((len(encoder.encode(v)) // 4 for v in batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], [key, "n_tokens"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_tokens long")


def decoded(ids: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of every row of (key, ids)."""
    tables = shared_tables(ids.sparkSession, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tables.value[1].tokens)
        for batch in batches:
            texts = pa.array((decoder.decode(x or ()) for x in batch.column(1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], [key, "text"])

    kind = ids.schema[key].dataType.simpleString()
    return ids.select(key, "ids").mapInArrow(decode, f"`{key}` {kind}, text string")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))
