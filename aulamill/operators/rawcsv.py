"""Raw CSV records: typed columns, or a reject with one reason.

Each row of the input holds one record as bytes. A record that isn't UTF-8 or
whose quotes break the rule would swallow its neighbours in a CSV reader, so
these two are labelled first, by vector kernels over the column. The others are
read by pyarrow's CSV reader in one buffer per batch; its invalid-row callback
takes the records with a wrong number of fields. Every record carries its row
number as a leading field, so both the callback and the reader name the row.
All fields are read as strings; the cast to the declared kinds is by vectors,
and the first cell that fails is named.

Rules: the separator is a comma; a field in double quotes may hold commas, line
breaks and doubled quotes; a backslash means nothing; a field that doesn't
begin with a quote holds none.

Defined cases: a null record has no fields and fails as ``columns``, as does an
empty one and one with a line break outside quotes (it isn't one record); a
byte order mark is part of the first value; a record of any length is read
whole; repeated records are each reported; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Kind of a column -> pattern of its valid values (RE2, whole value).
KINDS = {
    "positive integer": r"^[1-9][0-9]{0,17}$",
    "text": r"(?s)^.+$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$",
    "count": r"^[0-9]{1,9}$",
    "percent": r"^(?:100(?:\.0{1,4})?|[0-9]{1,2}(?:\.[0-9]{1,4})?)$",
}
TYPES = {
    "positive integer": (pa.int64(), T.LongType()),
    "text": (pa.string(), T.StringType()),
    "timestamp": (pa.timestamp("us"), T.TimestampNTZType()),
    "count": (pa.int64(), T.LongType()),
    "percent": (pa.float64(), T.DoubleType()),
}

QUOTES = r'(?s)^(?:"(?:[^"]|"")*"|[^",][^",]*|)(?:,(?:"(?:[^"]|"")*"|[^",]+|))*$'
BARE_BREAK = r'(?s)^(?:(?:"(?:[^"]|"")*"|[^",\r\n]*),)*[^",\r\n]*[\r\n]'


def _cast(strings: pa.Array, kind: str, required: bool) -> tuple[pa.Array, pa.Array]:
    """Values of the kind, null where absent or invalid, and whether each is valid."""
    if kind == "text" and not required:
        return strings, pa.repeat(True, len(strings))
    absent = pc.equal(strings, "")
    fits = pc.match_substring_regex(strings, KINDS[kind])
    if kind == "text":
        fits = pc.and_(fits, pc.equal(pc.utf8_trim_whitespace(strings), strings))
    found = pc.if_else(fits, strings, pa.scalar(None, pa.string()))
    if kind == "timestamp":
        times = pc.strptime(found, format="%Y-%m-%d %H:%M:%S", unit="s", error_is_null=True)
        # A day that doesn't exist either has no time or comes back as another day.
        fits = pc.and_(fits, pc.fill_null(pc.equal(pc.strftime(times, format="%Y-%m-%d %H:%M:%S"), found), False))
        values = pc.if_else(fits, times, pa.scalar(None, times.type)).cast(pa.timestamp("us"))
    else:
        values = found.cast(TYPES[kind][0])
    valid = fits if required else pc.or_(fits, absent)
    return values, valid


def read_records(
    raw: DataFrame, columns: list[tuple[str, str, bool]], key: str = "line_id", line: str = "raw_line"
) -> DataFrame:
    """(key, columns..., failure, failed_column) of every raw record.

    ``columns`` are (label, kind, required) in order. ``failure`` is null for a
    valid record, else the first that applies of encoding, quoting, columns and
    value; the typed columns of a failed record are null.
    """
    key_kind = raw.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, key_kind)]
        + [T.StructField(label, TYPES[kind][1]) for label, kind, _ in columns]
        + [T.StructField("failure", T.StringType()), T.StructField("failed_column", T.StringType())]
    )
    names = ["#", *(str(i) for i in range(len(columns)))]
    read_as = csv.ConvertOptions(
        column_types={n: pa.string() for n in names} | {"#": pa.int64()},
        strings_can_be_null=False,
        quoted_strings_can_be_null=False,
        null_values=[],
    )
    text_rule = csv.ParseOptions(delimiter=",", quote_char='"', double_quote=True, escape_char=False, newlines_in_values=True)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lines = batch.num_rows, batch.column(1)
            failure: list[str | None] = [None] * n
            failed_column: list[str | None] = [None] * n
            texts: list[str | None] = []
            for i, value in enumerate(lines.to_pylist()):
                try:
                    texts.append(None if value is None else bytes(value).decode("utf-8"))
                except UnicodeDecodeError:
                    failure[i] = "encoding"
                    texts.append(None)
            strings = pa.array(texts, pa.string())
            quoted = pc.match_substring_regex(strings, QUOTES)
            broken = pc.match_substring_regex(strings, BARE_BREAK)
            buffer = io.BytesIO()
            for i, (text, good, cut) in enumerate(zip(texts, quoted.to_pylist(), broken.to_pylist(), strict=True)):
                if failure[i] is None:
                    if text is None or (good and cut):
                        failure[i] = "columns"
                    elif not good:
                        failure[i] = "quoting"
                    else:
                        buffer.write(b"%d," % i)
                        buffer.write(text.encode())
                        buffer.write(b"\n")
            out = [pa.nulls(n, TYPES[kind][0]) for _, kind, _ in columns]
            size = buffer.tell()
            if size:
                buffer.seek(0)

                def reject(row) -> str:
                    failure[int(row.text.split(",", 1)[0])] = "columns"
                    return "skip"

                text_rule.invalid_row_handler = reject
                reading = csv.ReadOptions(column_names=names, block_size=size + 1, use_threads=False)
                table = csv.read_csv(buffer, read_options=reading, parse_options=text_rule, convert_options=read_as)
                rows = table.column("#").combine_chunks()
                good = pa.repeat(True, len(rows))
                first_bad = pa.nulls(len(rows), pa.string())
                cells = []
                for i, (label, kind, required) in enumerate(columns):
                    values, valid = _cast(table.column(str(i)).combine_chunks(), kind, required)
                    first_bad = pc.if_else(pc.and_(good, pc.invert(valid)), pa.scalar(label), first_bad)
                    good = pc.and_(good, valid)
                    cells.append(values)
                for row, bad in zip(rows.to_pylist(), first_bad.to_pylist(), strict=True):
                    if bad is not None:
                        failure[row], failed_column[row] = "value", bad
                place = pc.index_in(pa.array(range(n), pa.int64()), value_set=pc.filter(rows, good))
                out = [pc.filter(c, good).take(place) for c in cells]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *out, pa.array(failure, pa.string()), pa.array(failed_column, pa.string())], schema.names
            )

    return raw.select(key, line).mapInArrow(parse, schema)


def declared_columns(table: DataFrame) -> list[tuple[str, str, bool]]:
    """(label, kind, required) in order, from a table of columns (a handful of rows)."""
    rows = table.select("col_no", "col_label", "col_kind", "required").collect()
    return [(r["col_label"], r["col_kind"], r["required"]) for r in sorted(rows, key=lambda r: r["col_no"])]


def valid_records(parsed: DataFrame) -> DataFrame:
    return parsed.where("failure is null").drop("failure", "failed_column")


def rejects(parsed: DataFrame, key: str = "line_id") -> DataFrame:
    return parsed.where("failure is not null").select(key, "failure", "failed_column")
