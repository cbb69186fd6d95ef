"""Helpers shared by the corpus operators: words as bytes, columns added by Arrow batches, the data split."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: letters, digits and all bytes above ASCII
#: stay, everything else becomes a blank. ``bytes.split`` then cuts at ASCII blanks only.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return text.translate(_ALNUM).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words between ASCII blanks (space, tab to carriage return), A-Z lower-cased."""
    return text.lower().split()


def held_out(doc_id: Column) -> Column:
    """The split: True where crc32 of the id as text leaves 1 modulo 3. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


PART_BYTES = 4 << 20
_held: dict[str, Any] = {}


def remembered(key: str, build: Callable[[], Any]) -> Any:
    """What ``build`` made for ``key`` in this worker process; one thing is held at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def add_columns(
    df: DataFrame, read: list[str], ddl: str, make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """``df`` with the columns of ``ddl``, computed batch by batch where the rows are.

    ``make()`` is called once per task and returns a function from one list per column in ``read``
    to one list per new column. Strings arrive as UTF-8 bytes. An input column whose name is taken
    by a new one is replaced.
    """
    added = T._parse_datatype_string(ddl)
    old = df.columns
    lower = {f.name.lower() for f in added}
    keep = [i for i, name in enumerate(old) if name.lower() not in lower]
    where = [old.index(name) for name in read]
    schema = T.StructType([df.schema[i] for i in keep] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fn = make()
        types = [f.type for f in to_arrow_schema(added)]
        for whole in batches:
            # a batch of long texts is worked on in parts, so that little is held beside it
            rows = max(1, whole.num_rows * PART_BYTES // max(PART_BYTES, whole.nbytes))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                columns = [batch.column(i) for i in where]
                columns = [
                    (c.cast(pa.binary()) if pa.types.is_string(c.type)
                     else c.cast(pa.large_binary()) if pa.types.is_large_string(c.type) else c).to_pylist()
                    for c in columns
                ]
                made = [pa.array(v, t) for v, t in zip(fn(*columns), types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in keep] + made, names=schema.names
                )
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` under names that no operator adds, the new name of each column, and the way back."""
    names = [f"__c{i}" for i in range(len(docs.columns))]

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(new).alias(old) for new, old in zip(names, docs.columns)])

    return docs.toDF(*names), dict(zip(docs.columns, names)), back
