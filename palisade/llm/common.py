"""Helpers shared by the operators: row-wise Arrow mapping over whole texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that one step of a task turns into Python strings at once; bounds the memory of a Python worker.
STEP_BYTES = 2_000_000


_HELD: dict = {}


def held(key, make: Callable[[], object]) -> object:
    """The model, index or encoder that a Python worker keeps between tasks: one at a time, whatever operator it is of, so that
    a job of several operators doesn't gather all of theirs in the worker. What is freed goes back to the system."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass
        _HELD[key] = make()
    return _HELD[key]


def steps(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) over an Arrow column of texts (null: empty): about step_bytes a step, at least one text."""
    ends = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).cumsum(dtype="int64")
    lo = 0
    while lo < len(column):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(ends.searchsorted(before + step_bytes, "right")))
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list]], added: str, text: str = "text", keep_text: bool = False, step_bytes: int = STEP_BYTES) -> DataFrame:
    """df's columns except text, and the added ones (a DDL string), computed from whole texts in Arrow batches.

    make() runs once a task and returns a function from a list of texts (null: empty) to the added columns as
    sequences. Rows keep their order and number; columns that the added ones would clash with are replaced.
    """
    new = schema_of(added)
    keep = [f for f in df.schema.fields if (keep_text or f.name != text) and f.name not in new.names]
    out_schema = T.StructType([*keep, *new.fields])
    arrow, names = to_arrow_schema(out_schema), [f.name for f in keep]
    n = len(new.fields)

    def run(batches):
        fn = make()
        for b in batches:
            kept = [b.column(name) for name in names]
            for lo, hi, texts in steps(b.column(text), step_bytes):
                cols = fn(texts)
                made = [c if isinstance(c, pa.Array) else pa.array(c, type=arrow.field(len(names) + k).type) for k, c in enumerate(cols[:n])]
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo).cast(arrow.field(k).type) for k, c in enumerate(kept)] + made, schema=arrow)

    return df.select(*names, *([] if keep_text else [text])).mapInArrow(run, out_schema)


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list]], added: str, keep: str | Column) -> DataFrame:
    """The rows of docs, all columns and names as they are, for which keep holds over the added columns."""
    names = docs.columns
    plain = docs.toDF(*[f"__c{k}" for k in range(len(names))])
    made = map_texts(plain, make, added, text=f"__c{names.index('text')}", keep_text=True)
    return made.where(keep).select(*[F.col(f"__c{k}").alias(n) for k, n in enumerate(names)])


def add_to_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list]], added: str) -> DataFrame:
    """All rows and columns of docs as they are (null texts stay null), then the added columns; a column of docs that has
    the name of an added one gives way to it."""
    names, new = docs.columns, schema_of(added).names
    plain = docs.toDF(*[f"__c{k}" for k in range(len(names))])
    made = map_texts(plain, make, added, text=f"__c{names.index('text')}", keep_text=True)
    return made.select(*[F.col(f"__c{k}").alias(n) for k, n in enumerate(names) if n not in new], *new)


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, mod; null ids count as 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % mod, F.lit(0))
