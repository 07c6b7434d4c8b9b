"""Text groups and mailboxes: how the corpus-wide operators share statistics.

Documents are hashed into groups of a few MB (``text_groups``). A step sends, for
each group, one compact binary letter to each key bucket that it has keys for;
the bucket's task answers with a letter to the group. A key arrives at its bucket
at most once from each group, however often it occurs, so a hot key costs one
entry a group. Texts cross one exchange, which all steps of a plan reuse.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ship import ship

GROUP_BYTES = 4 << 20
LETTER = "bucket int, pid int, blob binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("blob", pa.binary())])


def group_count(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """Groups of about ``group_bytes`` of text; one small aggregate over the table."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    return max(4, math.ceil(total / group_bytes))


def text_groups(docs: DataFrame, groups: int, *extra: Column) -> DataFrame:
    """doc_id, text as bytes, further columns, and the group ``pid`` of each row."""
    ship(docs.sparkSession)
    text = F.col("text")
    pid = F.pmod(F.xxhash64("doc_id", F.crc32(text)), F.lit(groups)).cast("int")
    return docs.select("doc_id", text.cast("binary").alias("text"), *extra, pid.alias("pid"))


def letters(out: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*out)) or [(), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def rows_of(table: pa.Table) -> pa.Table:
    """The group's documents in an order that any recomputation repeats."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def inbox(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """Letters in the order of (bucket, pid)."""
    return sorted(zip(*(table[c].to_pylist() for c in ("bucket", "pid", "blob"))), key=lambda x: x[:2])


def ask(docs: DataFrame, mail: DataFrame | None, step: Callable) -> DataFrame:
    """Letters of every group: ``step(pid, rows, inbox) -> [(bucket, pid, blob)]``."""
    if mail is None:
        def alone(table: pa.Table) -> pa.Table:
            return letters(step(table["pid"][0].as_py(), rows_of(table), []))

        return docs.groupBy("pid").applyInArrow(alone, LETTER)

    def both(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return letters([])
        return letters(step(table["pid"][0].as_py(), rows_of(table), inbox(got)))

    return docs.groupBy("pid").cogroup(mail.groupBy("pid")).applyInArrow(both, LETTER)


def answer(mail: DataFrame, step: Callable) -> DataFrame:
    """Replies of every bucket: ``step(inbox) -> [(bucket, pid, blob)]``."""

    def each(table: pa.Table) -> pa.Table:
        return letters(step(inbox(table)))

    return mail.groupBy("bucket").applyInArrow(each, LETTER)


def finish(docs: DataFrame, mail: DataFrame, step: Callable, schema: str) -> DataFrame:
    """Result rows of every group: ``step(pid, rows, inbox) -> pa.Table``."""

    def both(table: pa.Table, got: pa.Table) -> pa.Table:
        pid = table["pid"][0].as_py() if table.num_rows else -1
        return step(pid, rows_of(table), inbox(got))

    return docs.groupBy("pid").cogroup(mail.groupBy("pid")).applyInArrow(both, schema)
