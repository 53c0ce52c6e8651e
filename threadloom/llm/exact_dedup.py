"""Exact deduplication by Grace hashing.

Every text is placed in an open-addressing table that compares complete
contents. A table takes texts until its byte budget is used; records whose text
is not in the full table are spilled, partitioned by the next bits of their
digest, and each spill file is worked off by the same step. A pass always
settles a table full of texts, so it ends for any data, and copies take no
space: a bucket of equal texts is one entry however many they are.

The work is done twice: within each input split, so that a text copied into a
third of all rows leaves a split as one record; then on the representatives,
dealt to buckets by their digest. The rows themselves never meet by text.

Defined results: a null text counts as empty; texts are equal when identical
after lower-casing A-Z; of equal texts the largest id stays, of equal ids the
first row read; a null id is below all others; repeated rows are copies; an
empty table gives an empty result; other columns pass through untouched
whatever their names, as they travel inside one struct.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, stage, texts
from .registry import query, table

#: Bytes of distinct texts that one table holds.
TABLE_BYTES = 48 << 20
FAN_OUT_BITS = 4


class ContentTable:
    """Open-addressing table from content to class number."""

    def __init__(self, limit: int) -> None:
        self.limit, self.used = limit, 0
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.classes: list[int] = []

    def lookup(self, digest: int, content: bytes, fresh: int) -> int | None:
        """Class of the content, entered as class `fresh` if new; None if it is new and the table full."""
        mask = len(self.slots) - 1
        at = digest & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == digest and self.contents[k] == content:
                return self.classes[k]
            at = (at + 1) & mask
        if self.used and self.used + len(content) > self.limit:
            return None
        self.slots[at] = len(self.hashes)
        self.hashes.append(digest)
        self.contents.append(content)
        self.classes.append(fresh)
        self.used += len(content) + 100
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return fresh

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, digest in enumerate(self.hashes):
            at = digest & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def settle(batches: Iterator[pa.RecordBatch], text_of, first_class: int, limit: int, depth: int = 0) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes], list[bool]]]:
    """Each batch's settled rows with class, digest and whether the row opened its class.

    A class is numbered `first_class` plus the place of its first row in the
    task. Rows that find the table full go to spill files of the task attempt,
    which are unlinked at once and vanish with it, as Spark's own spills do.
    """
    content_table, spills = ContentTable(limit), {}
    for batch in batches:
        places = batch.column("place").to_pylist()
        rows, classes, digests, opened, later = [], [], [], [], {}
        for i, text in enumerate(texts(text_of(batch))):
            text = text.lower()
            digest = hashlib.sha256(text).digest()
            fresh = first_class + places[i]
            found = content_table.lookup(int.from_bytes(digest[-8:], "little"), text, fresh)
            if found is None:
                later.setdefault(digest[depth % 16 // 2] >> FAN_OUT_BITS * (depth % 2) & 15, []).append(i)
            else:
                rows.append(i)
                classes.append(found)
                digests.append(digest)
                opened.append(found == fresh)
        if rows:
            yield batch if len(rows) == batch.num_rows else batch.take(pa.array(rows)), classes, digests, opened
        for bucket, at in later.items():
            if bucket not in spills:
                file = tempfile.TemporaryFile()
                spills[bucket] = file, pa.ipc.new_stream(file, batch.schema)
            spills[bucket][1].write_batch(batch.take(pa.array(at)))
    del content_table
    for file, writer in spills.values():
        writer.close()
        file.seek(0)
        with file, pa.ipc.open_stream(file) as stream:
            yield from settle(iter(stream), text_of, first_class, limit, depth + 1)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with each row's place in the task as a further column."""
    at = 0
    for batch in batches:
        yield batch.append_column("place", pa.array(range(at, at + batch.num_rows), pa.int64()))
        at += batch.num_rows


def classes_by_content(df: DataFrame, text: str, limit: int = TABLE_BYTES) -> DataFrame:
    """Rows as struct `row` with `cls` (class within the split), `place`, `digest` and `opened`; staged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for batch, classes, digests, opened in settle(_place(batches), lambda b: b.column("row").field(text), first, limit):
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(classes, pa.int64()), batch.column("place"), pa.array([d.hex() for d in digests]), pa.array(opened)],
                names=["row", "cls", "place", "digest", "opened"],
            )

    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    return stage(map_batches(packed, work, f"row {kind}, cls long, place long, digest string, opened boolean"), "exact-classes")


def merge_classes(local: DataFrame, text: str, limit: int = TABLE_BYTES) -> DataFrame:
    """`cls` of each split with `whole`, the class over all splits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: dict[int, int] = {}
        for batch, classes, _, opened in settle(_place(batches), lambda b: b.column("text"), 0, limit):
            own = batch.column("cls").to_pylist()
            members.update((c, o) for c, o, new in zip(classes, own, opened) if new)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([members[c] for c in classes], pa.int64())], names=["cls", "whole"])

    firsts = local.where("opened").select("cls", "digest", F.col("row")[text].alias("text")).repartition("digest").select("cls", "text")
    return map_batches(firsts, work, "cls long, whole long")


def resolve(df: DataFrame, text: str = "text", id_col: str = "doc_id", limit: int = TABLE_BYTES) -> DataFrame:
    """Every row as struct `row` with `keep_id`, `group_size`, `kept` and `text_sha256`.

    Shuffles: the representatives' texts once, and narrow rows. What is joined
    by class holds a split's rows at most, so no key is hot.
    """
    local = classes_by_content(df, text, limit)
    counted = local.select("cls", "place", F.col("row")[id_col].alias("id")).groupBy("cls").agg(
        F.max(F.struct("id", (-F.col("cls")).alias("cls"), (-F.col("place")).alias("place"))).alias("best"), F.count("*").alias("n")
    )
    group = Window.partitionBy("whole")
    whole = merge_classes(local, text, limit).join(counted, "cls").select("cls", F.max("best").over(group).alias("best"), F.sum("n").over(group).alias("group_size"))
    return local.join(whole, "cls").select(
        "row",
        F.col("best.id").alias("keep_id"),
        "group_size",
        ((F.col("cls") == -F.col("best.cls")) & (F.col("place") == -F.col("best.place"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(df: DataFrame, text: str = "text", id_col: str = "doc_id", limit: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, one of each group of equal texts, with the columns of the input."""
    return resolve(df, text, id_col, limit).where("kept").select("row.*")


_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
  doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256
from d
"""


@query("op6_exact_dedup", _SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the row that stays of its group of equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resolve(docs).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
