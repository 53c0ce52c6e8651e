"""Token counts from pre-token frequencies.

A tokenizer's pieces of a pre-token do not depend on its neighbours, so they
are counted once for each distinct pre-token of the corpus, and a document's
count is the sum of its pre-token frequencies times these. No ids are made.

The join has two parts. The `HEAD` most frequent pre-tokens, which are most of
any text, are broadcast with their counts (their number and length bound the
size) and joined while a document is read. What is left of a document, rare
pre-tokens, is joined by shuffle; a key of that join occurs at most as often as
the last of the head, or is longer than `HEAD_BYTES`, and adaptive joins split
the rare case that such a one is frequent.

White space ends a pre-token, so texts are cut at ASCII blanks first, and
distinct words are cut into pre-tokens, many to a call of the library.

Defined results: a null text counts as empty with no bytes and no tokens;
special strings inside a text are one token each, as is the library's default;
repeated rows give repeated result rows; ids may be null; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, most_frequent, numbered, stage
from .registry import query, table

#: Pre-tokens that are broadcast, and their length in bytes at most.
HEAD = 200_000
HEAD_BYTES = 128
#: Distinct words a worker counts, or keeps with their sums, at once.
WORDS = 600_000


class PreTokens:
    """Pre-tokens of words, by the tokenizer's own normalizer and pre-tokenizer."""

    #: Words handed to the library in one call.
    AT_ONCE = 512

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)).encode()) if special else None

    def words(self, text: bytes) -> tuple[list[bytes], int]:
        """Words of a text, and the number of special strings in it."""
        found = 0
        if self.special is not None and b"<" in text:
            text, found = self.special.subn(b" ", text)
        return text.split(), found

    def of(self, words: list[bytes]) -> Iterator[tuple[bytes, list[str]]]:
        """Each word with its pre-tokens, many words to a call.

        The words of a call are told apart by the blanks between them. Words that
        hold white space of any kind are cut one by one, and so are those of a call
        in which normalizing made or lost a blank.
        """
        joined, alone = [], []
        for word in words:
            text = word.decode()
            (joined if text.split() == [text] else alone).append(word)
        for at in range(0, len(joined), self.AT_ONCE):
            part = joined[at : at + self.AT_ONCE]
            normal = self.tokenizer.normalizer.normalize_str(b"\n".join(part).decode())
            pieces = normal.split(" ")
            if len(pieces) == len(part) and all(pieces):
                yield from zip(part, self._cut(normal, pieces))
            else:
                alone += part
        for word in alone:
            normal = self.tokenizer.normalizer.normalize_str(word.decode())
            yield word, [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _cut(self, normal: str, pieces: list[str]) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in pieces]
        k, end = 0, len(pieces[0])
        for found, (start, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            while start >= end:
                k += 1
                end += 1 + len(pieces[k])
            out[k].append(found)
        return out


def _parts(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in order, some at a time: one, or as many as come to `size` bytes."""
    part: list[bytes] = []
    taken = 0
    for text in texts:
        part.append(text.as_py())
        taken += len(part[-1])
        if taken >= size:
            yield part
            part, taken = [], 0
    if part:
        yield part


def vocabulary(rows: DataFrame, tokenizer_json) -> DataFrame:
    """Distinct `pre_token` of all texts with `n`, its occurrences, and `pieces`, its number of tokens; staged."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PreTokens(tokenizer_json.value)
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            total: Counter = Counter()
            for word, parts in known.of(list(seen)):
                n = seen[word]
                for p in parts:
                    total[p] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pre_token", "n"])

        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                seen.update(known.words(text)[0])
                if len(seen) > WORDS:
                    yield flush()
        yield flush()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = PreTokens(tokenizer_json.value).tokenizer.model.tokenize
        for batch in batches:
            found = [len(tokenize(p)) for p in batch.column("pre_token").to_pylist()]
            yield batch.append_column("pieces", pa.array(found, pa.int64()))

    distinct = map_batches(rows.select("text"), count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return stage(map_batches(distinct, pieces, "pre_token string, n long, pieces long"), "pre-tokens")


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", head_size: int = HEAD) -> DataFrame:
    """`id`, `n_bytes`, `n_tokens` of every row.

    `tokenizer_path` is read on the driver. Texts are read twice and not
    shuffled; pre-tokens are combined in the tasks before they are.
    """
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = spark.sparkContext.broadcast(f.read())
    rows = numbered(df, text, id_col)
    counted = vocabulary(rows, tokenizer_json)
    top = most_frequent(counted.where(F.octet_length("pre_token") <= HEAD_BYTES), "n", head_size).select("pre_token", "pieces").toArrow()
    head = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, in_head = PreTokens(tokenizer_json.value), head.value
        sums: dict[bytes, int | tuple[int, list[str]]] = {}
        for batch in batches:
            sizes, totals, rests = [], [], []
            for some in _parts(batch.column("text").cast(pa.binary())):
                cut = [known.words(text) for text in some]
                counted_words = [Counter(words) for words, _ in cut]
                if len(sums) > WORDS:
                    sums.clear()
                for word, parts in known.of(list(set().union(*counted_words).difference(sums))):
                    in_it = sum(in_head.get(p, 0) for p in parts)
                    missing = [p for p in parts if p not in in_head]
                    sums[word] = (in_it, missing) if missing else in_it
                for text, (_, total), counts in zip(some, cut, counted_words):
                    rest: Counter = Counter()
                    for word, n in counts.items():
                        found = sums[word]
                        if type(found) is tuple:
                            for p in found[1]:
                                rest[p] += n
                            found = found[0]
                        total += found * n
                    sizes.append(len(text))
                    totals.append(total)
                    rests.append([{"p": p, "n": n} for p, n in rest.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(rests, pa.list_(pa.struct([("p", pa.string()), ("n", pa.int64())])))],
                names=["row_id", "id", "n_bytes", "in_head", "rest"],
            )

    placed = rows.select("row_id", "text", F.col(id_col).cast("long").alias("id"))
    known = stage(map_batches(placed, work, "row_id long, id long, n_bytes long, in_head long, rest array<struct<p:string,n:long>>"), "frequencies")
    rest = known.select("row_id", F.inline("rest")).join(counted.select(F.col("pre_token").alias("p"), "pieces"), "p").groupBy("row_id").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    return known.select("row_id", "id", "n_bytes", "in_head").join(rest, "row_id", "left").select("id", "n_bytes", (F.col("in_head") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, and whether it is over a context of 2048."""
    import public_tokenizers

    found = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
