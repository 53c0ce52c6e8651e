"""Byte-level BPE, encoded by a tree reduction.

The tokens of a byte string form a monoid element: `encode(a + b)` follows from
the tokens of `a` and `b`. A string is encoded by halves; two neighbours are
joined by encoding a window around the seam anew, a few tokens of either side,
growing until the tokens outside are stable. Stability can be proved from pairs
alone: a token sequence is the encoding of its bytes exactly if each two
neighbouring tokens are the encoding of theirs, because the first merge across
a border depends on the two tokens beside it only. So a window is wide enough
when the pairs across its two edges encode to themselves. In the worst case it
grows to the whole string and the join is the plain encoding.

A text is a product of elements too. The split pattern never lets a match run
from a non-space into a following space, so a text is cut there; each cut piece
is split by the pattern, each match encoded by halves, and joining across a
border of the pattern is concatenation. Decoding concatenates the tokens' bytes
up the same kind of tree.

Pieces recur, so each Python worker keeps the ids of those seen first, up to
`CACHE_PIECES`; the others are encoded when met.

Defined results: a null text counts as empty and has no tokens; unpaired
surrogates cannot occur in Spark strings; decoding gives the text's bytes back
for every text; repeated rows give repeated result rows; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches
from .registry import query, table

#: Bytes up to which a string is encoded without being halved.
LEAF_BYTES = 24
#: Pieces and matches a worker keeps.
CACHE_PIECES = 400_000
#: Tokens of either side that a seam's first window takes.
WINDOW = 2


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token bytes from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class TreeEncoder:
    """Encoding of byte strings by ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.stable = lru_cache(1 << 16)(self._stable)

    def leaf(self, data: bytes) -> list[bytes]:
        """Plain merging: the lowest rank first, the leftmost of equals."""
        if len(data) > 4 * LEAF_BYTES:
            return self.long_leaf(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while pairs:
            low, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
        return parts

    def long_leaf(self, data: bytes) -> list[bytes]:
        """The same for a wide window, with the merges in a heap and the parts in a linked list."""
        n, ranks = len(data), self.ranks
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) == n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of its sides has been merged since
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := ranks.get(both := parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, len(both)))
        return [p for p in parts if p is not None]

    def _stable(self, left: bytes, right: bytes) -> bool:
        return self.leaf(left + right) == [left, right]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Tokens of the joined string from those of its halves."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        a = b = WINDOW
        while True:
            head, tail = left[:-a], right[b:]
            middle = self.leaf(b"".join(left[-a:] + right[:b]))
            grow_left = bool(head) and not self.stable(head[-1], middle[0])
            grow_right = bool(tail) and not self.stable(middle[-1], tail[0])
            if not grow_left and not grow_right:
                return head + middle + tail
            a, b = a * (1 + grow_left), b * (1 + grow_right)

    def encode(self, data: bytes) -> list[bytes]:
        """Tokens of one match of the split pattern."""
        if data in self.ranks:
            return [data]
        if len(data) <= LEAF_BYTES:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))


def decode(ids: Sequence[int], token_bytes: list[bytes]) -> bytes:
    """Bytes of the ids, concatenated pairwise up a tree of blocks."""
    level = [b"".join(map(token_bytes.__getitem__, ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
    while len(level) > 1:
        level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else b""


class TextEncoder:
    """Encoding of texts: ids as little-endian unsigned 32-bit integers."""

    #: A piece starts at a space or line end that follows neither of them.
    PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
    #: Other white space before a space or line end: there a cut would part a run of white space.
    UNSAFE = re.compile(r"[^\S \n][ \n]")

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.ranks = read_ranks(rank_file)
        self.tree = TreeEncoder(self.ranks)
        self.split = regex.compile(pattern)
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.token_bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token
        encoder = self

        class Matches(dict):
            def __missing__(self, match: str) -> bytes:
                ids = b"".join(map(encoder.packed.__getitem__, encoder.tree.encode(match.encode())))
                if len(self) < CACHE_PIECES and len(match) < 64:
                    self[match] = ids
                return ids

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = b"".join(map(encoder.matches.__getitem__, encoder.split.findall(piece)))
                if len(self) < CACHE_PIECES and len(piece) < 64:
                    self[piece] = ids
                return ids

        self.matches, self.pieces = Matches(), Pieces()

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        if self.UNSAFE.search(text):
            return b"".join(map(self.matches.__getitem__, self.split.findall(text)))
        return b"".join(map(self.pieces.__getitem__, self.PIECES.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids."""
        return decode(memoryview(ids).cast("I"), self.token_bytes)


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The kept columns as struct `row`, `n_tokens`, digests of ids and decoded bytes and, if wanted, the `ids`.

    `rank_path` is read on the driver; a vocabulary is a few megabytes and its
    size does not depend on the data. Rows stay where they are: no shuffle.
    """
    with open(rank_path, "rb") as f:
        rank_file = df.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(rank_file.value, pattern)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("row"),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(encoder.decode(i)).hexdigest() for i in ids]),
            ]
            if with_ids:
                ends = np.cumsum([0] + [len(i) // 4 for i in ids])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    packed = df.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    return map_batches(packed, work, f"row {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_ids(df: DataFrame, rank_path: str, ids: str = "ids") -> DataFrame:
    """All columns but `ids` as struct `row`, and `decoded`, the bytes of the ids (null: empty)."""
    with open(rank_path, "rb") as f:
        rank_file = df.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(rank_file.value, "")
        for batch in batches:
            decoded = [decode(i or [], encoder.token_bytes) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(decoded, pa.binary())], names=["row", "decoded"])

    packed = df.select(F.struct(*[F.col(c) for c in df.columns if c != ids]).alias("row"), F.col(ids).alias("ids"))
    return map_batches(packed, work, f"row {packed.schema['row'].dataType.simpleString()}, decoded binary")


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the bytes decoded from them."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
