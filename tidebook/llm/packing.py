"""Best-fit decreasing packing of tokenised documents into sequences of fixed length.

Documents are tokenised where they lie; only a few numbers per piece are shuffled. Pieces are dealt by a hash
into shards of about SHARD pieces, and each shard is packed by itself, longest piece first, into the open
sequence with the least sufficient room. A segment tree over the remaining capacities finds it in
log2(capacity) steps. A shard ends with at most a few part-filled sequences, so the loss against one global
packing is of the order of 1 sequence in some thousands, at any corpus size.

Defined results: a null or empty text is the end token alone; repeated rows and null ids are packed like any
other; an empty table gives no rows; extra columns are ignored. Only documents longer than a sequence are cut:
all pieces but the first are full.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import batches as arrow, stage_table

CAPACITY = 1024
END = 2
#: Pieces that one task packs.
SHARD = 16_384
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of the ``byte_bpe_50k`` vocabulary.

    ``tiktoken`` runs the same merges as ``tokenizers`` four times as fast from the same vocabulary's rank
    file; texts that spell the special token, which only ``tokenizers`` treats specially, go to that library.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.slow = None

    def __call__(self, text: str | None) -> list[int]:
        text = text or ""
        if SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.vocabulary)
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter than the capacity."""
    start, length = 0, n % capacity or min(n, capacity)
    while start < n:
        yield start, length
        start, length = start + length, capacity


class OpenBins:
    """Open bins by remaining room, in a segment tree whose leaves are the rooms 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, number) of an open bin with the least room of at least ``need``; removes it."""
        node, count = self.leaves + need, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a right neighbour has bins
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:  # down to its first leaf with bins
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each item; items are placed longest first, ties in their order."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    open_bins, n_bins = OpenBins(capacity), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_bins.take(lengths[i])
        if found is None:
            found, n_bins = (capacity, n_bins), n_bins + 1
        room, number = found
        placed[i] = (number, capacity - room)
        if room > lengths[i]:
            open_bins.put(room - lengths[i], number)
    return placed


def pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every document's pieces."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def tokenised(batches):
        import numpy as np
        import pyarrow as pa

        encode = Encoder()
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encode(body.as_py()), END], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = (doc_id.as_py(), k, start, length, zlib.crc32(own.tobytes()), own.tolist())
                    for values, value in zip(out.values(), row, strict=False):
                        values.append(value)
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in out.items()], names=list(out))

    return arrow(docs.select("doc_id", text)).mapInArrow(tokenised, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with sequence_id and offset."""
    parts = stage_table(parts, "pieces")
    shards = max(1, math.ceil(parts.count() / SHARD))
    dealt = arrow(parts).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))

    def packed(table):
        import pyarrow as pa

        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        places = best_fit_decreasing(table.column("length").to_pylist(), capacity)
        first = table.column("shard")[0].as_py() << 32
        return table.drop_columns("shard").append_column("sequence_id", pa.array([first + b for b, _ in places], pa.int64())).append_column(
            "offset", pa.array([o for _, o in places], pa.int64())
        )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(packed, schema)


def query(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs))
