"""Packing tokenised documents into fixed-length training sequences.

Documents are tokenised once, cut into whole sequences and one shorter rest each, and every piece carries the
checksum of its ids, so ids never move. Pieces are dealt into groups by a hash of their place; each group packs
by first-fit decreasing over a tournament tree of bin capacities.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

LENGTH = 1024
END = 0
# Fixed value: how byte-level BPE files of this kind split a text before merging.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Pieces of one packing group on average.
GROUP = 8192
_CUT = "id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, row bigint"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item. Longest items first, equal ones in the given order; each goes to the first
    bin with room. The tree's leaves hold the room of each bin, an inner node the most room below it."""
    n = len(lengths)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-lengths, kind="stable"):
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left > right else right
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offsets


def _encoder(tokenizer_path: str):
    """A function from a text to its ids under a byte-level BPE file of the ``tokenizers`` library.

    The file's vocabulary is run by ``tiktoken``, several times faster at the same ids; a text that holds one of
    the file's special tokens is left to ``tokenizers`` itself."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [t["content"] for t in spec.get("added_tokens", ())]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that such a file writes as themselves
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(letters[ch] for ch in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    fast, whole = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(tokenizer_path)

    def encode(text: str) -> np.ndarray:
        if any(token in text for token in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def _pieces(tokenizer_path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for k, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), end).astype("<u4")
                out += [(k, i, min(length, len(ids) - i), zlib.crc32(ids[i : i + length].tobytes()), len(ids)) for i in range(0, len(ids), length)]
            if out:
                k, *columns = (np.array(c, np.int64) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(k)), *map(pa.array, columns), batch.column("row").take(pa.array(k))], ["id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return run


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("row", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), capacity)
        number = (group.column("part").to_numpy() << np.int64(32)) + bins
        return group.drop_columns(["part", "row"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets))

    return run


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, group: int = GROUP) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's ids are those of its text and then ``end``; null and empty texts have ``end`` alone. Repeated
    rows are packed each for itself. A null id is packed like another. Other columns are not read. An empty table
    gives an empty table. ``sequence_id`` is a group's number times 2**32 plus the bin's number in it."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    pieces = materialise(held.mapInArrow(_pieces(tokenizer_path, length, end), _CUT.format(kind=kind)))
    parts = max(1, round(pieces.count() / group))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("id", "row", "start"), F.lit(parts)).cast("bigint"))
    return dealt.groupBy("part").applyInArrow(_pack(length), f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)
