"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents are dealt by a hash of key and text into groups of about ``group_docs``; each group is packed on its own,
so groups run in parallel and a group's state is bounded. A document's ids are cut into pieces of ``length``; whole
pieces fill a sequence each, the remainders of a group are sorted by falling length and each goes into the first
sequence with room, which the tree finds in logarithmic time.

Rows: a null or empty text is a document of the end id alone. Null keys and repeated rows are documents like any
other. An empty table gives no pieces. Columns other than the key and the text are ignored. A group that equal rows
make very large is closed after ``4 * group_docs`` documents and another one begun.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common, tokens

PIECES = "key long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class TournamentTree:
    """Largest free capacity below each node; leaves are bins in the order in which they were opened."""

    def __init__(self, leaves: int, capacity: int):
        self.base = 1 << max(0, (leaves - 1).bit_length())
        self.tree = [capacity] * (2 * self.base)

    def place(self, size: int) -> tuple[int, int]:
        """Takes `size` from the first bin with room: its number and what was free there."""
        tree, node = self.tree, 1
        while node < self.base:
            node *= 2
            if tree[node] < size:
                node += 1
        free, bin_no = tree[node], node - self.base
        tree[node] = free - size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return bin_no, free


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each item, in the items' order, and the number of bins."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    tree, bins, offsets = TournamentTree(max(1, len(sizes)), capacity), [0] * len(sizes), [0] * len(sizes)
    for i in order:
        bins[i], free = tree.place(sizes[i])
        offsets[i] = capacity - free
    return bins, offsets, max(bins, default=-1) + 1


def _packer(length: int, tokenizer: str, end_id: int, most: int, cache_words: int = tokens.CACHE_WORDS):
    def emit(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(),) * 6 + (pa.binary(),)
        names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, kept = None, 0, []

        def close():
            nonlocal used, kept
            if kept:
                # Equal sizes in the order of key, place and ids: the result doesn't hang on the rows' order.
                kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))
                bins, offsets, n = first_fit_decreasing([r[2] for r in kept], length)
                for at in range(0, len(kept), 512):
                    yield emit([(k, s, m, d, (group << 32) + used + b, o, raw) for (k, s, m, d, raw), b, o in zip(kept[at : at + 512], bins[at:], offsets[at:])])
                used += n
                kept = []

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            full = []
            for g, key, ids in zip(groups, keys, tokens.encoder(tokenizer, cache_words).encode_batch(batch.column(2))):
                if g != group or len(kept) >= most:
                    yield from close()
                    used = 0 if g != group else used
                    group = g
                ids = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                for s in range(0, n - length + 1, length):
                    full.append((key, s, length, n, (group << 32) + used, 0, ids[s : s + length].tobytes()))
                    used += 1
                    if len(full) >= 512:
                        yield emit(full)
                        full = []
                if rest := n % length:
                    kept.append((key, n - rest, rest, n, ids[n - rest :].tobytes()))
            if full:
                yield emit(full)
        yield from close()
        common.trim()

    return pack


def pack_documents(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    length: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 1,
    group_docs: int = 1024,
    batch_docs: int = 3000,
    cache_words: int = tokens.CACHE_WORDS,
) -> DataFrame:
    """A row for each piece: key, start, length, doc_tokens, sequence_id, offset and its ids (little-endian 32-bit).

    batch_docs and cache_words bound what a Python worker holds: documents at once, and words whose ids are kept. The
    pieces don't depend on them.
    """
    spark = docs.sparkSession
    common.small_batches(spark, batch_docs)
    n_groups = max(1, -(-docs.count() // group_docs))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    grouped = rows.select(F.pmod(F.xxhash64("key", "text"), F.lit(n_groups)).alias("group"), "key", "text")
    dealt = grouped.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_packer(length, tokenizer or tokens.default_tokenizer(), end_id, 4 * group_docs, cache_words), PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: documents packed into sequences of 2048 ids, end id 1; see the module."""
    return pack_documents(common.table(spark, sf_dir, "documents"), length=2048, end_id=1).select(
        F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
