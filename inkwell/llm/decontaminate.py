"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

A window is `window` consecutive words of an item; a shorter item is one window. Its set are its shingles of up to
five words. A window that occurs in a document has all its shingles there, so its rarest one is a sufficient prefix:

1. items are dealt into blocks of at most `block_items`, each written to the shared folder;
2. one pass over the documents counts every shingle of every block: that is the order by rarity;
3. each block's index maps the rarest shingle of every window to the window and the shingle's place in it;
4. a second pass probes the indexes with every shingle of every document. A hit fixes where the window would lie
   (positional bound) and whether it fits (length bound); there the window's words are compared exactly.

Documents are only ever streamed; they are not shuffled, and no pair leaves the task that finds it. A task holds one
block at a time besides the last used ones, so memory doesn't grow with the benchmark; the cost of the passes does.

Rows: a document or item that is null, empty or without words has no words, no windows and no hits. Repeated
documents are judged alike; equal items each count; rows of one item_id are one item. An item without id counts as
''. Empty tables give no rows or no hits. Other columns are kept by drop_contaminated() and ignored otherwise.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm import common

SHINGLE = 5
WINDOW = 13
_BITS = 20
_CACHE: dict[str, object] = common.keep({})


def _load(uri: str, most: int = 4):
    """A block from the shared folder; the last few stay in the worker."""
    common.claim("blocks")
    if uri not in _CACHE:
        while len(_CACHE) >= most:
            _CACHE.pop(next(iter(_CACHE)))
        fs, path = common.open_fs(uri)
        with fs.open_input_file(path) as f:
            _CACHE[uri] = pickle.loads(f.read())
    return _CACHE[uri]


def _save(uri: str, value: object) -> None:
    """Written under a name of its own and moved, so that no reader sees half a file."""
    fs, path = common.open_fs(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(pickle.dumps(value, protocol=5))
    fs.move(part, path)


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _BITS, bool)
    out[hashes >> np.uint64(64 - _BITS)] = True
    return out


def _probe(runs: np.ndarray, known: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs that are in `known` (sorted), and their places there."""
    at = np.flatnonzero(bitmap[runs >> np.uint64(64 - _BITS)])
    if not len(at) or not len(known):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(known, runs[at]), len(known) - 1)
    found = known[place] == runs[at]
    return at[found], place[found]


def _windows(items: list[tuple], window: int) -> list[tuple[str, list[bytes]]]:
    out = []
    for item_id, text in items:
        words = common.alnum_words(text)
        size = min(window, len(words))
        if size:
            name = "" if item_id is None else str(item_id)
            out += [(name, words[i : i + size]) for i in range(len(words) - size + 1)]
    return out


def _write_blocks(folder: str, window: int):
    """Windows and the shingles of a block, the latter by their length."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[int, list] = {}
        for batch in batches:
            for block, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                items.setdefault(block, []).append((item, text))
        for block, rows in items.items():
            found: dict[int, set] = {}
            windows = _windows(rows, window)
            for _, words in windows:
                size = min(SHINGLE, len(words))
                found.setdefault(size, set()).update(common.hash_runs(common.hash_words(words), size).tolist())
            known = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in found.items()}
            _save(f"{folder}/block-{block}.windows", (windows, {k: (v, _bitmap(v)) for k, v in known.items()}))
            yield pa.record_batch([pa.array([block], pa.int64())], ["block"])

    return write


def _counter(folder: str, blocks: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            hashed = [common.hash_words(common.alnum_words(t)) for t in batch.column(0).to_pylist()]
            for block in blocks:
                for size, (known, bitmap) in _load(f"{folder}/block-{block}.windows")[1].items():
                    sums = total.setdefault((block, size), np.zeros(len(known), np.int64))
                    for h in hashed:
                        place = _probe(common.hash_runs(h, size), known, bitmap)[1]
                        if len(place):
                            np.add.at(sums, place, 1)
        for (block, size), sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.record_batch(
                [pa.array(np.full(len(at), block)), pa.array(np.full(len(at), size)), pa.array(at), pa.array(sums[at])],
                ["block", "size", "place", "n"],
            )

    return count


def _indexer(folder: str):
    """Writes a block's index: for each shingle length, the prefix shingles and the windows behind each."""

    def index(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        windows, known = _load(f"{folder}/block-{block}.windows")
        counts = {k: np.zeros(len(v[0]), np.int64) for k, v in known.items()}
        for size, place, n in zip(*(table.column(c).to_pylist() for c in ("size", "place", "n"))):
            if size:
                counts[size][place] += n
        prefixes: dict[int, list] = {}
        for w, (_, words) in enumerate(windows):
            size = min(SHINGLE, len(words))
            runs = common.hash_runs(common.hash_words(words), size)
            rarity = counts[size][np.searchsorted(known[size][0], runs)]
            offset = int(np.argmin(rarity))  # of equally rare ones the first
            prefixes.setdefault(size, []).append((int(runs[offset]), offset, w))
        out = {}
        for size, rows in prefixes.items():
            hashes = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(hashes, kind="stable")
            unique, first, many = np.unique(hashes[order], return_index=True, return_counts=True)
            offsets, ids = np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order]
            out[size] = (unique, _bitmap(unique), first, many, offsets, ids)
        lengths = np.array([len(w) for _, w in windows], np.int64)
        whole = np.array([common.hash_runs(common.hash_words(w), len(w))[0] for _, w in windows], np.uint64)
        _save(f"{folder}/block-{block}.index", (windows, lengths, whole, out))
        return pa.table({"block": pa.array([block], pa.int64())})

    return index


def _find(words: list[bytes], hashes: np.ndarray, block: tuple, cover: np.ndarray, items: set[str]) -> None:
    windows, lengths, whole, index = block
    runs_of: dict[int, np.ndarray] = {}
    for size, (known, bitmap, first, many, offsets, ids) in index.items():
        if len(words) < size:
            continue
        runs = runs_of.setdefault(size, common.hash_runs(hashes, size))
        at, place = _probe(runs, known, bitmap)
        if not len(at):
            continue
        n = many[place]
        entry = np.repeat(first[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        window = ids[entry]
        start = np.repeat(at, n) - offsets[entry]
        fits = (start >= 0) & (start + lengths[window] <= len(words))
        start, window = start[fits], window[fits]
        for length in np.unique(lengths[window]).tolist():
            runs = runs_of.setdefault(length, common.hash_runs(hashes, length))
            some = lengths[window] == length
            s, w = start[some], window[some]
            same = runs[s] == whole[w]
            for a, k in zip(s[same].tolist(), w[same].tolist()):
                item, text = windows[k]
                if words[a : a + length] == text:
                    cover[a] += 1
                    cover[a + length] -= 1
                    items.add(item)


def _matcher(folder: str, blocks: list[int]):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [common.alnum_words(t) for t in batch.column(1).to_pylist()]
            hashed = [common.hash_words(w) for w in docs]
            covers = [np.zeros(len(w) + 1, np.int64) for w in docs]
            items: list[set[str]] = [set() for _ in docs]
            for block in blocks:
                loaded = _load(f"{folder}/block-{block}.index")
                for words, h, cover, found in zip(docs, hashed, covers, items):
                    _find(words, h, loaded, cover, found)
            n_hit, starts, ends = [], [], []
            for cover in covers:
                edges = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
                a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                n_hit.append(int((b - a).sum()))
                starts.append(a)
                ends.append(b)
            long_list = pa.list_(pa.int64())
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(w) for w in docs], pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array(starts, long_list),
                    pa.array(ends, long_list),
                ],
                ["row", "n_words", "n_hit", "items", "span_starts", "span_ends"],
            )

    return match


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_items: int = 20_000,
    keep_text: bool = False,
) -> DataFrame:
    """docs' columns (the text's only if keep_text) as struct `row`, n_words, n_hit, items (sorted ids whose windows occur) and the hit spans in words."""
    spark = docs.sparkSession
    common.small_batches(spark)
    folder = common.shared_dir(spark, "decontaminate")
    common.make_dir(folder)
    n = max(1, -(-items.count() // block_items))
    rows = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text"))
    dealt = rows.select(F.pmod(F.xxhash64("item", "text"), F.lit(n)).alias("block"), "item", "text")
    dealt = dealt.repartition("block")
    written = dealt.mapInArrow(_write_blocks(folder, window), "block long")
    blocks = sorted(r.block for r in written.collect())
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c != text]).alias("row"), F.col(text).cast("string").alias("text"))
    if blocks:
        counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_counter(folder, blocks), "block long, size long, place long, n long")
        none = spark.createDataFrame([(b, 0, 0, 0) for b in blocks], counts.schema)
        sums = counts.groupBy("block", "size", "place").agg(F.sum("n").alias("n")).unionByName(none)
        sums.groupBy("block").applyInArrow(_indexer(folder), "block long").collect()
    schema = T.StructType([read.schema["row"]])
    for name, kind in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType()))):
        schema.add(name, kind)
    for name in ("span_starts", "span_ends"):
        schema.add(name, T.ArrayType(T.LongType()))
    return read.mapInArrow(_matcher(folder, blocks), schema)


def contaminated():
    """The rule: some words are hit, and they are a twentieth of all or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return find_contamination(docs, items, keep_text=True).where(~contaminated()).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document against every item of `benchmark`; see the module."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM
        (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM
        (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT rid, item_id, i, n FROM dw JOIN bw USING (n, s)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM
        (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
