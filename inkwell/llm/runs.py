"""Operator 13: maximal periodic runs of words, by masking with repeated k-grams and Main-Lorentz on what is left.

A run is a stretch of words with smallest period q and at least max(least, 2 q) words that no neighbour extends. Its
words repeat at distance q over at least half of its length, so each of them lies in a k-gram of k = ceil(least / 2)
words that the text holds twice. Words outside of such k-grams are masked; what is between masks is a segment, masked
again by the k-grams that it repeats itself, until nothing changes or less than `least` words are left.

Main-Lorentz then halves each segment: a run that crosses the middle of a half and lies in it has a full period on one
side of that middle, so it is met by comparing the middle with the places a period before and after it. How far two
places agree to the left and to the right comes from names of blocks of 1, 2, 4, ... words, which makes one halving of
all segments of a batch a few array operations. Reaches are not cut at the half's ends, so the runs come out maximal.

Texts are whole. Nulls, empty and short texts have no runs; null keys and repeated rows stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "key long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def surviving(ids: np.ndarray, owner: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of one owner in which every word lies in a k-gram that its stretch repeats; owner ascends."""
    k = -(-least // 2)
    at, part = np.arange(len(ids)), owner.astype(np.int64)
    while len(at) >= least:
        n = len(at) - k + 1
        whole = np.flatnonzero((part[k - 1 :] == part[:n]) & (at[k - 1 :] - at[:n] == k - 1))
        gram = common.hash_runs(ids[at].astype(np.uint64), k)[whole]
        gram = common.mix(gram ^ common.mix(part[whole].astype(np.uint64)))
        order = np.argsort(gram, kind="stable")
        twice = gram[order[1:]] == gram[order[:-1]]
        hit = np.zeros(len(whole), bool)
        hit[order[1:][twice]] = hit[order[:-1][twice]] = True
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, whole[hit], 1)
        np.add.at(cover, whole[hit] + k, -1)
        live = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        # Neighbours of one part stay in one segment; short segments go.
        kept, of = at[live], part[live]
        segment = np.cumsum(np.concatenate(([0], (np.diff(kept) != 1) | (np.diff(of) != 0)))) if len(kept) else np.empty(0, np.int64)
        long = np.bincount(segment)[segment] >= least if len(kept) else np.empty(0, bool)
        kept, segment = kept[long], segment[long]
        if len(kept) == len(at):
            break
        at, part = kept, segment
    if len(at) < least:
        return []
    cuts = np.flatnonzero(np.diff(part)) + 1
    starts, ends = at[np.concatenate(([0], cuts))], at[np.concatenate((cuts - 1, [len(at) - 1]))] + 1
    return list(zip(starts.tolist(), ends.tolist()))


class _Blocks:
    """Names of all blocks of 2^j words: equal blocks have equal names. Two places agree over less than twice the last 2^j."""

    def __init__(self, ids: np.ndarray):
        self.names = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
        while (step := 1 << len(self.names) - 1) * 2 <= len(ids):
            last = self.names[-1]
            both = last[: len(last) - step] * (int(last.max()) + 1) + last[step:]
            named = np.unique(both, return_inverse=True)[1].astype(np.int64)
            self.names.append(named)
            if int(named.max()) + 1 == len(named):
                break  # all blocks differ, and so do all longer ones

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on agree; i < j."""
        reach = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, step = self.names[level], 1 << level
            live = np.flatnonzero(j + reach < len(name))
            x, y = i[live] + reach[live], j[live] + reach[live]
            same = live[name[x] == name[y]]
            reach[same] += step
        return reach

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j agree; i < j."""
        reach = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, step = self.names[level], 1 << level
            live = np.flatnonzero((i - reach >= step) & (j - reach - step < len(name)))
            x, y = i[live] - reach[live] - step, j[live] - reach[live] - step
            same = live[name[x] == name[y]]
            reach[same] += step
        return reach


def main_lorentz(ids: np.ndarray, bounds: list[tuple[int, int]], least: int) -> np.ndarray:
    """Rows (start, length, smallest period) of all runs within the segments [a, b), in order."""
    # Segments end to end, each behind a word of its own, so that no reach leaves its segment.
    size = np.array([b - a for a, b in bounds], np.int64)
    begin = np.cumsum(size + 1) - size
    text = np.full(int((size + 1).sum()), -1, np.int64)
    text[begin - 1] = int(ids.max()) + 1 + np.arange(len(bounds))
    for (a, b), at in zip(bounds, begin.tolist()):
        text[at : at + b - a] = ids[a:b]
    blocks, found = _Blocks(text), []
    lo, hi = begin, begin + size
    while len(lo):
        # A run in [lo, hi) that crosses the middle: one of its sides holds a period.
        mid = (lo + hi) // 2
        after, before = np.minimum(hi - mid, (hi - lo) // 2), np.minimum(mid - lo, (hi - lo) // 2)
        per = np.concatenate((after, before))
        period = np.arange(1, int(per.sum()) + 1) - np.repeat(np.cumsum(per) - per, per)
        m = np.repeat(np.concatenate((mid, mid)), per)
        i = np.where(np.repeat(np.arange(len(per)) < len(mid), per), m, m - period)
        right = blocks.forward(i, i + period)
        left = blocks.backward(i, i + period)
        good = (left + right >= period) & (left + right + period >= least)
        found.append(np.stack([i[good] - left[good], left[good] + right[good] + period[good], period[good]], 1))
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
        long = hi - lo >= least  # else no run fits
        lo, hi = lo[long], hi[long]
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    rows = rows[first]
    shift = np.array([a for a, _ in bounds], np.int64) - begin
    rows[:, 0] += shift[np.searchsorted(begin, rows[:, 0], "right") - 1]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def find_runs(texts: list[list[bytes]], least: int = 12) -> list[np.ndarray]:
    """Rows (start, length, smallest period) of each text's runs, by start, then period."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    names = _Names()
    ids = np.fromiter((names[w] for t in texts for w in t), np.int64, int(size.sum()))
    ends = np.cumsum(size)
    bounds = surviving(ids, np.repeat(np.arange(len(texts)), size), least)
    if not bounds:
        return [np.empty((0, 3), np.int64)] * len(texts)
    rows = main_lorentz(ids, bounds, least)
    of = np.searchsorted(ends, rows[:, 0], "right")
    rows[:, 0] -= (ends - size)[of]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts, cuts[1:])]


class _Names(dict):
    """Numbers words in the order in which they are met."""

    def __init__(self):
        self.next = count().__next__

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.next()
        return n


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words of which no run holds a copy: after a run's first period its words go."""
    if not len(runs):
        return b" ".join(words)
    keep = np.zeros(len(words) + 1, np.int64)
    np.add.at(keep, runs[:, 0] + runs[:, 2], 1)
    np.add.at(keep, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """A row for each row: key, n_words, its runs by start and period, and the text with each run cut to one period."""
    if least < 2:
        raise ValueError("a run has two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("runs")
        for batch in common.slices(batches, "text", 4 << 20):
            words = [common.to_bytes(t).split() for t in batch.column("text").to_pylist()]
            found = find_runs(words, least)
            cuts = np.concatenate(([0], np.cumsum([len(r) for r in found])))
            rows = np.concatenate(found)
            runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in range(3)], fields=list(_RUN))
            collapsed = pa.array([collapse(w, r) for w, r in zip(words, found)], pa.binary()).cast(pa.string())
            n = pa.array([len(w) for w in words], pa.int64())
            yield pa.record_batch([batch.column("key"), n, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs), collapsed], ["key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def planted(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text: a tenth of the texts repeats a few of its words from some place on, by the crc32 of its id.

    h = crc32(id), g = h / 10. Where h % 10 = 0 and there are n > 0 words, each word i >= a becomes word
    a + (i - a) % p of the text, with a = g % n and p = 1 + (n - a) / (3 + g % 8). The others stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), h.alias("h"))
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(common.SPACE_WORD), F.lit(0))))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    d = d.withColumn("a", F.when(n > 0, F.pmod(g, n)))
    d = d.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.pmod(g, F.lit(8)))))
    i = F.sequence(F.lit(0), n - 1)
    new = F.transform(i, lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
    return d.select("key", F.when(F.col("a").isNotNull(), F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: documents, a tenth of them made periodic, with the digests of their runs; see the module."""
    found = periodic_runs(planted(common.table(spark, sf_dir, "documents")), key="key")
    top = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("top", top)
    length = -F.col("top.l")
    return found.select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        length.alias("length"),
        "top.period",
        F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
