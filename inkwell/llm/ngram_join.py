"""N-gram Jaccard self-join by PartEnum signatures, and the components of its links.

A document's set are the hashes of its distinct runs of `n` words; two documents link when the Jaccard similarity of
their sets is at least num/den. Sets are put in size bands; in a band whose largest size is r, similar sets differ in
at most k = floor(2 r (1 - t) / (1 + t)) elements. The feature domain is cut into n1 parts of n2 cells; of the parts,
k / (k2 + 1) at most hold more than k2 differences, and in the others the sets agree on n2 - k2 cells. Each set signs
every subset of n2 - k2 cells of every part, for its own band and the next one, where partners up to 1/t times its size
lie. n1 leaves enough parts over that linked, unequal sets share SHARED signatures at least.

Elements that very many texts hold (`frequent`: a fixed set, of any size) make signatures of unrelated texts meet. Sets
sign without them, as differences only shrink by that; where most of a set is frequent, it signs whole. Near the limit
it does both, over a range wide enough that linked sets always have one of the two in common.

1. Equal sets form a class, the node of all that follows; its smallest id stands for it. A class is named by a 64-bit
   hash; a second one shows whether two sets have met in a name, and then all names are drawn anew with another seed.
2. Tasks send their signatures packed, by ranges of hashes, each class once. A signature that more than BUCKET classes
   of a task share is settled there: only two of its classes, the centers, travel. Where signatures meet, members of a
   small bucket are paired, and pairs that share fewer than SHARED signatures go (members of a large bucket aside, as
   below). The rest is held against sketches, which give a lower bound of the difference.
3. Members of a large bucket meet its centers first, in two rounds. Links found merge components, and pairs that are in
   one component already need no comparison. What is left, members of large buckets that are in different
   components and were never compared, is joined on the rarest elements of the members' differences from one text of
   the group (see _left_links). Where they meet, pairs are counted and links found, and of those only a spanning forest
   is written, so no link is lost between components and a large group of near copies isn't paired with itself. BUCKET
   changes the way, not the result: both ways are exact.

Rows: without words (null or empty text) a set is empty, links with nothing and is its own component. A text of fewer
words than n is one run. A null id has a null component and links with nothing. Rows of one id are one node, linked
where any of them is. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import common
from inkwell.llm.components import connected_components
from inkwell.llm.decontaminate import _load, _save

#: Buckets of up to so many members are paired directly.
BUCKET = 32
#: Signatures that linked sets share at least.
SHARED = 3
#: An element counts as frequent from so many texts on, as long as there are no more than MOST of them; the count is
#: summed from tasks' shares of at least LOCAL texts. Other values change the cost, not the result.
FREQUENT, MOST, LOCAL = 1000, 1 << 18, 4
#: Signatures that a task holds before it sends them, and that meet in one place, about.
HELD, MET = 1 << 20, 1 << 20


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of the whole text if it has fewer."""
    common.claim("shingles")
    words = common.space_words(text)
    return np.unique(common.hash_runs(common.hash_words(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def class_id(found: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two hashes of a set, as signed 64-bit integers: a name, and one to check it by."""
    out = []
    for k in (2 * seed + 1, 2 * seed + 2):
        total = common.mix(found + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)).sum(dtype=np.uint64) + np.uint64(len(found))
        out.append(int(common.mix(np.array([total], np.uint64)).view(np.int64)[0]))
    return out[0], out[1]


class PartEnum:
    """Signatures of sets for Jaccard similarity num/den; k2 and n2 as above."""

    def __init__(self, num: int, den: int, k2: int = 1, n2: int = 3):
        self.num, self.den, self.k2, self.n2 = num, den, k2, n2
        self.tops = [1]  # largest size of each band
        self.subsets = list(itertools.combinations(range(n2), n2 - k2))

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            least = self.tops[-1] + 1
            self.tops.append(max(least, least * self.den // self.num))
        return int(np.searchsorted(self.tops, size))

    def parts(self, band: int) -> tuple[int, int]:
        """Parts of the domain in a band (none where linked sets are equal), and how many linked sets agree on at least."""
        k = 2 * self.tops[band] * (self.den - self.num) // (self.den + self.num)
        if k == 0:
            return 0, 0
        most_bad = k // (self.k2 + 1)
        mean = self.tops[band] * self.num / self.den / (most_bad + 1) * (self.n2 - self.k2) / self.n2
        sure = SHARED + math.ceil(2 * len(self.subsets) * math.exp(-mean) * (most_bad + 1))
        return most_bad + sure, sure

    def _signs(self, mixed: np.ndarray, band: int, whole: bool, most_k: int) -> np.ndarray:
        salt = np.uint64((2 * band + 1 + whole) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        n1, sure = self.parts(band)
        sure = max(sure, n1 - most_k // (self.k2 + 1))  # a set may be smaller than the band's bound allows for
        if n1 == 0:
            return common.mix(mixed.sum(dtype=np.uint64, keepdims=True) + salt)
        cells = np.zeros(n1 * self.n2, np.uint64)
        at = ((mixed >> np.uint64(20)) % np.uint64(len(cells))).astype(np.int64)
        np.add.at(cells, at, mixed)
        cells, many = cells.reshape(n1, self.n2), np.bincount(at, minlength=len(cells)).reshape(n1, self.n2)
        sums = np.stack([cells[:, list(s)].sum(axis=1, dtype=np.uint64) for s in self.subsets], axis=1)
        empty = np.stack([many[:, list(s)].sum(axis=1) == 0 for s in self.subsets], axis=1)
        out = common.mix(common.mix(sums.ravel()) + salt + np.arange(sums.size, dtype=np.uint64))
        # Linked sets agree on `sure` parts; SHARED of those have no empty subset, where few parts have one at all.
        return out[~empty.ravel()] if empty.any(axis=1).sum() <= sure - SHARED else out

    def signatures(self, found: np.ndarray, frequent: np.ndarray = np.empty(0, np.uint64)) -> np.ndarray:
        """frequent: sorted elements that are left out, unless they are most of the set."""
        if not len(found):
            return np.empty(0, np.uint64)
        size = len(found)
        band = self.band(size)
        self.band(self.tops[band] + 1)
        rare = found
        if len(frequent):
            rare = found[frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] != found]
        # Rare elements of linked sets differ by most_k at most, and half their sizes by half of that.
        most_k = size * (self.den - self.num) // self.num
        ways = [rare] if 2 * len(rare) >= size else [None]
        ways += [found] if 2 * len(rare) <= size + 3 * (most_k + 1) else []
        out = []
        for whole, some in enumerate(ways):
            if some is not None:
                mixed = common.mix(some ^ np.uint64(0xD6E8FEB86659FD93))
                out += [self._signs(mixed, b, bool(whole), most_k) for b in (band, band + 1)]
        return np.concatenate(out)


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements in 2^b >= 2n cells, as bits: sets that differ in k elements differ in k bits at most."""
    cells = 64 << max(0, (2 * len(found) - 1).bit_length() - 6)
    odd = np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketch_distance(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; the longer one is folded, once, as the sizes of partners allow."""

    def fold(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    apart = F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(apart, F.lit(0), lambda t, x: t + x)


def _classes(n: int, seed: int):
    """A row for each text; and rows (element, texts) of what many texts of the task hold."""
    names = ["id", "n_shingles", "class", "proof", "sketch", "element", "texts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def batch_of(many: int, *columns) -> pa.RecordBatch:
        return pa.record_batch([pa.nulls(many, t) if c is None else pa.array(c, t) for c, t in zip(columns, types)], names)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def count() -> Iterator[pa.RecordBatch]:
            element, texts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            element, texts = element[texts >= LOCAL].view(np.int64), texts[texts >= LOCAL]
            for at in range(0, len(element), 100_000):
                some = slice(at, at + 100_000)
                yield batch_of(len(element[some]), None, None, None, None, None, element[some], texts[some])

        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
            keys = [class_id(s, seed) if len(s) else (None, None) for s in sets]
            yield batch_of(len(sets), batch.column(0), [len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys], [sketch(s) for s in sets], None, None)
            held += sets
            if sum(map(len, held)) >= 2 * HELD:
                yield from count()
        if held:
            yield from count()
        common.trim()

    return classes


#: Packed signatures of a part of the hashes (falling members: hash, place in `classes`, whether the bucket is large), or
#: pairs of a center and a member.
_PACKED = "part int, sign binary, place binary, large binary, classes binary, sizes binary, stars binary"
#: kind 0 and 1: a center and a member of a large bucket, 3 and 4: those of one task's share of it; 2: members of small
#: buckets, with the signatures they share.
_PAIRS = "kind int, a long, b long, n long"


def _stars(cls: np.ndarray, lengths: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of distinct classes: which are centers, and rows (kind or the next one, center, member)."""
    starts, rows, chosen = np.cumsum(lengths) - lengths, [], np.zeros(len(cls), bool)
    for k, order in enumerate((cls.view(np.uint64), common.mix(cls.view(np.uint64)))):
        first = order == np.repeat(np.minimum.reduceat(order, starts), lengths)
        center = np.repeat(cls[first], lengths)
        rows.append(np.stack([np.full(len(cls), kind + k), center, cls])[:, center != cls])
        chosen |= first
    return chosen, np.concatenate(rows, axis=1)


def _counted(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of the columns, and how many there are of each."""
    names = [f"c{k}" for k in range(len(columns))]
    out = pa.table([pa.array(c) for c in columns], names).group_by(names, use_threads=False).aggregate([([], "count_all")])
    return [out.column(k).to_numpy() for k in [*names, "count_all"]]


def _distinct(stars: list[np.ndarray]) -> np.ndarray:
    return np.stack(_counted(*np.concatenate(stars, axis=1))[:3], axis=1)


def _signer(n: int, num: int, den: int, seed: int, parts: int, bucket: int, frequent: np.ndarray):
    def pack(names: list[int], sizes: list[int], signs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names, sizes = np.array(names, np.int64), np.array(sizes, np.uint32)
        place = np.repeat(np.arange(len(signs), dtype=np.uint32), [len(s) for s in signs])
        key = np.concatenate(signs)
        key = (key >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | key & np.uint64(0xFFFFFFFF)
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        new = np.append(True, key[1:] != key[:-1])
        again = np.append(False, ~new[1:] & (place[1:] == place[:-1]))  # two signatures of one set meet: not told apart
        lengths = np.diff(np.append(np.flatnonzero(new), len(key)))
        odd = np.logical_or.reduceat(again, np.flatnonzero(new))
        large = np.repeat(odd | (lengths > bucket), lengths)
        keep, stars = ~again, []
        many = np.repeat(lengths > bucket, lengths) & keep
        if many.any():
            runs = np.cumsum(new)[many]
            chosen, found = _stars(names[place[many]], np.diff(np.append(np.flatnonzero(np.append(True, runs[1:] != runs[:-1])), len(runs))), 3)
            stars.append(found)
            keep[np.flatnonzero(many)[~chosen]] = False
        key, place, large = key[keep], place[keep], large[keep]
        part = (key >> np.uint64(32)).astype(np.int64)
        ends = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        rows = []
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own, at = np.unique(place[i:j], return_inverse=True)
            sign = np.diff((key[i:j] & np.uint64(0xFFFFFFFF)).astype(np.int64), prepend=0)
            marks = large[i:j].tobytes() if large[i:j].any() else b""
            rows.append((int(part[i]), common.planes(sign), common.planes(at), marks, names[own].tobytes(), sizes[own].tobytes(), None))
        if stars:
            found = _distinct(stars)
            for i in range(0, len(found), 100_000):
                rows.append((i // 100_000 % parts, None, None, None, None, None, found[i : i + 100_000].tobytes()))
        for i in range(0, len(rows), 256):
            columns = zip(*rows[i : i + 256])
            yield pa.record_batch([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(columns)], [x.split(" ")[0] for x in _PACKED.split(", ")])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, names, sizes, signs, seen, held = PartEnum(num, den), [], [], [], set(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = shingles(text, n)
                name = class_id(found, seed)[0]
                if len(found) and name not in seen and len(s := scheme.signatures(found, frequent)):
                    seen.add(name)
                    names.append(name)
                    sizes.append(len(found))
                    signs.append(s)
                    held += len(s)
                if held >= HELD:
                    yield from pack(names, sizes, signs)
                    names, sizes, signs, seen, held = [], [], [], set(), 0
        if names:
            yield from pack(names, sizes, signs)
        common.trim()

    return sign


def _meeting(num: int, den: int, bucket: int):
    """Buckets of one part after the other; rows come sorted by part."""

    def out(a, b, n, kind) -> pa.RecordBatch:
        columns = [np.full(len(a), kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32), a, b, n]
        return pa.record_batch([pa.array(np.asarray(c)) for c in columns], ["kind", "a", "b", "n"])

    def pairs(cls: np.ndarray, size: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def close() -> pa.RecordBatch:
            return out(*_counted(*np.concatenate(kept, axis=1)), 2)

        for m in np.unique(lengths).tolist():
            one, two = np.triu_indices(m, 1)
            own = starts[lengths == m]
            step = max(1, (1 << 20) // len(one))
            for i in range(0, len(own), step):
                a, b = ((own[i : i + step, None] + x).ravel() for x in (one, two))
                near = num * np.maximum(size[a], size[b]) <= den * np.minimum(size[a], size[b])
                kept.append(np.stack([cls[a[near]], cls[b[near]]]))
                held += int(near.sum())
                if held > 1 << 20:
                    yield close()
                    kept, held = [], 0
        if held:
            yield close()

    def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sign, cls, size, large = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((cls, sign))
        sign, cls, size, large = sign[order], cls[order], size[order], large[order]
        starts = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
        large = np.repeat(np.logical_or.reduceat(large, starts), np.diff(np.append(starts, len(sign))))
        keep = np.append(True, (sign[1:] != sign[:-1]) | (cls[1:] != cls[:-1]))
        sign, cls, size, large = sign[keep], cls[keep], size[keep], large[keep]
        starts = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
        lengths = np.diff(np.append(starts, len(sign)))
        big = large[starts] | (lengths > bucket)
        small = ~big & (lengths > 1)
        yield from pairs(cls, size.astype(np.int64), starts[small], lengths[small])
        big &= lengths > 1
        if big.any():
            found = _distinct([_stars(cls[np.repeat(big, lengths)], lengths[big], 0)[1]])
            yield out(found[:, 1], found[:, 2], np.ones(len(found), np.int64), found[:, 0])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_part = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["stars"] is not None:
                    found = np.frombuffer(row["stars"], np.int64).reshape(-1, 3)
                    yield out(found[:, 1], found[:, 2], np.ones(len(found), np.int64), found[:, 0])
                    continue
                if held and row["part"] != open_part:
                    yield from close(held)
                    held = []
                open_part = row["part"]
                place = common.unplanes(row["place"])
                sign = np.cumsum(common.unplanes(row["sign"]), dtype=np.uint64).astype(np.uint32)
                large = np.frombuffer(row["large"], bool) if row["large"] else np.zeros(len(sign), bool)
                held.append((sign, np.frombuffer(row["classes"], np.int64)[place], np.frombuffer(row["sizes"], np.uint32)[place], large))
        if held:
            yield from close(held)
        held = []
        common.trim()

    return meet


def _sets(n: int, seed: int):
    """A task gives the set of each class once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            found = [shingles(t, n) for t in batch.column(0).to_pylist()]
            found = [(class_id(s, seed)[0], s.view(np.int64)) for s in found if len(s)]
            found = [x for x in dict(found).items() if x[0] not in seen]
            seen.update(x[0] for x in found)
            yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["id", "set"])

    return sets


_BLOCK = ("center", "id", "label", "apart", "n", "size", "short", "far")


def _bits(lost: np.ndarray, n_lost: np.ndarray, core: np.ndarray, n_core: np.ndarray) -> list[np.ndarray]:
    """Which elements of its center each member lacks, as bits in the center's order."""
    out = []
    for x, c in zip(np.split(lost, np.cumsum(n_lost)[:-1]), np.split(core, np.cumsum(n_core)[:-1])):
        gone = np.zeros(len(c), np.uint8)
        gone[np.searchsorted(c, x)] = 1
        out.append(np.packbits(gone))
    return out


def _asking(folder: str, parts: int):
    """Saves members in blocks; each block asks the parts, by hash, how many members hold an element of its differences."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, kept, held = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            block, table = task << 24 | seq, pa.Table.from_batches(kept)
            members = {k: table.column(k).to_numpy() for k in _BLOCK}
            own, lost, core = (table.column(k).combine_chunks() for k in ("own", "lost", "core"))
            members["own"], n_lost, n_core = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (own, lost, core))
            own, lost, core = (x.flatten().to_numpy().view(np.uint64) for x in (own, lost, core))
            member = np.concatenate([np.repeat(np.arange(len(n_lost)), x) for x in (members["own"], n_lost)])
            diff = np.concatenate([own, lost])[np.argsort(member, kind="stable")]  # of each member its own, then what it lacks
            keys = common.mix(diff ^ common.mix(np.repeat(members["center"], members["n"]).view(np.uint64)))
            keys, place, texts = np.unique(keys, return_inverse=True, return_counts=True)
            part = (keys % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            _save(f"{folder}/block-{block}", (members, diff, keys[order], back[place], _bits(lost, n_lost, core, n_core)))
            some, at = np.unique(part[order], return_index=True)
            columns = [[x.tobytes() for x in np.split(y[order], at[1:])] for y in (keys, texts)]
            return pa.record_batch([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], ["part", "block", "keys", "texts"])

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                held += int(batch.column("n").to_numpy().sum())
            if held >= HELD:
                yield close()
                seq, kept, held = seq + 1, [], 0
        if kept:
            yield close()

    return ask


def _telling(table: pa.Table) -> pa.Table:
    """Sums the blocks' counts of a part's elements, and answers each block in its own order."""
    table = table.sort_by("block")
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    texts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("texts").to_pylist()])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(place, weights=texts).astype(np.int64)[place]
    replies = [x.tobytes() for x in np.split(sums, np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table([table.column("block"), table.column("part"), pa.array(replies, pa.binary())], ["block", "part", "texts"])


def _prefixes(folder: str, parts: int, salt: int):
    """Elements of the members' prefixes, packed by part: (part, pickled keys, members, places, and the members, with
    the 32-bit names of their own elements that others hold too, and bits of those of the center that they lack)."""

    def prefixes(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        members, diff, keys, key, bits = _load(f"{folder}/block-{table.column('block')[0].as_py()}", most=1)
        df = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("texts").to_pylist()])[key]
        n = members["n"].astype(np.int64)
        member, first = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
        own = np.flatnonzero((df > 1) & (np.arange(len(df)) - first < members["own"][member]))
        names = common.mix(keys[key[own]] + np.uint64(salt)).astype(np.uint32)
        names = np.split(names, np.cumsum(np.bincount(member[own], minlength=len(n)))[:-1])
        order = np.lexsort((diff, df, member))
        place = np.arange(len(order)) - first + 1
        # An element of one member finds nobody.
        keep = (df[order] > 1) & (place <= np.repeat(np.maximum(members["short"], np.where(members["apart"], members["far"], 0)), n))
        order, place = order[keep], place[keep]
        key, member = keys[key[order]], member[order]
        part = (key % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        some, at = np.unique(part[order], return_index=True)
        rows = []
        for x in np.split(order, at[1:]) if len(order) else []:
            who, back = np.unique(member[x], return_inverse=True)
            table = {k: members[k][who] for k in _BLOCK}
            rows.append(pickle.dumps((key[x], back, place[x], table, [names[i] for i in who], [bits[i] for i in who]), protocol=5))
        return pa.table([pa.array(some, pa.int32()), pa.array(rows, pa.binary())], ["part", "edits"])

    return prefixes


class _Forest:
    """Labels of a part's members; `links` are the links that joined two of them."""

    def __init__(self, m: dict, names: list[np.ndarray], bits: list[np.ndarray], num: int, den: int):
        self.m, self.bits, self.num, self.den = m, bits, num, den
        _, label = np.unique(m["label"], return_inverse=True)
        _, center = np.unique(m["center"], return_inverse=True)
        self.label, near = label, ~m["apart"]
        self.up = list(range(int(label.max()) + int(center.max()) + 2))
        # Members that are linked with the center are in its component.
        for x, c in zip(label[near].tolist(), (center[near] + int(label.max()) + 1).tolist()):
            self.up[self.find(x)] = self.find(c)
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        found, self.names = np.unique(np.concatenate(names), return_inverse=True)
        self.ends, self.held = np.cumsum(lengths), np.zeros(len(found), bool)
        self.starts = self.ends - lengths

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def roots(self) -> np.ndarray:
        return np.fromiter(map(self.find, range(len(self.up))), np.int64, len(self.up))[self.label]

    def differ(self, x: int, others: np.ndarray) -> np.ndarray:
        """Elements in which x and others of its center differ: |D(x)| + |D(y)| - 2 |D(x) & D(y)|; names may meet, which makes it less."""
        mine = self.names[self.starts[x] : self.ends[x]]
        self.held[mine] = True
        starts, ends = self.starts[others], self.ends[others]
        sums = np.cumsum(ends - starts)
        hits = np.append(0, np.cumsum(self.held[self.names[np.arange(sums[-1]) + np.repeat(ends - sums, ends - starts)]]))
        self.held[mine] = False
        both = hits[sums] - hits[sums - (ends - starts)]
        both += np.bitwise_count(np.stack([self.bits[y] for y in others.tolist()]) & self.bits[x]).sum(axis=1, dtype=np.int64)
        n = self.m["n"].astype(np.int64)
        return n[x] + n[others] - 2 * both

    def grow(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Links of pairs (a, b), in the order of ids, that join two components."""
        ids, size, links = self.m["id"], self.m["size"].astype(np.int64), []
        a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
        order = np.lexsort((ids[b], ids[a]))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        for x, others in zip(a[starts].tolist(), np.split(b, starts[1:])):
            root, up = self.find(int(self.label[x])), self.label[others].tolist()
            others = others[np.fromiter((self.find(y) != root for y in up), bool, len(up))]
            if not len(others):
                continue
            near = self.differ(x, others) * (self.den + self.num) <= (self.den - self.num) * (size[x] + size[others])
            for y in others[near].tolist():
                one, two = self.find(int(self.label[x])), self.find(int(self.label[y]))
                if one != two:
                    self.up[two] = one
                    links.append((int(ids[x]), int(ids[y])))
        return links


def _meeting_edits(num: int, den: int):
    """Members that share an element of their prefixes, part after part: links that join different components."""

    def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        lengths = [len(x[4]) for x in held]
        shift = np.cumsum(lengths) - lengths
        key, place = (np.concatenate([x[k] for x in held]) for k in (0, 2))
        who = np.concatenate([x[1] + s for x, s in zip(held, shift)])
        m = {k: np.concatenate([x[3][k] for x in held]) for k in held[0][3]}
        forest = _Forest(m, *([y for x in held for y in x[k]] for k in (4, 5)), num, den)
        order = np.argsort(key, kind="stable")
        key, place, who = key[order], place[order], who[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        partners = np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1
        ends = np.cumsum(partners)
        at, found, label = 0, [], forest.roots()
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 19))))
            i = np.repeat(np.arange(at, to), partners[at:to])
            j = i + 1 + np.arange(len(i)) - np.repeat(ends[at:to] - partners[at:to] - (ends[at] - partners[at]), partners[at:to])
            some = label[who[i]] != label[who[j]]
            i, j = i[some], j[some]
            a, b = who[i], who[j]
            # Near members are linked with the center, and so in one component already.
            keep = (m["center"][a] == m["center"][b]) & (m["apart"][a] | m["apart"][b])
            for x, y, p in ((a, b, place[i]), (b, a, place[j])):
                keep &= p <= np.where(m["apart"][x] & ~m["apart"][y], np.maximum(m["short"][x], m["far"][x]), m["short"][x])
            size, other = m["size"][a].astype(np.int64), m["size"][b].astype(np.int64)
            k = (den - num) * (size + other) // (den + num)
            # The first element that two members share leaves room for no more than what follows it in both.
            room = np.minimum(m["n"][a] - place[i], m["n"][b] - place[j]) + 1
            keep &= (2 * room >= m["n"][a] + m["n"][b] - k) & (num * np.maximum(size, other) <= den * np.minimum(size, other))
            if keep.any():
                found.append(np.stack(_counted(np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep]))[:2]))
            at = to
            if sum(x.shape[1] for x in found) >= 1 << 17 or at == len(key) and found:
                links = forest.grow(*_counted(*np.concatenate(found, axis=1))[:2])
                found, label = [], forest.roots()
                if links:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_part = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["part"] != open_part:
                    yield from close(held)
                    held = []
                open_part = row["part"]
                held.append(pickle.loads(row["edits"]))
        if held:
            yield from close(held)
        held = []
        common.trim()

    return meet


def _left_links(left: DataFrame, sets: DataFrame, num: int, den: int, folder: str, salt: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket in different components: links that join all components that have one.

    A pair that is none is among them where names of elements meet (32 bits): then others may be missing, and it takes
    another salt to find them.

    left: center, id, label: members of buckets and a text of each bucket. Let D(x) be the symmetric difference of a
    member and its center. Members x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| elements, and linked ones in
    k(x, y) = (1 - t) / (1 + t) (|x| + |y|) at most; one of them, say x, is not linked with the center, so
    |D(x)| > k(x, center), or the center joins them (its links are among the pairs). So their differences share (|D(x)| + |D(y)| - k(x, y)) / 2 > 0 elements or more: of each
    D a prefix in the order of rarity is enough to find the pair, and edits that few members share come first. A group
    of near copies of one text, which have all signatures in common, gives pairs only where edits agree. Elements travel
    packed: to be counted, back to their block, and those of prefixes, with D, to where they meet. There |D(x) & D(y)| is
    counted for pairs whose components differ, and a link is kept where it joins two; a part gives less than its members.
    """
    one = left.join(sets.select("id", F.col("set").alias("x")), "id")
    two = one.join(sets.select(F.col("id").alias("center"), F.col("set").alias("c")), "center")
    own, lost = F.array_except("x", "c").alias("own"), F.array_except("c", "x").alias("lost")
    d = two.select("center", "id", "label", F.size("x").alias("size"), F.size("c").alias("size_c"), own, lost, F.col("c").alias("core"))
    d = d.withColumn("n", F.size("own") + F.size("lost"))
    least = F.ceil(F.col("size") * num / den)  # sizes of partners lie in [least, size * den / num]
    most_k = F.floor(F.col("size") * (den - num) / num)
    least_k = F.floor((den - num) * (least + F.col("size_c")) / (den + num))
    apart = F.col("n") * (den + num) > (den - num) * (F.col("size") + F.col("size_c"))  # not linked with the center
    # Shared elements at least: with a partner that is apart, and, for one that is, with one that isn't.
    with_apart = F.greatest(F.lit(1), F.ceil((F.col("n") + least_k + 1 - most_k) / 2))
    with_near = F.greatest(F.lit(1), F.ceil((F.col("n") + F.greatest(F.col("n") - most_k, F.lit(1)) - most_k) / 2))
    d = d.select("center", "id", "label", apart.alias("apart"), "n", "size", (F.col("n") - with_apart + 1).alias("short"), (F.col("n") - with_near + 1).alias("far"), "own", "lost", "core")
    d = common.materialized(d, f"{folder}/left-elements")
    near = d.where("NOT apart AND id <> center").select(F.least("id", "center").alias("a"), F.greatest("id", "center").alias("b"))
    total = d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total / MET))
    blocks = f"{folder}/left-blocks"
    common.make_dir(blocks)
    asked = d.mapInArrow(_asking(blocks, parts), "part int, block long, keys binary, texts binary")
    told = asked.groupBy("part").applyInArrow(_telling, "block long, part int, texts binary")
    edits = told.groupBy("block").applyInArrow(_prefixes(blocks, parts, salt), "part int, edits binary")
    edits = common.materialized(edits, f"{folder}/left-df")
    found = edits.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meeting_edits(num, den), "a long, b long")
    return common.materialized(found.union(near).distinct(), f"{folder}/left-links")


def _frequent(found: DataFrame, folder: str) -> np.ndarray:
    """The most frequent elements, sorted: MOST at most, by the lowest limit of 2^k texts that keeps to it."""
    many = found.where("element IS NOT NULL").groupBy("element").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= FREQUENT)
    many = common.materialized(many, f"{folder}/frequent")
    sizes = many.groupBy(F.floor(F.log2("texts")).alias("k")).count().orderBy(F.desc("k")).collect()
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > MOST:
            break
        least = 1 << row["k"]
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(np.array([r.element for r in many.where(F.col("texts") >= least).select("element").collect()], np.int64).view(np.uint64))


def _named(rows: DataFrame, n: int, folder: str) -> tuple[DataFrame, DataFrame, np.ndarray, int]:
    """Rows with the names of their sets, the classes (id: their name, rep: their smallest id), frequent elements, and
    the names' seed."""
    seed = 0
    while True:
        schema = "id long, n_shingles long, class long, proof long, sketch array<long>, element long, texts long"
        found = common.materialized(rows.mapInArrow(_classes(n, seed), schema), f"{folder}/named-{seed}")
        named = found.where("element IS NULL")
        some = named.where("id IS NOT NULL AND class IS NOT NULL").groupBy(F.col("class").alias("id"))
        classes = some.agg(
            F.min("id").alias("rep"), F.count("*").alias("rows"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"),
            (F.min("proof") < F.max("proof")).alias("met"),
        )
        classes = common.materialized(classes, f"{folder}/classes-{seed}")
        if not classes.where("met").limit(1).count():
            return named, classes, _frequent(found, folder), seed
        seed += 1


def link_documents(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Membership (id, n_shingles, representative, component), and the links found, between representatives.

    The links span each component; copies and pairs whose component is known already are not expanded.
    """
    spark = docs.sparkSession
    common.small_batches(spark, 256)
    folder = common.shared_dir(spark, "ngram-join")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    named, classes, frequent, seed = _named(rows, n, folder)
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / MET))
    packed = rows.where("id IS NOT NULL").select("text").mapInArrow(_signer(n, num, den, seed, parts, BUCKET, frequent), _PACKED)
    met = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meeting(num, den, BUCKET), _PAIRS)
    met = common.materialized(met, f"{folder}/met")
    far = classes.select("id", "size", "sketch")

    def likely(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that may be linked by their sizes and sketches."""
        one = pairs.join(far.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("s_a")), "a")
        two = one.join(far.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("s_b")), "b")
        two = two.where(num * F.greatest("size_a", "size_b") <= den * F.least("size_a", "size_b"))
        two = two.where(_sketch_distance(F.col("s_a"), F.col("s_b")) * (den + num) <= (den - num) * (F.col("size_a") + F.col("size_b")))
        return two.select("kind", "a", "b")

    small = met.where("kind = 2").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARED)
    stars = met.where("kind <> 2").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    stars = common.materialized(stars, f"{folder}/stars")
    # Of each kind of center a member meets the one with which it shares most buckets.
    star = F.when(F.col("kind").isin(0, 3), 0).otherwise(1)
    nearest = stars.groupBy(star.alias("kind"), "b").agg(F.max(F.struct("n", "a"))["a"].alias("a"))
    pairs = small.select(F.lit(2).alias("kind"), "a", "b").unionByName(nearest)
    pairs = common.materialized(likely(pairs), f"{folder}/pairs")
    common.remove(f"{folder}/met")
    sets = None

    def with_sets(nodes: DataFrame, name: str) -> DataFrame:
        """The sets known so far and those of the nodes; texts aren't shuffled while their ids can be broadcast."""
        nodes = nodes.distinct() if sets is None else nodes.distinct().join(sets.select("id"), "id", "left_anti")
        ids = common.materialized(nodes.join(classes.select("id", "rep"), "id").select("rep").distinct(), f"{folder}/wanted-{name}")
        some = rows.join(common.small(ids), F.col("id") == F.col("rep"), "left_semi").select("text")
        found = common.materialized(some.mapInArrow(_sets(n, seed), "id long, set array<long>"), f"{folder}/sets-{name}")
        return found if sets is None else sets.unionByName(found)

    sets = with_sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), "pairs")

    def compare(pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b) with their intersection and union."""
        one = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        two = one.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        found = two.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).cast("long").alias("sum"))
        return common.materialized(found.withColumn("linked", den * F.col("both") >= num * (F.col("sum") - F.col("both"))), f"{folder}/{name}")

    # Rows of one id with different texts are one node.
    twice = named.where("id IS NOT NULL AND class IS NOT NULL").groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    twice = common.materialized(twice, f"{folder}/twice")
    joint = named.join(twice.select("id", "a"), "id").where("class > a").select("a", F.col("class").alias("b"))
    joint = common.materialized(joint.distinct(), f"{folder}/joint")
    compared, labels = None, None

    def labelled(rows: DataFrame, column: str) -> DataFrame:
        if labels is None:
            return rows.withColumn(f"label_{column}", F.col(column))
        found = labels.select(F.col("node").alias(column), F.col("label").alias(f"label_{column}"))
        return rows.join(found, column, "left").withColumn(f"label_{column}", F.coalesce(f"label_{column}", column))

    def untested(pairs: DataFrame) -> DataFrame:
        return pairs if compared is None else pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")

    def open_pairs(kind: int) -> DataFrame:
        some = labelled(labelled(pairs.where(f"kind IN (2, {kind})").select("a", "b").distinct(), "a"), "b")
        return untested(some.where("label_a <> label_b").select("a", "b"))

    def merged(found: DataFrame, where: str) -> DataFrame:
        """Labels of all nodes met so far: what the labels say already, and the links just found."""
        known = joint if labels is None else labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        return connected_components(found.where("linked").select("a", "b").union(known), where)

    def picked(open_: DataFrame, k: int) -> DataFrame:
        """One partner for each member in a round: the first in the round's order, which many members share."""
        first = F.struct((F.col("a") if k == 0 else F.xxhash64(F.col("a"), F.lit(k))).alias("rank"), "a")
        return open_.groupBy("b").agg(F.min(first).alias("p")).select("p.a", "b")

    for k in range(2):
        found = compare(picked(open_pairs(k), k), f"star-{k}")
        compared = found if compared is None else compared.unionByName(found)
        labels = merged(found, f"{folder}/round-{k}")
    # What is left: likely pairs, and members of large buckets in different components that were never compared.
    # One center for all buckets that share members, that of most: each member has one difference set.
    edges = stars.where("kind IN (0, 3)").select("a", "b")
    groups = connected_components(edges, f"{folder}/groups").withColumnRenamed("label", "group")
    best = edges.groupBy("a").agg(F.count("*").alias("n")).join(groups.select(F.col("node").alias("a"), "group"), "a")
    best = common.materialized(best.groupBy("group").agg(F.max(F.struct("n", "a"))["a"].alias("center")), f"{folder}/best")
    left = groups.join(best, "group").select("center", F.col("node").alias("id"))
    left = common.materialized(labelled(left, "id").withColumnRenamed("label_id", "label"), f"{folder}/left")
    mixed = left.groupBy("center").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("center")
    left = common.materialized(left.join(common.materialized(mixed, f"{folder}/mixed"), "center"), f"{folder}/many")
    sets = with_sets(left.select("id").union(left.select("center")), "left")
    tries = 0
    while True:
        found = compare(_left_links(left, sets, num, den, f"{folder}/left-{tries}", tries), f"linked-{tries}")
        compared = compared.unionByName(found.join(compared.select("a", "b"), ["a", "b"], "left_anti"))
        labels = merged(found, f"{folder}/round-{2 + tries}")
        tries += 1
        if not found.where("NOT linked").limit(1).count():
            break
        # Names of elements have met in a pair that is no link, and may have hidden others.
        left = common.materialized(labelled(left.drop("label"), "id").withColumnRenamed("label_id", "label"), f"{folder}/again-{tries}")
    rest = compare(open_pairs(2), "rest")
    compared = compared.unionByName(rest)
    links = compared.where("linked").select("a", "b", "both", "sum")
    labels = merged(rest, f"{folder}/all")
    # Names become ids: a component's is the smallest of its classes'.
    reps = classes.select("id", "rep")
    found = labels.join(reps.withColumnRenamed("id", "node"), "node").select("node", "rep", "label")
    least = common.materialized(found.groupBy("label").agg(F.min("rep").alias("component")), f"{folder}/least")
    found = found.join(least, "label").select(F.col("node").alias("class"), "rep", "component")
    copies = classes.where("rows > 1").join(labels, F.col("id") == F.col("node"), "left_anti").select(F.col("id").alias("class"), "rep", F.col("rep").alias("component"))
    found = common.materialized(found.unionByName(copies), f"{folder}/found")
    out = named.select("id", "n_shingles", "class").join(found, "class", "left")
    links = links.join(reps.select(F.col("id").alias("a"), F.col("rep").alias("rep_a")), "a").join(reps.select(F.col("id").alias("b"), F.col("rep").alias("rep_b")), "b")
    links = common.materialized(links.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), "both", "sum"), f"{folder}/links")
    for name in ("stars", "pairs", "wanted-pairs", "sets-pairs", *(f"{what}-{k}" for what in ("star", "round", "left", "linked", "again") for k in range(2 + tries)), "groups", "best", "left", "mixed", "many", "wanted-left", "sets-left", "rest", "all", "frequent"):
        common.remove(f"{folder}/{name}")
    mine = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("representative"), mine.alias("component")), links


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document of `documents` with the component of its links; see the module."""
    members, _ = link_documents(common.table(spark, sf_dir, "documents"))
    return members.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
