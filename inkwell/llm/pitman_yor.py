"""Language-model scoring: a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Restaurants are contexts: every word opens one for what follows it, the start of a text (named by END, which stands
before it) opens another, and all share one parent, the root. A table opened in a context's restaurant sends a customer
to the root; the root draws from a base that gives `unknown` of its mass to the words that training never saw, as one
outcome, and spreads the rest evenly. Probabilities over the known words and the unknown one sum to 1 in every context.

A sweep draws the number of tables of every cell (context, word), and of every word in the root, from its conditional,
with generalised Stirling numbers in place of the partition: by their recursion up to _SMALL customers, and above by
contour integrals of their generating function, at a cost that does not grow with the customers. A cell of one customer
has one table, so nothing is drawn or stored for it: a word's and a context's such cells are their training count less
the customers of their other cells. All cells of a word lie in one part, so what goes up to the root is local; each
context's tables are summed between sweeps by the part that holds it as a word and sent to the parts with cells of it,
and only the root's two totals pass through the driver. Totals are those of the sweep before, as in usual parallel Gibbs
sampling. Probabilities are averaged over the sweeps after `burn_in`.

Data: 1. Tasks cut their documents into blocks, write each as places in its list of words, and send its different words
and its different pairs, by 64-bit hashes in order, each with its training count, to the part of the hash's range. 2. A
part sums the counts, keeps which block asked for what, and names one block for each pair that was trained on twice or
more. 3. That block sends the pair as a cell (word, context, count) to the word's part. 4. Sweeps run over the parts;
state lies in the shared folder under names made of part and sweep, and a seed made of the same, so a task that is
repeated writes the same again. 5. Cells' tables go back to the pairs' parts, and from there, as words' counts do, to
the blocks that asked. A pair without an answer is in one block alone, which knows its count. What is stored or sent is
packed: differences in sorted order, planes of bytes, zstd.

Rows: a null text is empty and has the end token alone. A null id counts as the text ''. Repeated rows count and are
scored each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common
from inkwell.llm.decontaminate import _load, _save

_SMALL = 200
END = b"\n"  # no word: words hold no white space
_STIRLING: dict[float, np.ndarray] = {}


def is_held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder


def log_stirling(d: float) -> np.ndarray:
    """log S_d(c, t) for c, t up to _SMALL."""
    if d not in _STIRLING:
        out = np.full((_SMALL + 1, _SMALL + 1), -np.inf)
        out[0, 0] = 0
        t = np.arange(1, _SMALL + 1)
        for c in range(1, _SMALL + 1):
            stay = c - 1 - d * t
            with np.errstate(divide="ignore", invalid="ignore"):
                out[c, 1:] = np.logaddexp(out[c - 1, :-1], np.where(stay > 0, np.log(np.maximum(stay, 1e-300)) + out[c - 1, 1:], -np.inf))
        _STIRLING[d] = out
    return _STIRLING[d]


def sample_tables(c: np.ndarray, d: float, theta: float, total: np.ndarray, have: np.ndarray, size: np.ndarray, slope: float, rng) -> np.ndarray:
    """Tables of cells of c <= _SMALL customers, drawn from their conditional.

    total: tables of the cell's restaurant without its own. The parent gives the k-th further table's dish the
    probability (have + slope k) / (size + slope k): slope 1 where the tables are themselves customers above.
    """
    out, stirling = np.minimum(c, 1).astype(np.int64), log_stirling(d)
    for n in np.unique(c[c > 1]).tolist():
        cells = np.flatnonzero(c == n)
        for at in range(0, len(cells), max(1, 2_000_000 // n)):
            some = cells[at : at + max(1, 2_000_000 // n)]
            k = np.arange(n)
            step = np.log(theta + d * (total[some, None] + k)) + np.log(have[some, None] + slope * k) - np.log(size[some, None] + slope * k)
            log_p = stirling[n, 1 : n + 1] + np.cumsum(step, axis=1)
            p = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
            out[some] = 1 + (p < rng.random(len(some))[:, None] * p[:, -1:]).sum(axis=1)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0."""
    low = np.log(x)
    for k in range(1, 8):
        low = low + np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.918938533204672742 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def log_coefficient(c: np.ndarray, t: np.ndarray, d: float, nodes: int = 24) -> np.ndarray:
    """log [x^c] (1 - (1 - x)^d)^t, which is log(S_d(c, t) t! d^t / c!), for c > _SMALL and 1 <= t <= c.

    x = exp(-s); s runs over a parabola around the negative axis, through the saddle point or 4 / c. Where the integrand
    is narrow (its curvature is over 2000), the saddle point alone is as good.
    """
    c, t = np.asarray(c, np.float64), np.asarray(t, np.float64)
    c = np.broadcast_to(c, t.shape)
    goal = np.log(c / t)
    ls = np.clip((np.log(d) - goal) / (1 - d), -300, 3.5)
    for step in range(10):
        s = np.exp(ls)
        y = -np.expm1(-s)
        power = y**d
        below = np.where(s < 30, 1 - power, d * np.exp(-s))
        log_r = np.log(d) + np.log(power) - np.log(y) - s - np.log(below)
        slope = s * ((d - 1) * np.exp(-s) / y - 1 + d * power / y * np.exp(-s) / below)
        if step < 9:
            ls = np.clip(ls + np.clip((goal - log_r) / np.minimum(slope, -1e-12), -2, 2), -300, 3.5)
            # Below 4 / c the contour is moved anyway.
            ls = np.maximum(ls, np.log(4 / c)) if step == 8 else ls
    tr = t * np.exp(log_r)
    curve = 4 * s * -tr * slope + 2 * s * (c - tr)
    out = t * np.log(below) + c * s - 0.5 * np.log(2 * np.pi * np.maximum(-tr * slope / s, 1e-300))
    some = np.flatnonzero((curve < 2000).ravel())
    j = np.arange(nodes + 1)
    for at in range(0, len(some), 1 << 14):
        k = some[at : at + (1 << 14)]
        m, cc, tt = s.ravel()[k, None], c.ravel()[k, None], t.ravel()[k, None]
        far = np.minimum(8.5 / np.sqrt(curve.ravel()[k, None]), 1.57 / m)
        iu = 1j * (j / nodes) * far
        z = m * (1 + iu) ** 2
        g = tt * np.log(1 - (-np.expm1(-z)) ** d) + cc * z
        top = g[:, :1].real
        f = (np.exp(g - top) * (1 + iu)).real
        f[:, 0] /= 2
        whole = 2 * m[:, 0] / np.pi * far[:, 0] / nodes * f.sum(axis=1)
        out.ravel()[k] = top[:, 0] + np.log(np.maximum(whole, 1e-300))
    return np.where(t == c, c * np.log(d), out)


def sample_large(c: np.ndarray, d: float, theta: float, total: np.ndarray, have: np.ndarray, size: np.ndarray, slope: float, rng) -> np.ndarray:
    """As sample_tables(), for cells of any number of customers over _SMALL.

    The interval of t that holds all but about e^-30 of the mass is narrowed on grids, then every t in it is weighed
    (of more than 4,096, blocks of t by their midpoints: a block is far shorter than a standard deviation).
    log_coefficient() and turn() are smooth in log t together, so in long intervals it comes from a Chebyshev series.
    """

    def turn(c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return _log_gamma(c - t + 1.0) + t * np.log(c)

    def weight(i: np.ndarray, t: np.ndarray, coefficient: np.ndarray) -> np.ndarray:
        up = t * np.log(have[i] / size[i]) if slope == 0 else _log_gamma(have[i] + t) - _log_gamma(have[i]) - _log_gamma(size[i] + t) + _log_gamma(size[i])
        return coefficient - _log_gamma(t + 1.0) + _log_gamma(theta / d + total[i] + t) + up

    have, size, total = (np.asarray(x, np.float64) for x in (have, size, total))
    lo, hi = np.ones(len(c), np.int64), c.astype(np.int64)
    out, grid = np.ones(len(c), np.int64), np.linspace(0, 1, 17)
    rest = np.arange(len(c))
    for step in range(8):
        if not len(rest):
            break
        a, b = lo[rest, None].astype(np.float64), hi[rest, None].astype(np.float64)
        t = np.rint(a * (b / a) ** grid if step == 0 else a + (b - a) * grid)
        p = weight(rest[:, None], t, log_coefficient(c[rest, None], t, d))
        keep = p > p.max(axis=1, keepdims=True) - 30
        first, final = np.argmax(keep, axis=1), len(grid) - 1 - np.argmax(keep[:, ::-1], axis=1)
        r, was = np.arange(len(rest)), hi[rest] - lo[rest]
        lo[rest], hi[rest] = t[r, np.maximum(first - 1, 0)], t[r, np.minimum(final + 1, len(grid) - 1)]
        now = hi[rest] - lo[rest]
        rest = rest[(now > 32) & (now < 0.4 * was)]
    block = (hi - lo) // 4096 + 1
    width = (hi - lo) // block + 1
    order, done, n = np.argsort(width, kind="stable"), 0, 40
    node = np.cos(np.pi * (np.arange(n) + 0.5) / n)
    series = np.cos(np.arange(n)[:, None] * np.arccos(node)) * (2 / n)  # values at the nodes to coefficients
    series[0] /= 2
    while done < len(order):
        some = order[done : done + max(1, int((1 << 16) // width[order[done]]))]
        some = some[width[some] <= 2 * width[some[0]] + 32]
        done += len(some)
        row, wide = some[:, None], int(width[some[-1]])
        t = np.minimum(lo[row] + block[row] * np.arange(wide) + (block[row] - 1) / 2, hi[row])
        if wide <= 48:
            coefficient = log_coefficient(c[row], t, d)
        else:
            a, b = np.log(lo[row].astype(np.float64)), np.log(hi[row].astype(np.float64))
            at = np.minimum(np.exp(a + (b - a) * (node + 1) / 2), c[row] - 1e-3)
            at_nodes = (log_coefficient(c[row], at, d) + turn(c[row], at)) @ series.T
            x = 2 * (np.log(t) - a) / (b - a) - 1
            one, two = np.zeros_like(x), np.zeros_like(x)
            for k in range(n - 1, 0, -1):
                one, two = at_nodes[:, k : k + 1] + 2 * x * one - two, one
            coefficient = np.where(t == c[row], c[row] * np.log(d), at_nodes[:, :1] + x * one - two - turn(c[row], t))
        p = weight(row, t, coefficient)
        p[np.arange(wide) >= width[row]] = -np.inf
        p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
        drawn = lo[some] + block[some] * (p < rng.random(len(some))[:, None] * p[:, -1:]).sum(axis=1)
        out[some] = np.minimum(drawn + rng.integers(0, block[some]), hi[some])
    return out


def draw_tables(c: np.ndarray, d: float, theta: float, total: np.ndarray, have: np.ndarray, size: np.ndarray, slope: float, rng) -> np.ndarray:
    """Tables of every cell from their conditional; see sample_tables()."""
    out, small = np.empty(len(c), np.int64), c <= _SMALL
    for some, draw in ((small, sample_tables), (~small, sample_large)):
        out[some] = draw(c[some], d, theta, total[some], have[some], size[some], slope, rng)
    return out


def _ints(x: np.ndarray) -> bytes:
    """Whole numbers, small ones mostly, none below zero: by planes of bytes, compressed."""
    x = np.ascontiguousarray(x).astype("<u8")
    if not len(x):
        return b""
    planes = max(1, (int(x.max()).bit_length() + 7) // 8)
    raw = x.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return bytes([planes]) + len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unints(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.int64)
    planes, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = np.frombuffer(pa.decompress(raw[9:], decompressed_size=planes * n, codec="zstd"), np.uint8).reshape(planes, n).T
    return out.view("<i8").ravel()


def _steps(x: np.ndarray) -> bytes:
    """Numbers in order (also hashes, whose differences may pass the end), by their differences."""
    x = np.asarray(x).astype(np.uint64)
    return _ints(np.diff(x, prepend=np.uint64(0)))


def _unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(_unints(raw).view(np.uint64), dtype=np.uint64)


def _bits(x: np.ndarray) -> bytes:
    return pa.compress(np.packbits(x).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unbits(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, bool)
    return np.unpackbits(np.frombuffer(pa.decompress(raw, decompressed_size=(n + 7) // 8, codec="zstd"), np.uint8), count=n).astype(bool)


def _ends(hashes: np.ndarray, parts: int) -> list[int]:
    """Where each part's range begins and ends in sorted hashes."""
    part = (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64)).tolist()


def _rows(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.table([pa.array([r.get(k) for r in rows], kinds[t]) for k, t in fields], [k for k, _ in fields])


def _joined(rows: list[dict], column: str, read, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[read(r[column]).astype(kind, copy=False) for r in rows]])


class Block:
    """Documents end to end: words by falling frequency, and each token's place among them."""

    def __init__(self, ids: list, held: np.ndarray, n: np.ndarray, words: np.ndarray, place: np.ndarray):
        self.ids, self.held, self.n, self.words, self.place = ids, held, n, words, place
        # Each text closes with END, so END is before the next one too.
        self.before = np.concatenate([place[-1:], place[:-1]])
        self.trained = np.repeat(~held, n)

    @staticmethod
    def of(ids: list, held: np.ndarray, texts: list[np.ndarray]) -> Block:
        words, place, many = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        order = np.argsort(-many, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return Block(ids, held, np.array([len(t) for t in texts]), words[order], rank[place])

    def save(self, uri: str) -> None:
        _save(uri, (self.ids, self.held, _ints(self.n), _steps(self.words), _ints(self.place)))

    @staticmethod
    def load(uri: str) -> Block:
        ids, held, n, words, place = _load(uri, most=1)
        return Block(ids, held, _unints(n), _unsteps(words), _unints(place))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different pairs in order of their hashes: hashes, a token of each, the pair of each token, training counts."""
        keys, first, at = np.unique(_pair(self.words, self.words)(self.place, self.before), return_index=True, return_inverse=True)
        return keys, first, at, np.bincount(at[self.trained], minlength=len(keys))


def _pair(words: np.ndarray, contexts: np.ndarray):
    """Hash of (word, context), of places in both lists."""
    mixed = common.mix(contexts)
    return lambda w, ctx: common.mix(words[w] ^ mixed[ctx])


_SENT = "part int, kind int, block long, names binary, c binary"
_OWNED = "block long, part int, pairs long, owned binary, c binary, n long, v long"


def _blocks(modulus: int, remainder: int, block_tokens: int, parts: int, folder: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, ids, texts = TaskContext.get().partitionId(), 0, [], []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal seq, ids, texts
            number = task << 24 | seq
            block = Block.of(ids, np.array([is_held_out(i, modulus, remainder) for i in ids], bool), texts)
            seq, ids, texts = seq + 1, [], []
            block.save(f"{folder}/block-{number}")
            order = np.argsort(block.words)
            known = np.bincount(block.place[block.trained], minlength=len(order))
            pairs, _, _, c = block.pairs()
            for kind, names, counts in ((0, block.words[order], known[order]), (1, pairs, c)):
                ends = _ends(names, parts)
                rows = [{"part": q, "kind": kind, "block": number, "names": _steps(names[a:b]), "c": _ints(counts[a:b])} for q, (a, b) in enumerate(zip(ends, ends[1:]))]
                yield from _rows(_SENT, rows).to_batches()

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(common.hash_words([*common.space_words(text), END]))
            if sum(map(len, texts)) >= block_tokens:
                yield from close()
        if ids:
            yield from close()

    return cut


def _merge(folder: str):
    """A part's words and pairs, summed over the blocks; each block hears which pairs it sends on as cells."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("kind", "ascending"), ("block", "ascending")]).to_pylist()
        q, (words, pairs) = rows[0]["part"], ([r for r in rows if r["kind"] == k] for k in (0, 1))
        names, place = np.unique(_joined(words, "names", _unsteps, np.uint64), return_inverse=True)
        known = np.bincount(place, weights=_joined(words, "c", _unints, np.int64), minlength=len(names)).astype(np.int64)
        _save(f"{folder}/words-{q}", (_steps(names), _ints(known)))
        cuts = np.cumsum([len(_unints(r["c"])) for r in words])[:-1]
        _save(f"{folder}/asked-{q}", {r["block"]: _steps(x) for r, x in zip(words, np.split(place, cuts))})

        names, c = _joined(pairs, "names", _unsteps, np.uint64), _joined(pairs, "c", _unints, np.int64)
        cuts = np.cumsum([len(_unints(r["c"])) for r in pairs])[:-1]
        keys, first, place, many = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        total = np.bincount(place, weights=c, minlength=len(keys)).astype(np.int64)
        several = (many > 1) | (total > 1)
        owned = np.zeros(len(names), bool)
        owned[first[total > 1]] = True
        answers = several[place]
        number = np.cumsum(several) - 1
        asked = {r["block"]: (len(p), _bits(a), _steps(number[p[a]])) for r, p, a in zip(pairs, np.split(place, cuts), np.split(answers, cuts))}
        _save(f"{folder}/pairs-{q}", (_steps(keys[total > 1]), _ints(total[several]), asked))
        out = [{"part": q, "n": int(known.sum()), "v": int((known > 0).sum())}]
        for r, p, o in zip(pairs, np.split(place, cuts), np.split(owned, cuts)):
            out.append({"part": q, "block": r["block"], "pairs": len(p), "owned": _bits(o), "c": _ints(total[p[o]])})
        return _rows(_OWNED, out)

    return merge


_CELLS = "part int, block long, w binary, ctx binary, c binary"


def _cells(folder: str, parts: int):
    """The cells that a block sends on, to their words' parts."""

    def cells(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        block = Block.load(f"{folder}/block-{rows[0]['block']}")
        owned = np.concatenate([_unbits(r["owned"], r["pairs"]) for r in rows])
        token = block.pairs()[1][owned]
        w, ctx, c = block.words[block.place[token]], block.words[block.before[token]], _joined(rows, "c", _unints, np.int64)
        order = np.lexsort((ctx, w))
        w, ctx, c = w[order], ctx[order], c[order]
        ends = _ends(w, parts)
        out = [{"part": q, "block": rows[0]["block"], "w": _steps(w[a:b]), "ctx": _ints(ctx[a:b]), "c": _ints(c[a:b])} for q, (a, b) in enumerate(zip(ends, ends[1:]))]
        return _rows(_CELLS, out)

    return cells


class Model:
    """Parameters, and the arithmetic of a chunk: w, ctx, c are its cells, sorted by word; ctx 0 is the root itself."""

    def __init__(self, n_ctx: int, vocabulary: int, unknown: float, d: tuple[float, float], theta: tuple[float, float]):
        self.n_ctx, self.vocabulary, self.unknown, self.d, self.theta = n_ctx, max(1, vocabulary), unknown, d, theta

    def sized(self, n_ctx: int) -> Model:
        """The same for a chunk's own contexts."""
        return Model(n_ctx, self.vocabulary, self.unknown, self.d, self.theta)

    def words(self, w: np.ndarray) -> tuple[np.ndarray, int]:
        new = np.ones(len(w), bool)
        new[1:] = w[1:] != w[:-1]
        return np.cumsum(new) - 1, int(new.sum())

    def root(self, word, n_words, ctx, c, t):
        """The words' training counts, and their customers in the root."""
        known = np.bincount(word, weights=c, minlength=n_words)
        return known, np.bincount(word, weights=np.where(ctx == 0, c, t), minlength=n_words)

    def base(self, known: np.ndarray) -> np.ndarray:
        return np.where(known > 0, (1 - self.unknown) / self.vocabulary, self.unknown)

    def root_mass(self, customers, tables, base, totals):
        return customers - self.d[0] * tables + (self.theta[0] + self.d[0] * totals["t"][0]) * base

    def sweep(self, state: dict, w, ctx, c, totals: dict, rng) -> dict:
        """One Gibbs sweep. state: t (tables of each cell; of ctx 0: 0), t0 (of each word in the root)."""
        word, n_words = self.words(w)
        first = "t" not in state
        t = np.where(ctx > 0, np.minimum(c, 1), 0) if first else state["t"]
        known, customers = self.root(word, n_words, ctx, c, t)
        t0 = np.minimum(customers, 1).astype(np.int64) if first else state["t0"]
        base = self.base(known)
        some = np.flatnonzero((ctx > 0) & (c > 0))
        own, wd = t[some], word[some]
        total = np.maximum(totals["t"][ctx[some]] - own, 0)
        have = np.maximum(self.root_mass(customers, t0, base, totals)[wd] - own, 1e-12)
        size = np.maximum(self.theta[0] + totals["c"][0] - own, 1.0)
        new = t.astype(np.int64).copy()
        new[some] = draw_tables(c[some], self.d[1], self.theta[1], total, have, size, 1.0, rng)
        _, customers = self.root(word, n_words, ctx, c, new)
        customers = customers.astype(np.int64)
        some = np.flatnonzero(customers > 0)
        total = np.maximum(totals["t"][0] - t0[some], 0)
        new0 = np.zeros(n_words, np.int64)
        new0[some] = draw_tables(customers[some], self.d[0], self.theta[0], total, base[some], np.ones(len(some)), 0.0, rng)
        return {"t": new.astype(np.int32), "t0": new0.astype(np.int32)}

    def totals(self, state: dict, w, ctx, c) -> tuple[np.ndarray, np.ndarray]:
        """Tables and customers of each restaurant in this chunk."""
        word, n_words = self.words(w)
        t = np.bincount(ctx, weights=np.where(ctx > 0, state["t"], 0), minlength=self.n_ctx + 1)
        n = np.bincount(ctx, weights=np.where(ctx > 0, c, 0), minlength=self.n_ctx + 1)
        t[0] = state["t0"].sum()
        n[0] = self.root(word, n_words, ctx, c, state["t"])[1].sum()
        return t, n

    def predict(self, state: dict, w, ctx, c, totals: dict) -> np.ndarray:
        word, n_words = self.words(w)
        known, customers = self.root(word, n_words, ctx, c, state["t"])
        root = self.root_mass(customers, state["t0"], self.base(known), totals) / (self.theta[0] + totals["c"][0])
        up = root[word]
        d, theta = self.d[1], self.theta[1]
        here = (c - d * state["t"] + (theta + d * totals["t"][ctx]) * up) / (theta + totals["c"][ctx])
        return np.where(ctx > 0, here, up)


class Part:
    """The words of a part in order and its cells, each word's single customers first, as a cell of the root (ctx 0)."""

    def __init__(self, folder: str, q: int):
        self.words, self.known = (read(x) for read, x in zip((_unsteps, _unints), _load(f"{folder}/words-{q}", most=1)))
        word, ctx, c, names = _load(f"{folder}/cells-{q}", most=1)
        word, ctx, c, self.names = _unsteps(word).astype(np.int64), _unints(ctx), _unints(c), _unsteps(names)
        single = self.known - np.bincount(word, weights=c, minlength=len(self.words)).astype(np.int64)
        w = np.concatenate([np.arange(len(self.words)), word])
        order = np.argsort(w, kind="stable")
        self.w, self.c = w[order], np.concatenate([single, c])[order]
        self.ctx = np.concatenate([np.zeros(len(self.words), np.int64), ctx + 1])[order]

    def less(self, model: Model, state: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many fewer tables than customers each context has here; tables and customers of the root."""
        t, n = model.sized(len(self.names)).totals(state, self.w, self.ctx, self.c)
        return (n - t)[1:].astype(np.int64), t[0], n[0]


_SUMS = "part int, chunk long, names binary, v binary, t double, c double"


def _sums(q: int, part: Part, less: tuple, parts: int, name: bool) -> pa.Table:
    """A part's share in the contexts' totals, for each part that sums them, and (part -1) in the root's."""
    ends = _ends(part.names, parts)
    rows = [{"part": r, "chunk": q, "names": _steps(part.names[a:b]) if name else None, "v": _ints(less[0][a:b])} for r, (a, b) in enumerate(zip(ends, ends[1:]))]
    return _rows(_SUMS, [{"part": -1, "chunk": q, "t": float(less[1]), "c": float(less[2])}, *rows])


def _gather(folder: str, model: Model, parts: int):
    """A part's cells; totals before the first sweep: a table for each cell."""

    def gather(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        q = rows[0]["part"]
        w, ctx, c = (_joined(rows, k, read, kind) for k, read, kind in (("w", _unsteps, np.uint64), ("ctx", _unints, np.uint64), ("c", _unints, np.int64)))
        order = np.lexsort((ctx, w))
        names, place = np.unique(ctx[order], return_inverse=True)
        word = np.searchsorted(_unsteps(_load(f"{folder}/words-{q}", most=1)[0]), w[order])
        _save(f"{folder}/cells-{q}", (_steps(word), _ints(place), _ints(c[order]), _steps(names)))
        part = Part(folder, q)
        customers = model.root(part.w, len(part.words), part.ctx, part.c, np.minimum(part.c, 1))[1]
        state = {"t": np.where(part.ctx > 0, 1, 0), "t0": np.minimum(customers, 1)}
        return _sums(q, part, part.less(model, state), parts, True)

    return gather


_REPLIES = "chunk long, part int, t binary, c binary"


def _exchange(folder: str, k: int):
    """Sums the totals of a part's contexts over the parts that have cells of them, and answers each in its own order."""

    def exchange(table: pa.Table) -> pa.Table:
        rows = table.sort_by("chunk").to_pylist()
        q = rows[0]["part"]
        words, known = _load(f"{folder}/words-{q}", most=1)
        known = _unints(known)
        if k == 0:
            words = _unsteps(words)
            at = [np.searchsorted(words, _unsteps(r["names"])) for r in rows]
            _save(f"{folder}/routes-{q}", {r["chunk"]: _steps(x) for r, x in zip(rows, at)})
        else:
            routes = _load(f"{folder}/routes-{q}", most=1)
            at = [_unsteps(routes[r["chunk"]]).astype(np.int64) for r in rows]
        less = np.bincount(np.concatenate(at), weights=_joined(rows, "v", _unints, np.int64), minlength=len(known)).astype(np.int64)
        _save(f"{folder}/less-{k}-{q}", _ints(less))
        return _rows(_REPLIES, [{"chunk": r["chunk"], "part": q, "t": _ints((known - less)[x]), "c": _ints(known[x]) if k == 0 else None} for r, x in zip(rows, at)])

    return exchange


def _sweeper(model: Model, folder: str, k: int, root: tuple[float, float], parts: int, burn_in: int, seed: int):
    """Does sweep k with the totals of the state before; gives its totals."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        q = rows[0]["chunk"]
        part = Part(folder, q)
        state = {x: _unints(raw) if isinstance(raw, bytes) else [*raw] for x, raw in _load(f"{folder}/state-{k - 1}/{q}", most=1).items()} if k else {"kept": []}
        customers = state["c"] if k else _joined(rows, "c", _unints, np.int64)
        totals = {"t": np.append(root[0], _joined(rows, "t", _unints, np.int64)), "c": np.append(root[1], customers)}
        had = {x: state[x] for x in ("t", "t0") if x in state}
        new = model.sized(len(part.names)).sweep(had, part.w, part.ctx, part.c, totals, np.random.default_rng((seed, k, q)))
        kept, tables = state["kept"], state.get("sum", np.zeros(len(part.w), np.int64))
        if k >= burn_in:
            # What predictions need of this sweep: tables of cells, customers and tables of words in the root.
            kept = [*kept, (_ints(model.root(part.w, len(part.words), part.ctx, part.c, new["t"])[1]), _ints(new["t0"]))]
            tables = tables + new["t"]
        _save(f"{folder}/state-{k}/{q}", {"t": _ints(new["t"]), "t0": _ints(new["t0"]), "c": _ints(customers), "sum": _ints(tables), "kept": kept})
        return _sums(q, part, part.less(model, new), parts, False)

    return run


_TABLES = "part int, chunk long, names binary, t binary"


def _tables(folder: str, k: int, parts: int):
    """The contexts' last totals; and the tables of a part's cells, over all sweeps that count, to their pairs' parts."""
    exchange = _exchange(folder, k)

    def tables(table: pa.Table) -> pa.Table:
        exchange(table)
        q = table.column("part")[0].as_py()
        part, state = Part(folder, q), _load(f"{folder}/state-{k - 1}/{q}", most=1)
        cell = part.ctx > 0
        names, t = _pair(part.words, part.names)(part.w[cell], part.ctx[cell] - 1), _unints(state["sum"])[cell]
        order = np.argsort(names, kind="stable")
        names, t = names[order], t[order]
        ends = _ends(names, parts)
        return _rows(_TABLES, [{"part": r, "chunk": q, "names": _steps(names[a:b]), "t": _ints(t[a:b])} for r, (a, b) in enumerate(zip(ends, ends[1:]))])

    return tables


_ANSWERS = "block long, part int, kind int, pairs long, asked binary, c binary, t binary"


def _pair_answers(folder: str, sweeps: int):
    """Customers and tables (over so many sweeps) of the pairs that are in several blocks or have several customers."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        q = rows[0]["part"]
        cells, total, asked = _load(f"{folder}/pairs-{q}", most=1)
        cells, total = _unsteps(cells), _unints(total)
        of_cell = np.zeros(len(cells), np.int64)
        of_cell[np.searchsorted(cells, _joined(rows, "names", _unsteps, np.uint64))] = _joined(rows, "t", _unints, np.int64)
        t = total * sweeps
        t[total > 1] = of_cell
        out = []
        for block, (n, mask, number) in asked.items():
            number = _unsteps(number).astype(np.int64)
            out.append({"block": block, "part": q, "kind": 1, "pairs": n, "asked": mask, "c": _ints(total[number]), "t": _ints(t[number])})
        return _rows(_ANSWERS, out)

    return answer


def _word_answers(folder: str, burn_in: int, sweeps: int):
    """Of each word that a block asked for: training count, and for each sweep that counts customers less tables as a
    context, customers and tables in the root."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in batch.column(0).to_pylist():
                known = _unints(_load(f"{folder}/words-{q}", most=1)[1])
                kept = _load(f"{folder}/state-{sweeps - 1}/{q}", most=1)["kept"]
                less = [_unints(_load(f"{folder}/less-{k + 1}-{q}", most=1)) for k in range(burn_in, sweeps)]
                every = np.stack([known, *less, *[_unints(x) for both in zip(*kept) for x in both]])
                for block, at in _load(f"{folder}/asked-{q}", most=1).items():
                    yield from _rows(_ANSWERS, [{"block": block, "part": q, "kind": 0, "c": _ints(every[:, _unsteps(at).astype(np.int64)].ravel())}]).to_batches()

    return answer


def _score(folder: str, model: Model, roots: list[tuple[float, float]], tokens: int, vocabulary: int):
    """The documents of a block; roots: the root's totals after each sweep that counts."""
    d, theta, many = model.d[1], model.theta[1], len(roots)

    def score(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("kind", "ascending"), ("part", "ascending")]).to_pylist()
        block = Block.load(f"{folder}/block-{rows[0]['block']}")
        words, pairs = ([r for r in rows if r["kind"] == k] for k in (0, 1))
        got = np.empty((1 + 3 * many, len(block.words)), np.int64)
        got[:, np.argsort(block.words)] = np.concatenate([_unints(r["c"]).reshape(1 + 3 * many, -1) for r in words], axis=1)
        known, less, customers, tables = got[0], got[1 : 1 + many], got[1 + many : 1 + 2 * many], got[1 + 2 * many :]
        _, first, at, c = block.pairs()
        asked = np.concatenate([_unbits(r["asked"], r["pairs"]) for r in pairs])
        t = c * many  # a pair that no other block has, and one customer at most
        c[asked], t[asked] = (_joined(pairs, x, _unints, np.int64) for x in ("c", "t"))
        w, ctx = block.place[first], block.before[first]
        up = np.zeros(len(first))
        for k, root in enumerate(roots):
            mass = model.root_mass(customers[k], tables[k], model.base(known), {"t": root}) / (model.theta[0] + root[1])
            up += (theta + d * (known - less[k]))[ctx] * mass[w]
        log_p = np.log10((c - d * t / many + up / many) / (theta + known[ctx]))
        begins = np.cumsum(block.n) - block.n
        base = np.log10((known + 1) / (tokens + vocabulary + 1))[block.place]
        columns = {
            "id": pa.array(block.ids, pa.int64()), "held_out": pa.array(block.held), "n_tokens": pa.array(block.n, pa.int64()),
            "n_known": pa.array(np.add.reduceat((known > 0)[block.place].astype(np.int64), begins)),
            "base_score": pa.array(np.add.reduceat(base, begins)), "score": pa.array(np.add.reduceat(log_p[at], begins)),
        }
        return pa.table(columns)

    return score


def score_documents(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    modulus: int = 7,
    remainder: int = 2,
    sweeps: int = 4,
    burn_in: int = 1,
    unknown: float = 0.5,
    discount: tuple[float, float] = (0.6, 0.8),
    strength: tuple[float, float] = (1.0, 1.0),
    block_tokens: int = 1 << 21,
    chunk_cells: int = 2_000_000,
    seed: int = 7,
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; see the module.

    Perplexity of a text: 10 ** (-score / n_tokens). discount and strength: of the root and of the contexts.
    chunk_cells: tokens for each part, about, at six bytes each; what a part holds of one word is not split.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    folder = common.shared_dir(spark, "pitman-yor")
    common.make_dir(folder)
    burn_in = min(burn_in, sweeps - 1)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    parts = max(1, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (6 * chunk_cells))

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    sent = rows.mapInArrow(_blocks(modulus, remainder, block_tokens, parts, folder), _SENT)
    owned = written(sent.groupBy("part").applyInArrow(_merge(folder), _OWNED), "owned")
    n, v = owned.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    model = Model(0, v, unknown, discount, strength)
    cells = owned.where("block IS NOT NULL").groupBy("block").applyInArrow(_cells(folder, parts), _CELLS)
    sums = written(cells.groupBy("part").applyInArrow(_gather(folder, model, parts), _SUMS), "sums-0")
    roots = []
    for k in range(sweeps + 1):
        root = tuple(sums.where("part < 0").agg(F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum("c"), F.lit(0.0))).first())
        roots.append(root)
        shares = sums.where("part >= 0").groupBy("part")
        if k < sweeps:
            common.make_dir(f"{folder}/state-{k}")
            replies = shares.applyInArrow(_exchange(folder, k), _REPLIES).groupBy("chunk")
            sums = written(replies.applyInArrow(_sweeper(model, folder, k, root, parts, burn_in, seed), _SUMS), f"sums-{k + 1}")
        else:
            tables = written(shares.applyInArrow(_tables(folder, k, parts), _TABLES), "tables")
        # A sweep reads the state and totals of the one before alone.
        common.remove(f"{folder}/sums-{k}")
        if 0 < k < sweeps:
            common.remove(f"{folder}/state-{k - 1}")
    of_pairs = tables.groupBy("part").applyInArrow(_pair_answers(folder, sweeps - burn_in), _ANSWERS)
    of_words = owned.where("block IS NULL").select("part").mapInArrow(_word_answers(folder, burn_in, sweeps), _ANSWERS)
    schema = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = of_pairs.unionByName(of_words).groupBy("block").applyInArrow(_score(folder, model, roots[burn_in + 1 :], n, v), schema)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document of `documents` scored; those of remainder 2 are held out of training. See the module."""
    return score_documents(common.table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
