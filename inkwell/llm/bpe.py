"""Operator 12: byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A text's encoding is the only sequence of tokens whose neighbours are all compatible: two tokens are compatible when
the merges, undone in reverse order on both sides of their border, never show a pair that would have merged across it.
So the encoder takes the longest token at each place, as an Aho-Corasick automaton finds them, checks it against the
token before, falls back to the token's next shorter prefix, and steps back where none fits. A place that has failed
once is never tried again, so the work is linear in the text.

The vocabulary's rules (NFC, lower case, white space dropped, pieces of letters, single digits or other signs, a
suffix on the last symbol of a piece) are those of the tokenizer file, which is checked when it is loaded. Pieces with
a character whose class or folding depends on the Unicode release go through the library's own normalizer and splitter.

Nulls are empty texts; an empty text has no ids and decodes to "". Repeated rows and null keys stay rows. Special
tokens in a text are single ids, as with the library. Texts are whole; batches are cut by bytes, between texts.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common

_LOADED: dict[str, WordPairEncoder] = common.keep({})
#: The rules a tokenizer file must have; the pattern's alternatives are tried in this order.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Latin, Greek without its capital sigma, and Cyrillic, with common punctuation: the same in every Unicode release.
_STABLE = regex.compile(r"[\x00-\x1B\x20-\x84\x86-ɏΑ-ΡΤ-Ωα-ωА-я‐-‧‰-‾]*")
_INF = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 stays, the rest follows U+00FF."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class WordPairEncoder:
    """Encodes and decodes whole texts. Symbols are bytes, and bytes + 256 where a piece ends."""

    def __init__(self, path: str, cache_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if [s["type"] for s in steps] != _NORMALIZERS or first.get("pattern", {}).get("Regex") != _PATTERN or not suffix or not plain or spec["decoder"]:
            raise ValueError(f"{path} is not a tokenizer of lower-cased words with an end suffix")
        self.tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()

        def symbols(token: str) -> str:
            ends = token.endswith(suffix)
            raw = [letters[c] for c in (token[: -len(suffix)] if ends else token)]
            return "".join(map(chr, raw[:-1] + [raw[-1] + 256 * ends]))

        vocab = model["vocab"]
        self.n = max(vocab.values()) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must be matched as they are")
        any_special = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)"
        self.cut, self.whole = regex.compile(any_special), regex.compile(f"({any_special})")
        total = max([self.n, *(i + 1 for i in self.special.values())])
        # Offset table: every token's text and a space, end to end.
        shown = [b""] * total
        for token, i in (vocab | self.special).items():
            shown[i] = token.encode() + b" "
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in shown]))).astype(np.int64)
        self.flat = np.frombuffer(b"".join(shown), np.uint8)
        # Merges: both halves of each token, and the token of each pair.
        self.left, self.right = np.full(self.n, -1, np.int64), np.full(self.n, -1, np.int64)
        self.pair: dict[int, int] = {}
        last = -1
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z <= max(last, x, y):
                raise ValueError("ids must follow the order of merges")
            self.left[z], self.right[z], last = x, y, z
            self.pair[x << 32 | y] = z
        keys = np.fromiter(self.pair, np.int64, len(self.pair))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(self.pair.values(), np.int64, len(keys))[order]
        # A token that its own merges don't give is never met.
        ok = np.ones(self.n, bool)
        split = np.flatnonzero(self.left >= 0)
        ok[split] = self.compatible(self.left[split], self.right[split], split)
        for z in split.tolist():
            ok[z] &= ok[self.left[z]] and ok[self.right[z]]
        self.automaton = ahocorasick.Automaton()
        self.text = {i: symbols(t) for t, i in vocab.items() if ok[i]}
        for i, s in self.text.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        known = {s: i for i, s in self.text.items()}
        self.size = np.zeros(self.n, np.int64)
        self.shorter = np.full(self.n, -1, np.int64)  # the longest token that is a proper prefix
        for s, i in known.items():
            self.size[i] = len(s)
            self.shorter[i] = next((known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), -1)
        self._l, self._r, self._size, self._shorter = (x.tolist() for x in (self.left, self.right, self.size, self.shorter))
        self.pattern = regex.compile(_PATTERN + r"|\n")
        self.pieces: dict[str, bytes] = {"\n": b""}
        self.seen, self.good = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.cache_words = cache_words

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int = _INF) -> np.ndarray:
        """Whether tokens a and b stay apart side by side: no pair at their border has a token below the limit.

        The younger of the two at the border is undone, and from then on only merges older than it count. Of two equal
        merges the left one comes first, so one across the border gives way to an equal one in a, but not to one in b.
        """
        a, b, limit = a.copy(), b.copy(), np.broadcast_to(limit, a.shape).astype(np.int64)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            bad = (self.keys[at] == key) & (self.made[at] < limit[live]) if len(self.keys) else np.zeros(len(live), bool)
            good[live[bad]] = False
            first = x > y
            ends = np.where(first, self.left[x], self.left[y]) < 0
            stay = ~(bad | ends)
            live, x, y, first = live[stay], x[stay], y[stay], first[stay]
            limit[live] = np.where(first, x, y + 1)
            a[live], b[live] = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return good

    def _fits(self, a: int, b: int) -> bool:
        """compatible() of one pair."""
        limit, left, right, pair = _INF, self._l, self._r, self.pair
        while True:
            if pair.get(a << 32 | b, _INF) < limit:
                return False
            if a > b:
                if left[a] < 0:
                    return True
                limit, a = a, right[a]
            else:
                if left[b] < 0:
                    return True
                limit, b = b + 1, left[b]

    def _backtrack(self, piece: str, longest: list[int]) -> list[int]:
        """Ids of one piece, given as symbols and by the longest token that begins at each place."""
        open_, out, at, token = [True] * (len(piece) + 1), [], 0, longest[0]
        while True:
            end = at + self._size[token]
            if open_[end] and (not out or self._fits(out[-1], token)):
                out.append(token)
                at = end
                if at == len(piece):
                    return out
                token = longest[at]
            elif self._shorter[token] >= 0:
                token = self._shorter[token]
            else:
                open_[at] = False
                token = out.pop()
                at -= self._size[token]

    def _fits_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() by way of a table of pairs seen before, of fixed size; a pair may push another one out."""
        key = a << 32 | b
        slot = (common.mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        out, miss = self.good[slot], np.flatnonzero(self.seen[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            out[miss] = self.compatible(new >> 32, new & 0xFFFFFFFF)[back]
            self.seen[slot[miss]], self.good[slot[miss]] = key[miss], out[miss]
        return out

    def _backtrack_all(self, raw: list[str]) -> list[np.ndarray]:
        """_backtrack() of many pieces in step; the last few, which are long, go on alone from their beginning."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(size + 1) - size - 1
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(chr(0x300).join(raw))), np.int64).reshape(-1, 2)
        longest = np.full(int((size + 1).sum()), -1, np.int64)
        longest[found[:, 0] - self.size[found[:, 1]] + 1] = found[:, 1]  # of one place the longest match ends last
        open_, came = np.ones(len(longest), bool), np.full(len(longest), -1, np.int64)
        live, ends = np.arange(len(raw)), starts + size
        at, token = starts.copy(), longest[starts]
        while len(live) > 100:
            x, t = at[live], token[live]
            end, before = x + self.size[t], came[x]
            fits = open_[end]
            look = np.flatnonzero(fits & (before >= 0))
            fits[look] = self._fits_all(before[look], t[look])
            take = live[fits]
            came[end[fits]], at[take] = t[fits], end[fits]
            token[take] = longest[end[fits]]
            lost, t, x, before = live[~fits], t[~fits], x[~fits], before[~fits]
            back = self.shorter[t] < 0
            open_[x[back]] = False
            token[lost] = np.where(back, before, self.shorter[t])
            at[lost] = np.where(back, x - np.where(back, self.size[before], 0), x)
            live = live[at[live] < ends[live]]
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(raw)
        slow = set(live.tolist())
        for j in slow:
            out[j] = np.array(self._backtrack(raw[j], longest[starts[j] : ends[j]].tolist()), "<u4")
        # The tokens by which each piece's end was reached, from the last to the first.
        live, rounds = np.setdiff1d(np.arange(len(raw)), live), []
        at = ends.copy()
        while len(live):
            t = came[at[live]]
            rounds.append((live, t))
            at[live] -= self.size[t]
            live = live[at[live] > starts[live]]
        if rounds:
            owner, ids = (np.concatenate(x) for x in zip(*rounds))
            turn = np.concatenate([np.full(len(r[0]), k) for k, r in enumerate(rounds)])
            order = np.lexsort((-turn, owner))
            owner, ids = owner[order], ids[order].astype("<u4")
            cuts = np.searchsorted(owner, np.arange(len(raw) + 1))
            for j in range(len(raw)):
                if j not in slow:
                    out[j] = ids[cuts[j] : cuts[j + 1]]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """All longest matches of many pieces at once; where their pairs are compatible, they are the encoding."""
        for k in range(0, len(pieces), 50_000):
            part = pieces[k : k + 50_000]
            raw = [p.encode("utf-8").decode("latin-1") for p in part]
            raw = [s[:-1] + chr(ord(s[-1]) + 256) for s in raw]
            found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter_long(chr(0x300).join(raw))), np.int64).reshape(-1, 2)
            ids, begins = found[:, 1], found[:, 0] - self.size[found[:, 1]] + 1
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            starts = np.cumsum(size + 1) - size - 1
            of = np.searchsorted(starts, begins, "right") - 1
            inner = np.flatnonzero(of[1:] == of[:-1])
            wrong = np.bincount(of, self.size[ids], len(raw)) != size  # matches that don't cover the piece
            wrong[of[inner][~self._fits_all(ids[inner], ids[inner + 1])]] = True
            ends = np.searchsorted(of, np.arange(len(raw)), "right")
            packed, cuts = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
            self.pieces.update((p, packed[a:b]) for p, a, b in zip(part, cuts, cuts[1:]))
            bad = np.flatnonzero(wrong).tolist()
            self.pieces.update((part[j], x.tobytes()) for j, x in zip(bad, self._backtrack_all([raw[j] for j in bad])))

    def _split(self, text: str) -> list[str]:
        """Pieces of texts that end in line breaks, a line break after each text's."""
        if _STABLE.fullmatch(text):
            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        out = []
        for line in text.split("\n")[:-1]:
            if _STABLE.fullmatch(line):
                out += self.pattern.findall(unicodedata.normalize("NFC", line).lower())
            else:
                tokenizer, back = self.tokenizer, self._bytes
                found = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(line))
                out += [bytes(map(back.__getitem__, p)).decode("utf-8") for p, _ in found]
            out.append("\n")
        return out

    _bytes = byte_letters()

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without ASCII white space end to end, and how many each has."""
        parts, marks, of = chunks, {}, None
        if any("<" in c and self.cut.search(c) for c in chunks):
            # A special token stands as a part of its own, whose line break takes its id.
            cut = [[p for p in self.whole.split(c) if p] if "<" in c else [c] for c in chunks]
            parts, of = [p for c in cut for p in c], np.repeat(np.arange(len(chunks)), list(map(len, cut)))
            marks = {k: self.special[p] for k, p in enumerate(parts) if p in self.special}
            for k in marks:
                parts[k] = ""
        pieces = self._split("".join([p + "\n" for p in parts]))
        get = self.pieces.get
        raw = list(map(get, pieces))
        if None in raw:
            self._learn([p for p in dict.fromkeys(p for p, r in zip(pieces, raw) if r is None)])
            raw = list(map(get, pieces))
        breaks = [k for k, p in enumerate(pieces) if p == "\n"]
        for k, i in marks.items():
            raw[breaks[k]] = np.array([i], "<u4").tobytes()
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        sizes = np.diff(np.cumsum(size)[breaks], prepend=0)
        return np.frombuffer(b"".join(raw), "<u4"), sizes if of is None else np.bincount(of, sizes, len(chunks)).astype(np.int64)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        # White space ends a chunk and is no part of any piece, so equal chunks have equal ids wherever they stand.
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        table, size = self._encode_chunks(coded.dictionary.to_pylist())
        start, took = np.cumsum(size) - size, size[at]
        ends = np.concatenate(([0], np.cumsum(took)))
        out = table[np.repeat(start[at] - ends[:-1], took) + np.arange(ends[-1])]
        if len(self.pieces) > self.cache_words:
            self.pieces.clear()
            self.pieces["\n"] = b""
        return out, np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])

    def decode_array(self, ids: np.ndarray, sizes: np.ndarray, step: int = 1 << 18) -> list[bytes]:
        """Each text's tokens with a space between, gathered through the offset table, some ids at a time."""
        length = self.offsets[ids.astype(np.int64) + 1] - self.offsets[ids]
        parts = []
        for k in range(0, len(ids), step):
            n = length[k : k + step]
            begin = np.cumsum(n) - n
            parts.append(self.flat[np.repeat(self.offsets[ids[k : k + step]] - begin, n) + np.arange(n.sum())].tobytes())
        raw, cuts = b"".join(parts), np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]


def encoder(path: str) -> WordPairEncoder:
    """One encoder per Python worker and tokenizer file."""
    common.claim("bpe")
    if path not in _LOADED:
        _LOADED[path] = WordPairEncoder(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    """Place of the public vocabulary of 49k lower-cased words; a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, decode: bool = True) -> DataFrame:
    """A row for each row: key, n_tokens, ids as little-endian 32-bit integers, and the text that they decode to."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            enc = encoder(path)
            ids, sizes = enc.encode_array(batch.column("text"))
            raw, cuts = ids.tobytes(), [0, *(4 * np.cumsum(sizes)).tolist()]
            decoded = pa.array(enc.decode_array(ids, sizes), pa.binary()).cast(pa.string()) if decode else pa.nulls(len(sizes), pa.string())
            columns = [batch.column("key"), pa.array(sizes, pa.int64()), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()), decoded]
            yield pa.record_batch(columns, ["key", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, n_tokens long, ids binary, decoded string")


def decode_texts(encoded: DataFrame, *, key: str = "key", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """A row for each row: key, decoded. ids are little-endian 32-bit integers; null ids are none."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "ids"):
            raw = [x or b"" for x in batch.column("ids").to_pylist()]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            texts = encoder(path).decode_array(np.frombuffer(b"".join(raw), "<u4"), sizes)
            yield pa.record_batch([batch.column("key"), pa.array(texts, pa.binary()).cast(pa.string())], ["key", "decoded"])

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, encoded.select(F.col(key).alias("key"), F.lit("").alias("decoded")).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: documents encoded and decoded; see the module."""
    return encode_texts(common.table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
