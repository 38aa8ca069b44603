"""Exact, cached encoding with a byte-level BPE of the tokenizers library."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkwell.llm import common

#: A cut before a single space between two non-space characters never changes a byte-level BPE's
#: pre-tokens: the space opens the next one, and none holds a space elsewhere.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ".,;:!?)"
#: Words whose ids an encoder keeps between batches, about.
CACHE_WORDS = 600_000
_LOADED: dict[str, BytePairEncoder] = common.keep({})


class BytePairEncoder:
    """Encodes whole texts; equal words are encoded once while they stay in the cache.

    A text is cut only where the encoding can't change (see _CUT), so the ids are those of
    ``Tokenizer.encode(text, add_special_tokens=False)``. Between batches the cache holds about ``cache_words`` words at most.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.max_id = max(vocab.values(), default=0)
        self.dtype = np.dtype("<u2" if self.max_id < 1 << 16 else "<u4")
        self.opens = np.zeros(self.max_id + 1, bool)  # ids of tokens that begin with a space
        for token, i in vocab.items():
            self.opens[i] = token.startswith("Ġ")
        # Two generations: the younger takes what is used; when it is full, it takes the place of the older.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words
        # GPT-2's pre-tokens: a line feed between two non-space characters is one of its own, and what follows it begins anew.
        rule = self.tokenizer.pre_tokenizer
        lines = self.tokenizer.normalizer is None and type(rule).__name__ == "ByteLevel" and rule.use_regex
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids if lines else []
        self.feed = feed[0] if len(feed) == 1 else None
        self.added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype) for x in found]

    def _learn(self, words: list[str], before: str = " ") -> None:
        """Encodes words that each follow a space (or open with a line feed, with nothing before them), many in one text,
        and splits at tokens that open with a space (or at line feeds)."""
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            ids = self._encode([before + before.join(part)])[0]
            starts = np.flatnonzero(self.opens[ids] if before else ids == self.feed)
            if len(starts) != len(part):  # a vocabulary in which the rule does not hold
                self.cache.update(zip(part, (x.tobytes() for x in self._encode([before + w for w in part]))))
                continue
            raw, cuts = ids.tobytes(), [*(starts * self.dtype.itemsize).tolist(), ids.nbytes]
            self.cache.update((w, raw[a:b]) for w, a, b in zip(part, cuts, cuts[1:]))

    def _learn_all(self, words: list[str]) -> None:
        """Learns words; one that is letters and a final mark is put together from its two pre-tokens."""
        if self.feed is not None:
            lines = [w for w in words if w[0] == "\n"]
            self._learn(lines, "")
            words = [w for w in words if w[0] != "\n"]
        marked = [w for w in words if w[-1] in _MARKS and w[:-1].isalpha()]
        whole = set(words).difference(marked)
        whole.update({w[:-1] for w in marked}.difference(self.cache))
        self._learn(list(whole))
        if marked:
            marks = dict(zip(_MARKS, (x.tobytes() for x in self._encode(list(_MARKS)))))
            get = self.cache.__getitem__
            self.cache.update([(w, get(w[:-1]) + marks[w[-1]]) for w in marked])

    def _slow(self, text: str) -> np.ndarray:
        """A text with runs of white space or with an added token."""
        if any(t in text for t in self.added):
            return self._encode([text])[0]
        parts = _CUT.split(text)
        ids = self._encode([parts[0], *[" " + w for w in parts[1:]]])
        return np.concatenate(ids)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has; a null text has none.

        Words are split, and equal ones found, by Arrow; Python sees each different word of the batch once. A line feed
        within a word begins another one, that holds it, so that a line's last word and the next one's first are not one.
        """
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts if self.feed is None else pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        rest = coded.dictionary if self.feed is None else pc.replace_substring(coded.dictionary, "\n", "")
        uneven = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(rest), rest), pc.equal(rest, ""))
        for token in self.added:
            uneven = pc.or_(uneven, pc.match_substring(coded.dictionary, token))
        uneven = uneven.to_numpy(zero_copy_only=False)
        pieces = list(map(self.cache.get, words))
        missing = [i for i, p in enumerate(pieces) if p is None]
        if self.older:
            for i in missing:
                if (p := self.older.get(words[i])) is not None:
                    pieces[i] = self.cache[words[i]] = p
            missing = [i for i in missing if pieces[i] is None]
        odd = set(np.flatnonzero(uneven).tolist())
        missing = [i for i in missing if i not in odd] if odd else missing
        self._learn_all([words[i] for i in missing])
        for i in missing:
            pieces[i] = self.cache[words[i]]
        for i in odd:
            pieces[i] = b""
        # Each text's first word follows no space: it has an entry of its own behind the words, as a slow text has.
        firsts, n = offsets[:-1], len(words)
        slow = np.zeros(len(texts), bool)
        if odd:
            slow = np.add.reduceat(uneven[at], firsts) > 0
            at = np.where(np.repeat(slow, np.diff(offsets)), n + len(texts), at)
        heads = self._encode([w if not s else "" for w, s in zip((words[i] if i < n else "" for i in at[firsts]), slow)])
        pieces += [self._slow(texts[i].as_py()).tobytes() if slow[i] else h.tobytes() for i, h in enumerate(heads)]
        pieces.append(b"")
        at[firsts] = n + np.arange(len(texts))
        taken = pa.array(pieces, pa.large_binary()).take(pa.array(at))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(at) + 1] // self.dtype.itemsize
        out = np.frombuffer(taken.buffers()[2] or b"", self.dtype)[: ends[-1]]
        if len(self.cache) > self.cache_words // 2:
            self.older, self.cache = self.cache if len(self.cache) <= self.cache_words else {}, {}
        return out, np.diff(ends[offsets])

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each whole text; a null text has none."""
        ids, sizes = self.encode_array(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []


def encoder(path: str, cache_words: int = CACHE_WORDS) -> BytePairEncoder:
    """One encoder per Python worker and tokenizer file; the last caller says what it may keep."""
    common.claim("tokens")
    if path not in _LOADED:
        _LOADED[path] = BytePairEncoder(path, cache_words)
    _LOADED[path].cache_words = cache_words
    return _LOADED[path]


def default_tokenizer() -> str:
    """Place of the public 50k byte-level BPE; a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
