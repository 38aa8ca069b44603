"""Operators 11 to 13 against brute-force versions, on the small tables and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import bpe, common, runs, whitening
from tests.llm.test_operators import ODD, odd  # noqa: F401


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder(bpe.default_tokenizer())


def library(coder, text):
    ids = coder.tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, coder.tokenizer.decode(ids, skip_special_tokens=False)


# 11


def brute_whitening(vectors, k):
    """n, deviations, whitened rows, explained shares, from one matrix."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ v / np.sqrt(e), e / (centred**2).sum() * n


def close_up_to_sign(got, want):
    signs = np.sign((got * want).sum(axis=0))
    return np.abs(got * signs - want).max() < 1e-9


def test_whitening_equals_one_decomposition(spark, sf_dir):
    got = whitening.query(spark, sf_dir).toPandas()
    table = common.table(spark, sf_dir, "embeddings").toPandas()
    n, deviation, whitened, explained = brute_whitening(table.embedding.to_list(), 16)
    assert len(got) == 16 * len(table) and set(got.n) == {n}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    assert close_up_to_sign(wide, whitened)
    first = got[got.component == 1].set_index("vec_id").loc[table.vec_id]
    assert first.deviation.to_list() == deviation.tolist()
    shares = got[got.vec_id == table.vec_id[0]].sort_values("component").explained.to_numpy()
    assert np.allclose(shares, explained, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_merged_states_are_those_of_all_rows():
    r = np.random.default_rng(5)
    rows = r.integers(-60, 60, (300, 7)) + np.array([1_000_000, 0, 0, 5, 0, 0, -9])
    rows[:, 3] = rows[:, 4]  # a component without variance
    whole, parts = whitening.State.of(rows), [whitening.State.of(rows[a:b]) for a, b in ((0, 1), (1, 3), (3, 120), (120, 300))]
    tree = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    assert (tree.n, tree.sums) == (300, rows.sum(axis=0).tolist())
    e, v, real = tree.components()
    assert real.tolist() == [True] * 6 + [False]
    gap = rows - rows.mean(axis=0)
    assert np.allclose((v.T * e) @ v, gap.T @ gap / 300, atol=1e-8)
    assert np.allclose(e, whole.components()[0], atol=1e-8)
    again = whitening.State.read(*tree.row(3)[1:])
    assert again.sums == tree.sums and (again.v == tree.v).all()


def test_a_tree_of_many_states(spark):
    r = np.random.default_rng(6)
    vectors = r.normal(size=(400, 5)).astype(np.float32).astype(float).round(4).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(70)
    rows = whitening.integers(df, "embedding", 64).repartition(70)
    state = whitening.fit(rows, 5, common.shared_dir(spark, "test"))
    x = np.floor(64 * np.array(vectors)).astype(np.int64)
    assert (state.n, state.sums) == (400, x.sum(axis=0).tolist())
    assert np.allclose(state.components()[0], np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1])


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, [1.0]), (7, []), (None, [2.0, 3.0]), (1, [0.0, 1.0]), (8, [1.0, 2.0]), (9, [1e12, 2.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, key int, x string")
    got = {(r.key, tuple(r.whitened), r.n, r.deviation) for r in whitening.whiten(df).collect()}
    assert sorted((k is not None, k) for k, *_ in got if k) == [(True, 1), (True, 8), (True, 9)] and len(got) == 4
    assert {n for _, _, n, _ in got} == {4}
    s = [sum(int(np.floor(64 * v[d])) for v in ([0, 1], [2, 3], [1, 2], [1e12, 2])) for d in (0, 1)]
    want = (4 * 0 - s[0]) ** 2 + (4 * 64 - s[1]) ** 2
    assert next(d for k, _, _, d in got if k == 1) == (want if want < 1 << 63 else None)
    # One vector, and equal ones: no component has variance.
    for count in (1, 3):
        r = whitening.whiten(df.where("vec_id = 8").limit(1).crossJoin(spark.range(count))).collect()
        assert len(r) == count and r[0].whitened == [None, None] and r[0].identity_error is None and (r[0].n, r[0].deviation) == (1, 0)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 2")).count() == 0


# 12


def test_encoder_equals_the_library(coder):
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz'éßσΣςÉİK0123\n\t.,!<|>- ́ \x1c\x85日本語한국𝒜"
    texts = [*ODD, None, "a<|endoftext|>B<|startoftext|>", "<|endoftext|><|endoftext|>", "<|EndOfText|> <|", "I'LL we'Ve 'S''s", "ÀÀ"]
    texts += ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(r.choices("ab", k=40)) for _ in range(500)] + [w * n for w in ("a", "ha", "the") for n in range(1, 60)]
    ids, sizes = coder.encode_array(pa.array(texts))
    decoded = coder.decode_array(ids, sizes)
    for text, got, back in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), decoded):
        want, said = library(coder, text)
        assert got.tolist() == want and back.decode() == said, repr(text)[:80]


def test_every_code_point(coder):
    points = [chr(c) for c in range(0x3000)] + [chr(c) for c in range(0x3000, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b" for c in points]
    ids, sizes = coder.encode_array(pa.array(texts))
    want = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(g.tolist() == w.ids for g, w in zip(np.split(ids, np.cumsum(sizes)[:-1]), want))


def test_pairs_and_backtracking(coder):
    """The compatible pairs are those that the library leaves apart; single pieces go the same way as many at once."""
    r = random.Random(4)
    plain = set("abcdefghijklmnopqrstuvwxyz")
    inner = [i for i, s in coder.text.items() if set(s) <= plain]
    last = [i for i, s in coder.text.items() if ord(s[-1]) >= 256 and set(s[:-1]) | {chr(ord(s[-1]) - 256)} <= plain]
    pairs = [(r.choice(inner), r.choice(last)) for _ in range(3000)]
    good = coder.compatible(*np.array(pairs).T)
    assert good.any() and not good.all()
    for (a, b), ok in zip(pairs, good):
        s = coder.text[a] + coder.text[b]
        word = s[:-1] + chr(ord(s[-1]) - 256)
        assert ok == (library(coder, word)[0] == [a, b]) == coder._fits(a, b)
    words = ["".join(r.choices("abcdeinorst", k=r.randint(1, 60))) for _ in range(300)]
    raw = [w[:-1] + chr(ord(w[-1]) + 256) for w in words]
    for word, got in zip(words, coder._backtrack_all(raw)):
        assert got.tolist() == library(coder, word)[0]


def test_bpe_query(spark, sf_dir, coder):
    docs = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    got = bpe.query(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids, said = library(coder, docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_bpe_of_odd_rows(spark, odd, coder):  # noqa: F811
    out = bpe.encode_texts(odd)
    got = sorted(((r.key, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()), key=repr)
    want = []
    for r in odd.collect():
        ids, said = library(coder, r.text)
        want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), said))
    assert got == sorted(want, key=repr)
    back = sorted(((r.key, r.decoded) for r in bpe.decode_texts(out).collect()), key=repr)
    assert back == sorted(((k, d) for k, _, _, d in want), key=repr)
    assert bpe.encode_texts(odd.limit(0)).count() == 0


# 13


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_planted(doc_id, text):
    words = common.to_bytes(text).split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_equal_brute_force():
    r, texts = random.Random(3), []
    for _ in range(600):
        n, k = r.randint(0, 120), r.choice([1, 2, 2, 3, 5, 50])
        words = [b"%d" % r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.5:
            a, p = r.randrange(n), r.randint(1, 1 + n // 3)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        texts.append(words)
    for least in (2, 7, 12, 13):
        for words, got in zip(texts, runs.find_runs(texts, least)):
            assert sorted((s, n, q) for s, n, q in got.tolist()) == brute_runs(words, least)


def test_masking_keeps_every_run_and_drops_far_repeats():
    passage = [b"p%d" % i for i in range(30)]
    text = passage + [b"x%d" % i for i in range(100)] + passage + [b"a", b"b"] * 8
    named = np.unique(np.array(text), return_inverse=True)[1].astype(np.int64)
    # The passage repeats, but nothing in it does: only the run is left after the second masking.
    assert runs.surviving(named, np.zeros(len(text), np.int64), 12) == [(160, 176)]


def test_runs_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    got = runs.query(spark, sf_dir).collect()
    assert len(got) == len(docs) and any(r.n_runs for r in got)
    for r in got:
        words = brute_planted(r.doc_id, docs[r.doc_id])
        if len(words) > 3000:
            continue
        want = brute_runs(words)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.n_runs == len(want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(want, key=lambda x: (x[0], x[2]))).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        n, s, q = min(((-n, s, q) for s, n, q in want), default=(None, None, None))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((s, -n, q, 1000 * -n // q) if want else (None,) * 4)


def test_runs_of_odd_rows(spark, odd):  # noqa: F811
    got = sorted(((r.key, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(odd).collect()), key=repr)
    want = []
    for r in odd.collect():
        words = common.to_bytes(r.text).split()
        found = brute_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((r.doc_id, len(words), found, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert got == sorted(want, key=repr)
    assert runs.periodic_runs(odd.limit(0)).count() == 0
    planted = {r.key: r.text for r in runs.planted(odd).collect()}
    assert planted[None] in ("no id", None)
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, least=1)


def test_a_very_long_text():
    r = random.Random(9)
    words = [b"w%d" % r.randrange(5000) for _ in range(120_000)]
    words[50_000:110_000] = [words[50_000 + i % 7001] for i in range(60_000)]
    got = runs.find_runs([words, [], words[:30]])
    assert (50_000, 60_000, 7001) in {tuple(x) for x in got[0].tolist()} or any(s <= 50_000 and s + n >= 110_000 and q == 7001 for s, n, q in got[0].tolist())
    assert not len(got[1]) and not len(got[2])
