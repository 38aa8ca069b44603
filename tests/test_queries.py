import collections
import re
import time

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from inkwell import registry
from inkwell.functions import text as X
from inkwell.operators import catalog as C


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_whole(name, spark, sf_dir):
    assert len(registry.QUERIES[name](spark, sf_dir).toPandas()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def brute_keywords(text, k=5):
    text = re.sub(r"(?s)```.*?```", " ", text)
    text = re.sub(r"https?://[^ \t\n\x0b\f\r]+", " ", re.sub(r"`[^`]*`", " ", text))

    def tokens(x):
        return [t for t in (re.sub(r"^[.\-]+|[.\-]+$", "", w) for w in re.findall(r"[a-z0-9][a-z0-9+#.-]*", x.lower())) if t]

    heads = {t for line in text.split("\n") if re.match(r"[ \t\x0b\f\r]{0,3}#{1,6}[ \t\x0b\f\r]", line) for t in tokens(line)}
    n = collections.Counter(t for t in tokens(text) if len(t) >= 3 and t not in X.stop_words() and not re.fullmatch("[0-9]+", t))
    scores = {t: c + 3 * (t in heads) for t, c in n.items()}
    # The collation's order of the characters that terms are made of.
    return sorted(scores.items(), key=lambda x: (-x[1], ["-.#+0123456789abcdefghijklmnopqrstuvwxyz".index(c) for c in x[0]]))[:k]


def test_keywords_equal_brute_force(spark, sf_dir, tmp_path):
    """On the documents, and on texts whose terms hold marks."""
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "source", "text"]).to_pylist()
    marked = ["node.js utf-8 e-mail node.js c++ utf-8 c#. asp.net", "a.b-c a+bc a#bc a.bc a-bc abc a1bc", "x--y x..y ...xyz--- v1.2.3 v1.2.3", "`node.js` http://a.b/c-d ```e-f``` g-h.i"]
    docs += [{"doc_id": -1 - i, "source": "my-source.io", "text": t} for i, t in enumerate(marked)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.defaultdict(list)
    for r in sorted(registry.QUERIES["keywords"](spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.place)):
        got[r.doc_id].append((r.term, r.score))
    for d in docs:
        want = [] if d["text"] is None or d["source"] is None else brute_keywords(f"# {d['source']}\n{d['text']}")
        assert got[d["doc_id"]] == want


def test_keywords_of_a_long_text_take_linear_time(spark):
    """20,000 different terms in one text: seconds, not hours."""
    terms = [f"w{i}x" for i in range(20_000)]
    long = spark.createDataFrame([(1, "# " + " ".join(terms[:3000]) + "\n" + " ".join(terms + terms[-4:]))], "doc_id long, markdown string")
    began = time.time()
    got = [(r.place, r.term, r.score) for r in C.keywords(long).orderBy("place").collect()]
    # Headed terms stand in the heading and in the text, and count three more.
    assert got == [(p + 1, t, 5) for p, t in enumerate(sorted(terms[:3000])[:5])]
    assert time.time() - began < 60
