import corpus_pipeline
from tests.llm.test_operators import brute_components, check_packing

from pyspark.sql import functions as F

from inkwell.llm import common, decontaminate, packing, quality, tokens


def test_pipeline_equals_stage_by_stage(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    kept = {r.doc_id for r in quality.query(spark, sf_dir).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    texts = {i: texts[i] for i, (_, first) in brute_components(texts, 5, 80, 100).items() if first == i}
    bad = {r.doc_id for r in decontaminate.query(spark, sf_dir).where("contaminated").collect()}
    texts = {i: t for i, t in texts.items() if i not in bad}
    assert check_packing(corpus_pipeline.run(spark, sf_dir).collect(), texts) < 0.02


def test_stages_keep_columns_and_clean_rows(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert out.count() > 0.5 * docs.count()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 4


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls in every column, repeated rows, empty texts, clashing column names and no rows at all, stage by stage."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 3), (2, text, None, None, None), (2, text, None, None, None), (None, text, "en", "a", 1), (None, None, None, None, None), (3, "", "en", "a", 0), (4, None, "en", "a", 0), (5, text + " ".join(f" own{i}" for i in range(40)), "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit("x") for n in ("id", "component", "key", "label", "a", "b", "set", "item_id", "my col.x")})
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, sf_dir), stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0 and none.columns == out.columns
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, None}
            continue
        assert out.columns == docs.columns
        if name == "near_duplicates":
            got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
            # Of the copies the smallest id stays; rows without an id are linked with nothing.
            assert got == sorted(((r[0], r[1]) for r in rows if r[0] != 2), key=repr)


def test_packing_holds_little(spark, sf_dir):
    """The last stage shares executors with the heap of those before: small batches and a small cache, the same pieces."""
    docs = common.table(spark, sf_dir, "documents")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    got = key(corpus_pipeline.pack(spark, docs, sf_dir))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    whole = packing.pack_documents(docs, length=2048, end_id=1)
    columns = ["key", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset"]
    assert got == key(whole.select(*columns)) == key(packing.pack_documents(docs, batch_docs=7, cache_words=50).select(*columns))
    encoder = tokens.encoder(tokens.default_tokenizer(), 1000)
    encoder.cache, encoder.older = {}, {}
    for k in range(20):
        encoder.encode_batch([" ".join(f"w{k}x{i}" for i in range(300))])
        assert len(encoder.cache) + len(encoder.older) <= 1600
