import corpus_pipeline
from strandwork.llm import simhash
from tokenizers import Tokenizer

from . import test_decontaminate, test_secret_scan
from .test_near_copies import survivors

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = survivors([(i, r.text) for i, r in rows.items() if any(map(str.isalpha, r.text or ""))])
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for d, *_ in test_decontaminate.brute([(i, rows[i].text) for i in sorted(kept)], items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == kept - leaked and leaked
    library = Tokenizer.from_file(corpus_pipeline.vocabulary_path())
    for i, r in got.items():
        if not any(test_secret_scan.brute(rows[i].text)[:3]):
            assert r.ids == library.encode(rows[i].text, add_special_tokens=False).ids


def test_deduplicated_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(3, text, "en", "a", 1), (3, text, "en", "a", 1), (2, text + " more", "en", "b", 2), (None, text, "en", "c", 3), (None, None, None, None, None), (None, None, None, None, None), (7, "", "en", "a", 0), (8, "other words here now then", "en", "a", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.source) for r in got.collect()) == [(2, "b"), (7, "a"), (8, "a")]
    assert simhash.deduplicated(docs.limit(0)).count() == 0
    twice = simhash.deduplicated(docs.where("doc_id = 3")).collect()
    assert len(twice) == 1


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_columns_named_like_inner_ones_are_harmless(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1, 5, 6, 7, 8), (2, words + " x", "en", "a", 1, 5, 6, 7, 8), (3, "some other words stand here", "en", "a", 1, 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, DOCS + ", node int, of int, marked int, `place.id` int")
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
