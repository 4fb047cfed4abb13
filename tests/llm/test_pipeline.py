"""The pipeline against a plain version of its stages, and the corpus queries against SQL."""

import hashlib
import os
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import decontaminate, line_dedup, ngram_join, queries
from tests.llm.test_corpus import near_copies, plain_components, plain_hits, plain_line_dedup


CLASHING = ["score", "Lang_Pred", "n_lines", "kept_text", "n_removed_chunks", "n_words", "hit_spans", "ids", "row", "decoded", "cut"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Clashing columns, null and repeated ids, repeated rows, long texts; and empty tables."""
    long = " ".join(f"w{k}" for k in range(400))
    texts = [(1, "plain words of a document"), (None, "other words without an id"), (None, "other words without an id"), (1, "the same id and new words"), (2, None), (None, None), (3, ""), (4, long), (5, long), (5, "y" * 200_000), (6, "12 ½")]
    rows = [(d, t, "en" if t and t[0] in "po" else None, "s", 1, *["own"] * len(CLASHING)) for d, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in CLASHING)
    spark.createDataFrame([(1, "bench " * 12)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    full = spark.createDataFrame(rows, schema)
    for docs, want in ((full, 5), (full.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == full.columns
                assert all(set(r) <= {"own"} for r in docs.select(*CLASHING).collect())
        assert docs.count() == want


def test_pipeline_equals_plain(spark, tmp_path):
    import public_tokenizers

    rng = random.Random(5)
    item = " ".join(f"bench{k}" for k in range(14))
    texts = [t for _, t in near_copies(rng, 60)] + [f"some text before {item} and then " + "more plain words follow here " * 4, item, None, "12 34", ""]
    texts += ["\n".join(f"shared line {k} with quite a few words in it" for k in range(12)) + f"\nown ending {d}" for d in range(3)]
    rows = [(d, t, "en", "s", len(t or ""), *["own"] * len(CLASHING)) for d, t in enumerate(texts)]
    extra = "".join(f", {c} string" for c in CLASHING)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = [(d, t) for d, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    kept = plain_line_dedup(docs)
    docs = [(d, kept[d]) for d, t in docs if kept[d].strip() or kept[d] == t]
    root = plain_components(docs, 5, 80)
    docs = [(d, t) for d, t in docs if root[d][1] == d]
    lib, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for d, t in docs:
        words = decontaminate.words_of(t.encode())
        hit, _ = plain_hits(words, [decontaminate.words_of(item.encode())], 10)
        if sum(hit) > 0.5 * len(words):
            continue
        if any(hit):
            t = t.replace(item, "")
        want[d] = (len(lib.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest())
    assert got == want


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_corpus_query_equals_sql(spark, name):
    import duckdb

    from tests.test_queries import plain

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    assert plain(queries.queries()[name](spark, SF).toPandas()) == plain(con.execute(queries.oracle_sql()[name]).df())


def test_modules_are_used():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    assert (ngram_join.WORDS, ngram_join.PERCENT) == (5, 80) and line_dedup.MIN_WORDS == 0
