import public_tokenizers
from test_decontaminate import brute as overlaps
from test_linededup import brute as removed
from test_minhash import brute as links
from test_minhash import classes
from tokenizers import Tokenizer

import corpus_pipeline
from memlake.llm import quality

SF = "/root/testdata/sf0.001"


def test_each_stage_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    first = docs.collect()
    q = corpus_pipeline.quality_stage(spark, docs, SF)
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    now = sorted(q.collect(), key=lambda r: r["doc_id"])
    assert q.columns == columns and [r["doc_id"] for r in now] == sorted(r["doc_id"] for r in first if scores[r["doc_id"]]) and 150 < len(now) < 200

    df = corpus_pipeline.line_stage(spark, spark.createDataFrame(now, docs.schema), SF)
    then = sorted(df.collect(), key=lambda r: r["doc_id"])
    assert df.dtypes == docs.dtypes and [r["doc_id"] for r in then] == [r["doc_id"] for r in now]
    for before, after, gone in zip(now, then, removed([(r["doc_id"], r["text"]) for r in now]), strict=True):
        assert after["text"] == "\n".join(x for k, x in enumerate(before["text"].split("\n")) if k not in gone) and after["n_chars"] == len(after["text"]) and after["source"] == before["source"]

    df = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(then, docs.schema), SF)
    alone = sorted(df.collect(), key=lambda r: r["doc_id"])
    named = classes(links({r["doc_id"]: r["text"] for r in then})[1])
    assert df.columns == columns and [r["doc_id"] for r in alone] == sorted(i for i, c in named.items() if i == c)

    df = corpus_pipeline.benchmark_stage(spark, spark.createDataFrame(alone, docs.schema), SF)
    clean = sorted(df.collect(), key=lambda r: r["doc_id"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _ in overlaps([(r["doc_id"], r["text"][:20000]) for r in alone], items)}
    assert df.columns == columns and [r["doc_id"] for r in clean] == [r["doc_id"] for r in alone if r["doc_id"] not in bad] and len(clean) < len(alone)

    pieces = corpus_pipeline.packing_stage(spark, spark.createDataFrame(clean, docs.schema), SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for r in pieces:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in clean}
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
