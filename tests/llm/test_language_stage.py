"""The pipeline's language stage: the model decides, not the letter check."""

import corpus_pipeline

JUNK = ["xqz kkvw 9x", "日本語の文章です", "Ελληνικά κείμενο για δοκιμή", "asdkjh qwlekj zmxncb qpwoei"]


def test_model_rejects_and_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 4 = 0").select(*corpus_pipeline.DOCUMENT_COLUMNS)
    junk = spark.createDataFrame([(-i - 1, t, None, "s", len(t)) for i, t in enumerate(JUNK)], docs.schema)
    wrong = docs.filter("lang = 'de' and length(text) > 500 and doc_id % 5 = 0").selectExpr("-1000 - doc_id as doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_stage(spark, docs.union(junk).union(wrong), "").select("doc_id", "lang").collect()}
    assert not any(-i - 1 in got for i in range(len(JUNK)))
    relabelled = [r["doc_id"] for r in wrong.select("doc_id").collect()]
    assert relabelled and sum(got.get(i) == "de" for i in relabelled) > 0.98 * len(relabelled)
    clean = {r["doc_id"]: r["lang"] for r in docs.filter("text rlike '[A-Za-z]'").collect()}
    assert clean.keys() <= got.keys()
    assert sum(got[i] == lang for i, lang in clean.items()) > 0.98 * len(clean)
