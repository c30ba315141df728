"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import pytest

import corpus_pipeline
from lotweave.llm import bpe, language, minhash, mixing, pstable, quality, simhash, surrogates, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, ids string, label string, rep long"
LONG = "long words stand here " * 6000


def rows():
    texts = [None, "", "   ", "...", "one", "Den Wald der Stadt", "Den Wald der Stadt", LONG, "the cat of the town\n" * 3, "日本 text 😀", "x" * 30000]
    out = [(i, t, ["de", "en", None][i % 3], ["a", None][i % 2], None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(3, "...", "en", "a", 3), (4, "another text under one id", "en", "a", 25), (None, "no id at all", "de", None, None), (None, None, None, None, None)]
    return [(*r, 0.5, "f", "i", "l", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    known = [(i, i % 2, (i + 1) % 2) for i in range(9)] + [(2, 1, 1), (None, 1, 0), (5, None, None), (77, 1, 1)]
    return spark.createDataFrame(known, "doc_id long, quality int, toxic int").cache()


OPERATORS = {
    "simhash": lambda d, l: simhash.near_duplicates(d),
    "toxicity": toxicity.grade,
    "language": lambda d, l: language.identify(d),
    "surrogates": lambda d, l: surrogates.replaced(d),
    "bpe": lambda d, l: bpe.round_trip(d),
    "minhash": lambda d, l: minhash.near_edits(d),
    "minhash_alone": lambda d, l: minhash.fingerprints(d),
    "quality": quality.judge,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    assert len(got) == len(rows())
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality", "language"])
def test_nothing_to_learn_from(docs, labels, name):
    bare = docs.drop("lang").selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert OPERATORS[name](bare, labels.limit(0)).count() == len(rows())


def test_mixing_keeps_columns_and_refuses_clashes(docs):
    got = mixing.replicate(docs, {"a": 5.0})
    assert got.columns == [*docs.columns, "mix_rate", "mix_copy", "mix_key"]
    assert got.count() > 0 and mixing.replicate(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.replicate(docs.withColumnRenamed("label", "mix_copy"))


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert pstable.search(none, none).count() == 0


def test_odd_urls(spark):
    odd = ["http://x.net/a", "http://b.example.net/en/1", None, "", "no scheme", "http://", "a://B.ORG/fr/x?y#z", "http://h?q=1", "http://org", "x" * 9000]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(odd)] + [(None, "http://x.net/a", "h", 1)], "page_id long, url string, host string, fit int")
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert len(got) == len(odd) + 1
    assert [got[i]["host"] for i in range(len(odd))] == ["x.net", "b.example.net", "", "", "", "", "b.org", "h", "org", ""]
    assert [got[i]["path"] for i in range(len(odd))] == ["/a", "/en/1", "", "", "", "", "/fr/x", "", "", ""]
    assert [got[i]["rule"] for i in range(len(odd))] == ["net/", "example.net/en/", None, None, None, None, "org/fr/", None, None, None]
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert urls.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, stage):
    got = stage(spark, docs, "")
    last = stage is corpus_pipeline.token_stage
    assert got.columns == (["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if last else list(corpus_pipeline.DOCUMENT_COLUMNS))
    assert got.count() > 0 and stage(spark, docs.limit(0), "").count() == 0
