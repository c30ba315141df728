"""SentencePiece coder against the library: ids, byte spans, decoding, normalisation, edge cases."""

import hashlib
import random

import pytest
import sentencepiece

from lotweave.llm import pieces, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def coder():
    return pieces.coder(pieces.default_model())


def odd_texts(n=1500):
    rng = random.Random(3)
    letters = list(" \t\n  ▁abcdeéßЖ中梦‍😀�\x00́<s>0x41") + ["龘", "hello", " the"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_spans_and_text_equal_the_library(library, coder):
    texts = [*odd_texts(), "", " ", "  ", "▁", "<unk>", "<s>a</s>", "x" * 3000, "中" * 500 + " " * 70 + "end"]
    for text, (ids, starts, ends) in zip(texts, coder.encode_all(texts)):
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want], text
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want], text
        assert coder.decode(ids.tolist()) == library.decode(ids.tolist()) == text.replace(pieces.SPACE, " ")


def test_long_texts_are_cut_at_words_only(library, coder, monkeypatch):
    text = " ".join(odd_texts(300))
    whole = coder.encode(text)
    monkeypatch.setattr(pieces, "TEXT_HELD", 50)
    cut = coder.encode(text)
    assert all((a == b).all() for a, b in zip(whole, cut)) and whole[0].tolist() == library.encode(text)


def test_any_ids_decode_as_the_library_does(library, coder):
    rng = random.Random(5)
    some = [0, 1, 2, 3 + 0xE2, 3 + 0x96, 3 + 0x81, 259, 260]
    for _ in range(1500):
        ids = [rng.choice([*some, 3 + rng.randrange(256), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 9))]
        assert coder.decode(ids) == library.decode(ids), ids
    assert coder.decode([-1, 99_999_999]) == ""


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("less", [False, True])
def test_normalisation_by_a_compiled_map(rule, less):
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=less)
    spec = dict(pieces.message(next(v for f, v in pieces.message(made.serialized_model_proto()) if f == 3)))
    model = object.__new__(pieces.Model)
    model.charmap, model.space = pieces.CharacterMap(spec[2]), pieces.SPACE
    model.dummy_prefix, model.less_space = bool(spec.get(3, 1)), bool(spec.get(4, 1))
    rng = random.Random(7)
    letters = list("  aÁé́̈ａＢ①㌔ﬁ½ 　ÀE​ß\tİ한글")
    for _ in range(600):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        plain, source = pieces.normalize(model, text)
        want, offsets = made.normalize(text, with_offsets=True)
        at = [len(text[:i].encode()) for i in range(len(text) + 1)]
        assert plain == want and source.tolist() == [at[i] for i in offsets], text


def test_one_word_at_a_time_gives_the_same(coder):
    words = sorted({w for t in odd_texts(200) for w in t.replace(" ", "▁").split("\t") if w}, key=len)
    assert coder.words.merger.merge(words) == [pieces.np.array(pieces.merged(coder.model, w), pieces.np.int32).tobytes() for w in words]


def test_query_equals_the_library_on_every_text(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op12_pieces(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "")
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert mine["source_bytes"] == len((r["text"] or "").encode())


def test_tables_with_nulls_repeats_and_clashing_names(spark):
    long = "word " * 300_000
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("starts", pieces.F.lit(0))
    got = pieces.encode(docs).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and by_id[None]["ids"] == [] == by_id[2]["ids"]
    assert by_id[3]["ends"][-1] == len(long) and by_id[1]["starts"] == [0, 1]
    texts = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs)).collect()}
    assert texts == {1: "a b", None: "", 2: "", 3: long}
    assert pieces.round_trip(docs.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(nothing).collect()[0]["text"] == ""
