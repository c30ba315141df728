"""Scores of the learned operators, written out plainly row by row from what was learnt."""

import math
import re

import numpy as np
import pytest
import zstandard

from lotweave.llm import language, quality, queries, toxicity, urls

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{MORE}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{MORE}/labels.parquet")


@pytest.fixture(scope="module")
def some(spark, docs):
    """A hundred documents and odd ones."""
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").limit(100).collect()]
    odd = [(-1, None), (-2, ""), (-3, "   "), (None, rows[0][1]), (-4, "x" * 300_000), (-5, rows[1][1]), (-5, rows[1][1])]
    return spark.createDataFrame([(*r, "junk") for r in rows + odd], "doc_id long, text string, severity string")


def by_text(rows, *names):
    return sorted((repr(r["doc_id"]), *(r[n] for n in names)) for r in rows)


def test_toxicity_by_plain_sums(docs, labels, some):
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.words, model.weights.tolist()))
    want = []
    for r in some.collect():
        words = set(re.findall(r"[^\W\d_]+", (r["text"] or "").lower()))
        words |= {w[:n] + "-" for n in (4, 5, 6) for w in list(words) if len(w) > n and not w.endswith("-")}
        total = sum(weight.get(w, 0.0) for w in words)
        below = [1 / (1 + math.exp(-(c - total))) for c in model.thresholds] + [1.0]
        shares = [b - a for a, b in zip([0.0, *below], below)]
        want.append((repr(r["doc_id"]), sum(k * p for k, p in enumerate(shares)), max(range(len(shares)), key=lambda k: (shares[k], -k))))
    got = by_text(toxicity.severity(some, model).collect(), "severity", "grade")
    for a, b in zip(sorted(want), got, strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 and a[2] == b[2]


def test_language_by_plain_kernels(docs, some):
    model = language.fit(docs)
    width = sum(model.sizes)
    lists = [np.flatnonzero(row) for row in model.landmarks]
    want = []
    for r in some.collect():
        text = r["text"]
        if text is None or not any(c.isalpha() for c in text):
            want.append((repr(r["doc_id"]), "und", 0.0))
            continue
        known = sorted({int(model.slots[g]) for found in language.grams(text) for g in found.tolist()} - {width})
        limits = np.cumsum([0, *model.sizes])
        counts = [sum(lo <= k < hi for k in known) for lo, hi in zip(limits, limits[1:])]
        value = {k: 1 / math.sqrt(max(1, counts[int(np.searchsorted(limits, k, "right")) - 1])) / math.sqrt(len(model.sizes)) for k in known}
        kernel = [sum(value.get(int(k), 0.0) * float(row[k]) for k in places) for row, places in zip(model.landmarks, lists)]
        raw = [sum(k * float(w) for k, w in zip(kernel, column)) for column in model.weights.T]
        e = [math.exp(model.sharpness * (x - max(raw))) for x in raw]
        best = max(range(len(raw)), key=lambda k: (raw[k], -k))
        want.append((repr(r["doc_id"]), model.languages[best], e[best] / sum(e)))
    got = by_text(language.predict(some, model).collect(), "lang_pred", "score")
    for a, b in zip(sorted(want), got, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3


def test_quality_by_plain_sizes(docs, labels, some):
    model = quality.fit(docs, labels)
    want = []
    for r in some.collect():
        text = (r["text"] or "").encode()
        good, bad = (
            len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_dict_id=False).compress(text))
            for d in (model.good, model.bad)
        )
        size = len(text) + 16
        parts = [20 * (bad - good) / (good + bad), 4 * good / size, 4 * bad / size, 4 * (good / size) ** 2, 20 * (bad - good) / size, 0.2 * math.log(size), 1.0]
        want.append((repr(r["doc_id"]), 1 / (1 + math.exp(-sum(w * x for w, x in zip(model.weights, parts))))))
    got = by_text(quality.score(some, model).collect(), "score")
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(sorted(want), got, strict=True))


def test_quality_ties_at_the_threshold(spark, docs, labels):
    few = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    half = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    same = quality.judge(few, half, threshold=1.0).collect()  # one label only: every score is its share, 1
    assert {(r["score"], r["predicted"]) for r in same} <= {(1.0, 1), (0.5, 0)}


def plain_rule(url):
    url = url or ""
    at = url.find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_url_verdicts_of_all_pages(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op8_urls(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule = plain_rule(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        assert r["verdict"] == (rule[1] if rule else "block" if r["block_score"] > 0.5 else "allow")
        assert (r["block_score"] is None) == bool(rule)


def test_url_shares_leave_out_a_row_s_own_half(spark):
    rows = spark.createDataFrame([(f"https://a{i}.x.net/", "net", float(i % 2)) for i in range(40)] + [("https://b.y/", "y", 1.0)], "url string, suffix string, blocked double")
    got = {r["suffix"]: r for r in urls.suffix_shares(rows, "suffix", 0.5).collect()}
    one = got["y"]
    mine = "half0" if rows.select(urls.fold_of(urls.F.lit("https://b.y/"))).first()[0] == 0 else "half1"
    assert one[mine] == 0.5 and one["all"] > 0.5  # its own half knows nothing of the label
    assert abs(got["net"]["all"] - 0.5) < 1e-9
