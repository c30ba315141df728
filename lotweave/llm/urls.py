"""URL filter: host and path rules, and gradient-boosted trees on lexical features beyond them.

Rules block or allow a host with its subdomains, from a path prefix on; the longest that fits wins.
URLs that a rule fits are the labelled ones.  The trees learn from their length, depth, digit ratio,
entropy, parameter counts and the blocked share of their host suffixes, and judge the rest.  A training
URL's shares come from the other half of the labelled URLs, which its own label is not in.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.llm.common import stored, uniform

#: (verdict, host, path): fixed values of the filter's task.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
TRAINING = 20_000  # labelled URLs that the trees are fitted on, chosen by a hash
TREES, DEPTH = 12, 4
PRIOR = 20.0  # URLs' worth of the overall share in a suffix's share
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "n_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters",
    "query_chars", "fragment", "secure", "suffix_share", "domain_share",
)


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to `?`, `#` or the end; empty for no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: str, path: str) -> Column:
    under = (F.col("host") == host) | F.col("host").endswith("." + host)
    return under & F.col("path").startswith(path)


def rule_of(rules: Iterable[tuple[str, str, str]]) -> Column:
    """The longest rule that fits columns host and path, as struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        out = F.when(_fits(host, path), F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(urls: DataFrame) -> DataFrame:
    """Columns host, path, suffix and domain, and the lexical features, of column url."""
    text = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))

    def times(of: Column, sign: str) -> Column:
        return (F.length(of) - F.length(F.replace(of, F.lit(sign), F.lit("")))).cast("double")

    share = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: F.when(c != "", (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n).otherwise(0.0),
    )
    entropy = F.aggregate(share, F.lit(0.0), lambda sum_, p: sum_ - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    return urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "domain": F.substring_index("host", ".", -2),
        "n_chars": F.length(text).cast("double"),
        "host_chars": F.length("host").cast("double"),
        "path_chars": F.length("path").cast("double"),
        "depth": times(F.col("path"), "/"),
        "labels": times(F.col("host"), "."),
        "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / n,
        "hyphens": times(text, "-"),
        "entropy": entropy,
        "parameters": F.when(query != "", times(query, "&") + 1).otherwise(0.0),
        "query_chars": F.length(query).cast("double"),
        "fragment": text.contains("#").cast("double"),
        "secure": text.startswith("https").cast("double"),
    })


def fold_of(url: Column) -> Column:
    """The half of the labelled URLs that a URL is in."""
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit("")), F.lit(3)), F.lit(2)).cast("int")


def suffix_shares(labelled: DataFrame, key: str, share: float) -> DataFrame:
    """Blocked share of each host suffix, drawn to the overall share where there are few URLs.

    Column all: among all labelled URLs; half0 and half1: among those of the other half than 0 and 1, so
    that no URL's own label is in what it is judged by.
    """

    def rate(rows: Column) -> Column:
        n, blocked = F.count_if(rows), F.sum(F.when(rows, F.col("blocked")).otherwise(0.0))
        return (blocked + PRIOR * share) / (n + PRIOR)

    fold = fold_of(F.col("url"))
    shares = [rate(F.lit(True)).alias("all"), rate(fold == 1).alias("half0"), rate(fold == 0).alias("half1")]
    return stored(labelled.groupBy(key).agg(*shares), f"{key}-shares")


def _with_shares(rows: DataFrame, shares: dict[str, DataFrame], share: float, of: Column) -> DataFrame:
    """Suffix statistics beside each URL: broadcast by their size, or else joined by AQE's skew-proof shuffle.

    `of` says which of their columns a URL gets: all, half0 or half1.
    """
    for key, table_ in shares.items():
        rows = rows.join(table_, key, "left")
        picked = F.when(of == "half0", F.col("half0")).when(of == "half1", F.col("half1")).otherwise(F.col("all"))
        rows = rows.withColumn(f"{key}_share", F.coalesce(picked, F.lit(share))).drop("all", "half0", "half1")
    return rows


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, training: int = TRAINING) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every row of pages (page_id, url).

    verdict is the longest fitting rule's, else block where the trees' probability is over one half.
    block_score is that probability, null where a rule decided.  Null URLs and those without `://`
    have empty host and path, fit no rule, and are judged by the trees like others.  Without labelled
    URLs of both verdicts the trees' answer is the one verdict there is (allow, if none).  Repeated rows
    and null ids are kept; other columns are not looked at.
    """
    rules = tuple(rules)
    rows = lexical(pages.select("page_id", "url")).withColumn("fit", rule_of(rules))
    # statistics of suffixes and training rows need the URL only
    labelled = rows.filter("fit is not null").withColumn("blocked", (F.col("fit.verdict") == "block").cast("double"))
    n, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    named = ["page_id", "host", "path", F.col("fit.rule").alias("rule")]
    if blocked in (0.0, float(n)):
        only, p = ("block", 1.0) if n and blocked else ("allow", 0.0)
        verdict = F.coalesce(F.col("fit.verdict"), F.lit(only)).alias("verdict")
        return rows.select(*named, verdict, F.when(F.col("fit").isNull(), F.lit(p)).alias("block_score"))
    share = blocked / n
    shares = {key: suffix_shares(labelled, key, share) for key in ("suffix", "domain")}
    features = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    chosen = labelled.filter(uniform("urls", F.col("page_id"), F.col("url")) < training / n)
    half = F.concat(F.lit("half"), fold_of(F.col("url")).cast("string"))
    model = boosted(features.transform(_with_shares(chosen, shares, share, half)).select("features", F.col("blocked").alias("label")))
    judged = model.transform(features.transform(_with_shares(rows, shares, share, F.lit("all"))))
    p = vector_to_array("probability")[1]
    free = F.col("fit").isNull()
    verdict = F.when(free, F.when(p > 0.5, "block").otherwise("allow")).otherwise(F.col("fit.verdict")).alias("verdict")
    return judged.select(*named, verdict, F.when(free, p).alias("block_score"))


def boosted(training: DataFrame) -> GBTClassificationModel:
    """Trees fitted by Spark on a stored training table (features, label)."""
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=8, cacheNodeIds=False, maxBins=32).fit(stored(training, "url-training"))
