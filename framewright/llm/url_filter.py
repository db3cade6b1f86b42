"""URL filter: logistic regression on hashed character n-grams of host and path.

The model is trained here, from a small labelled URL table (``LABELLED``), with
DataFrame functions only: the n-grams of the table's URLs are hashed and normalised,
their Gram matrix is a join of the small table with itself, and gradient steps on the
dual coefficients run inside one array expression. What leaves the training is a dense
weight vector of ``buckets`` numbers, a bound that does not depend on the data; it
enters the scoring expression as a literal. Scoring is a narrow projection: no shuffle,
no join, and linear in the length of a URL.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 4
BUCKETS = 4096
STEPS = 150
RATE = 8.0
DECAY = 0.002

#: Labelled table: words whose hosts are to be blocked, words whose hosts are fine. Fixed values.
BLOCKED_HOSTS = (
    "cheap-pills pills-online viagra-store casino-bonus online-casino poker-win slots-jackpot betting-tips "
    "spam-farm spam-links link-farm seo-spam adult-cams adult-dating xxx-videos porn-tube sexy-chat free-followers free-bets ads-tracker click-ads ad-popunder "
    "payday-loans quick-loans crypto-doubler free-iphone prize-winner lottery-claim fake-watches replica-bags "
    "keygen-cracks warez-download torrent-cracks phishing-login miracle-diet"
).split()
ALLOWED_HOSTS = (
    "library museum university weather science history garden kitchen travel music cinema theatre "
    "hospital school city council nature forest mountain river bicycle railway astronomy biology chemistry "
    "poetry archive gazette journal daily harbour orchard painter teacher village meadow winter letters "
    "northern stone bridge water thunder ancient island parish evening sailing carpenter"
).split()
BLOCKED_PATHS = "/buy/now /order/discount /win/jackpot /cams/live /free/download".split()
ALLOWED_PATHS = "/en/12 /fr/480/ /de/771.html /es/35 /about/staff".split()

#: (host, path, verdict) of the rules that outrank the model. Fixed values of the contract.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def labelled_table() -> list[tuple[str, str, int]]:
    """(host, path, label) with label 1 for URLs to block; the two path kinds are crossed so that a host's words decide more than its path."""
    rows = []
    for k, word in enumerate(BLOCKED_HOSTS):
        path = ALLOWED_PATHS if k % 3 else BLOCKED_PATHS
        rows.append((f"{('www.', '', 'blog.')[k % 3]}{word}.example.{('com', 'org')[k % 2]}", path[k % 5], 1))
        rows.append((f"{word}.com", path[(k + 2) % 5], 1))
    for k, word in enumerate(ALLOWED_HOSTS):
        rows.append((f"{('www.', '', 'blog.', 'm.')[k % 4]}{word}.example.{('com', 'org')[k % 2]}", ALLOWED_PATHS[k % 5], 0))
        rows.append((f"{word}.org", ALLOWED_PATHS[(k + 2) % 5], 0))
    return rows


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule_fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith(f".{rule[0]}")) & path.startswith(rule[1])


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, such as ``net/``, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = _rule_fits(host, path, rule)
        name = F.when(fits, F.lit(rule[0] + rule[1])).otherwise(name)
        verdict = F.when(fits, F.lit(rule[2])).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column, size: int = GRAM, buckets: int = BUCKETS) -> Column:
    """Bucket numbers (first 28 bits of the MD5, modulo ``buckets``) of the character n-grams of host and path, each framed by markers."""
    text = F.split(F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$")), "")

    def of(chars: Column) -> Column:
        gram = lambda k: F.pmod(F.conv(F.substring(F.md5(F.array_join(F.slice(chars, k, size), "").cast("binary")), 1, 7), 16, 10).cast("int"), F.lit(buckets))
        return F.when(F.size(chars) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(chars) - (size - 1))), gram)).otherwise(F.array().cast("array<int>"))

    # The characters are bound by a lambda, so that they are cut once and not again for every n-gram.
    return F.get(F.transform(F.array(F.filter(text, lambda c: c != "")), of), 0)


@dataclass(frozen=True)
class Model:
    """Weights by bucket, and the intercept."""

    weights: tuple[float, ...]
    intercept: float

    def margin(self, buckets: Column) -> Column:
        """Log-odds of a block for n-gram buckets; n-grams count relative to the URL's number of them."""
        w = F.lit(list(self.weights))

        def of(b: Column) -> Column:
            total = F.aggregate(b, F.lit(0.0), lambda s, k: s + F.get(w, k))
            return total / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double")) + F.lit(self.intercept)

        return F.get(F.transform(F.array(buckets), of), 0)


def train(spark: SparkSession, rows: list[tuple[str, str, int]] | None = None, buckets: int = BUCKETS, steps: int = STEPS) -> Model:
    """Fit the model to (host, path, label) rows; meant for a table of some hundred rows."""
    rows = labelled_table() if rows is None else rows
    n = len(rows)
    hosts, paths, labels = (F.lit(list(x)) for x in zip(*((h, p, float(y)) for h, p, y in rows), strict=True))
    table = spark.range(1, numPartitions=1).select(F.posexplode(F.arrays_zip(hosts.alias("host"), paths.alias("path"), labels.alias("y"))).alias("k", "t"))
    table = table.select("k", F.col("t.host").alias("host"), F.col("t.path").alias("path"), F.col("t.y").alias("y"))
    table = table.select("k", "y", grams(F.col("host"), F.col("path"), buckets=buckets).alias("b"))
    parts = table.select("k", "y", F.explode("b").alias("bucket"), F.sqrt(F.size("b").cast("double")).alias("norm"))
    parts = parts.groupBy("k", "y", "bucket").agg((F.count("*") / F.first("norm")).alias("x"))
    other = parts.select(F.col("k").alias("j"), "bucket", F.col("x").alias("xj"))
    gram = parts.join(other, "bucket").groupBy("k", "y", "j").agg(F.sum(F.col("x") * F.col("xj")).alias("g"))
    row = gram.groupBy("k", "y").agg(F.map_from_entries(F.collect_list(F.struct("j", "g"))).alias("m"))
    row = row.select("k", "y", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)) + 1.0).alias("g"))
    whole = row.agg(F.array_sort(F.collect_list(F.struct("k", "y", "g"))).alias("t"))

    def step(a: Column, _: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(t["g"], a, lambda g, v: g * v), F.lit(0.0), lambda s, v: s + v)
            return a[i] * (1 - DECAY) + (t["y"] - 1 / (1 + F.exp(-margin))) * (RATE / n)

        return F.transform(F.col("t"), one)

    fitted = whole.select("t", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array_repeat(F.lit(0.0), n), step).alias("a"))
    alpha = fitted.select(F.posexplode("a").alias("k", "alpha"))
    summed = parts.join(alpha, "k").groupBy("bucket").agg(F.sum(F.col("x") * F.col("alpha")).alias("w"))
    weights = [0.0] * buckets
    for bucket, w in summed.union(alpha.select(F.lit(-1), F.sum("alpha"))).collect():  # at most ``buckets`` + 1 rows
        if bucket < 0:
            intercept = w
        else:
            weights[bucket] = w
    return Model(tuple(weights), intercept)


def judge(pages: DataFrame, model: Model | None = None, url_col: str = "url", id_col: str = "page_id", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of a block, six places) for every row.

    A null URL and one without ``://`` have an empty host and path; they, too, get
    the model's verdict (its intercept decides). Of two rules that fit, the longer wins,
    and no two of one length fit one URL. Null and repeated ids pass through, repeated
    rows stay repeated with equal verdicts, an empty table stays empty, further columns
    are ignored. A URL of any length is read whole, in linear time.
    """
    model = model or train(pages.sparkSession)
    cut = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    scored = cut.withColumn("rule", rule).withColumn("decided", decided).withColumn("score", F.round(1 / (1 + F.exp(-model.margin(grams(F.col("host"), F.col("path"))))), 6))
    verdict = F.coalesce(F.col("decided"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
