"""Operator 10 [native]: URL rules, and a logistic regression on hashed character
n-grams of host and path for the URLs that no rule decides.

The regression is fitted on a small table of labelled URLs (``LABELLED``, or the
caller's own): 3- and 4-grams of ``^host$`` and of ``/path``, hashed into
``BUCKETS`` slots. Its weights, one number for each slot, are the only thing that
tasks get; scoring is a sum over the URL's n-grams in SQL.

Defined cases: a null URL, or one without ``://``, has empty host and path, no
rule, and is allowed; very long URLs are scored whole; repeated rows are judged
row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 4096
GRAMS = (3, 4)
THRESHOLD = 0.5

#: Rules of the query as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Labelled hosts (1: block); each stands with every path below.
BLOCK_HOSTS = (
    "spam-farm.example.org", "www.cheap-pills.example.com", "cheap-pills.example.net", "spam.example.net",
    "free-casino.example.org", "casino-bonus.example.net", "adult-videos.example.org", "xxx-cams.example.com",
    "win-prizes.example.org", "click-bait.example.net", "buy-followers.example.org", "replica-watches.example.com",
    "payday-loans.example.net", "viagra-store.example.org", "free-download-crack.example.net", "seo-farm.example.org",
)
ALLOW_HOSTS = (
    "www.example.org", "blog.example.net", "m.example.org", "docs.example.org", "news.example.net",
    "wiki.example.org", "blog.gardening.example.net", "www.library.example.org", "m.weather.example.net",
    "history.example.org", "blog.theory.example.org", "www.cooking.example.net", "science.example.org",
    "m.sports.example.net", "university.example.org", "travel.example.net", "thread.example.org", "other.example.net",
    "theatre.example.org", "www.thesis.example.net", "blog.thirteen.example.org", "m.teaching.example.net",
    "www.there.example.org", "weather.example.org", "blog.nation.example.net", "www.whether.example.org",
    "m.anthem.example.org", "stories.example.net", "www.action.example.org", "blog.indoor.example.org",
)
PATHS = ("/en/12", "/de/450/", "/fr/77.html", "/es/301", "/", "")


def labelled(spark: SparkSession) -> DataFrame:
    rows = [(f"https://{h}{p}", y) for y, hosts in ((1, BLOCK_HOSTS), (0, ALLOW_HOSTS)) for h in hosts for p in PATHS]
    return spark.createDataFrame(rows, "url string, label int")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (lower-cased) and ``path``."""
    at = F.coalesce(F.locate("://", F.col(url)), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    out = df.withColumn("_rest", rest).withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*+", 0))
    tail = F.substring(F.col("_rest"), F.length("_host") + 1, F.length("_rest"))
    return (out.withColumn("path", F.regexp_extract(tail, "^[^?#]*+", 0))
            .withColumn("host", F.translate("_host", C.UPPER, C.LOWER)).drop("_rest", "_host"))


def rule_name(host: str, path: str) -> str:
    return host + path


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict (null where none fits)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(rule_name(r[0], r[1]))):  # longer ones override
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, rule_name(host, path)).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def grams(text: Column, n: int) -> Column:
    """All n-grams of the text."""
    last = F.length(text) - n + 1
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(text, i, F.lit(n)))


def _hashed(parts: Column, salt: int) -> Column:
    return F.transform(parts, lambda g: F.pmod(F.xxhash64(F.lit(salt), g), F.lit(BUCKETS)).cast("int"))


def slots() -> Column:
    """Hash slots of the host's and the path's n-grams, host and path apart."""
    host, path = F.concat(F.lit("^"), "host", F.lit("$")), F.concat("path", F.lit("$"))
    parts = [_hashed(grams(text, n), salt) for salt, text in ((1, host), (2, path)) for n in GRAMS]
    return reduce(F.concat, parts)


def train(urls: DataFrame) -> tuple[list[float], float]:
    """Weights by slot and intercept: a logistic regression over the slots present in
    a URL, each URL scaled to unit length. ``urls`` is the small labelled table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, Normalizer

    rows = with_parts(urls).select(F.col("label").cast("double"), F.array_distinct(slots()).cast("array<string>").alias("s"))
    seen = CountVectorizer(inputCol="s", outputCol="v", binary=True, vocabSize=BUCKETS)
    model = Pipeline(stages=[seen, Normalizer(inputCol="v", outputCol="features"),
                             LogisticRegression(regParam=1e-4, maxIter=60, standardization=False)]).fit(rows.coalesce(1))
    weights = [0.0] * BUCKETS
    for slot, w in zip(model.stages[0].vocabulary, model.stages[2].coefficients, strict=True):
        weights[int(slot)] = round(float(w), 6)
    return weights, round(float(model.stages[2].intercept), 6)


def probability(weights: list[float], intercept: float) -> Column:
    """Chance that the URL is to be blocked."""
    table = F.array(*[F.lit(w) for w in weights])
    s = F.col("_slots")
    z = F.aggregate(s, F.lit(0.0), lambda a, i: a + F.element_at(table, i + 1))
    return 1.0 / (1.0 + F.exp(-(z / F.sqrt(F.greatest(F.size(s), F.lit(1))) + F.lit(intercept))))


def judge(urls: DataFrame, url: str = "url", rules=RULES, training: DataFrame | None = None) -> DataFrame:
    """All columns of ``urls`` with host, path, rule, p_block and verdict."""
    weights, intercept = train(labelled(urls.sparkSession) if training is None else training)
    name, says = rule_of(rules)
    out = with_parts(urls, url).withColumn("rule", name).withColumn("_says", says).withColumn("_slots", F.array_distinct(slots()))
    out = out.withColumn("p_block", F.when(F.col("host") == "", F.lit(0.0)).otherwise(probability(weights, intercept)))
    learnt = F.when(F.col("p_block") >= THRESHOLD, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("_says", learnt)).drop("_says", "_slots")


def query(spark, sf_dir: str) -> DataFrame:
    pages = C.read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "p_block")
