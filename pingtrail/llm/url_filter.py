"""URL filters: a list of rules, and for other URLs gradient-boosted trees on lexical features.

The trees learn from the URLs that a rule judges (block is 1) and judge those
that none fits.  All of it is DataFrame expressions and Spark ML.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingtrail.llm.shared import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled URLs, at most, that the trees are fitted on (those with the smallest hashes).
SAMPLE = 20_000
#: Weight of the overall block rate in a suffix's rate.
PRIOR_WEIGHT = 10.0
FEATURES = ["n_url", "n_host", "n_path", "n_query", "depth", "labels", "digit_ratio", "mark_ratio", "entropy",
            "n_params", "has_fragment", "secure", "top_rate", "top_log_count", "site_rate", "site_log_count"]


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host and its subdomains where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit(" "), url), "://", 1))
    rest = F.coalesce(F.substr(url, F.length(rest) - 1 + 4), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of host, path, name and verdict, else NULL."""
    kind = "array<struct<host: string, path: string, name: string, verdict: string>>"
    listed = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.name).alias("name"),
                                F.lit(r.verdict).alias("verdict"))
                       for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))]).cast(kind)
    fits = lambda r: (((host == r.host) | F.endswith(host, F.concat(F.lit("."), r.host)))
                      & F.startswith(path, r.path))
    return F.try_element_at(F.filter(listed, fits), F.lit(1))


def _lexical(df: DataFrame) -> DataFrame:
    """``df`` (``url``, ``host``, ``path``) with the features that need no statistics, and its suffixes."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    share = lambda pattern: F.length(F.regexp_replace(url, pattern, "")) / F.greatest(n, F.lit(1))
    # Shannon entropy of the characters, from the number of each distinct one
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: n - F.length(F.replace(url, c, F.lit(""))))
    plogp = F.aggregate(F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x * F.log2(x))
    return df.withColumns({
        "n_url": n, "n_host": F.length(host), "n_path": F.length(path), "n_query": F.length(query),
        "depth": F.size(F.split(path, "/")) - 1, "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": share("[^0-9]"), "mark_ratio": share("[A-Za-z0-9]"),
        "entropy": F.when(n > 0, F.log2(n) - plogp / n).otherwise(0.0),
        "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
        "has_fragment": F.instr(url, "#").cast("boolean").cast("int"),
        "secure": F.lower(url).startswith("https://").cast("int"),
        "top": F.substring_index(host, ".", -1), "site": F.substring_index(host, ".", -2),
    })


#: Folds of the labelled URLs: a fitted row gets its suffixes' statistics from the other folds.
FOLDS = 5


def _suffix_statistics(labelled: DataFrame, suffix: str) -> DataFrame:
    """Sum and number of the labels of each suffix of the labelled URLs, in each fold and (fold -1) in all."""
    sums = [F.sum("label").alias("_sum"), F.count(F.lit(1)).alias("_n")]
    folds = labelled.groupBy(suffix, "fold").agg(*sums)
    return folds.unionByName(folds.groupBy(suffix).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n")).withColumn("fold", F.lit(-1).cast("long")))


def _with_statistics(df: DataFrame, statistics: dict[str, DataFrame], rate: float, fitted: bool = False) -> DataFrame:
    """Block rate (drawn towards the overall one) and log count of each suffix; of
    ``fitted`` rows, which have a ``fold``, without that fold's labels, their own among them."""
    for suffix, known in statistics.items():
        df = df.join(known.where("fold = -1").drop("fold"), suffix, "left")
        n, total = F.coalesce("_n", F.lit(0)), F.coalesce("_sum", F.lit(0))
        if fitted:
            own = known.where("fold >= 0").withColumnsRenamed({"_n": "_n_own", "_sum": "_sum_own"})
            df = df.join(own, [suffix, "fold"], "left")
            n, total = n - F.coalesce("_n_own", F.lit(0)), total - F.coalesce("_sum_own", F.lit(0))
        df = df.withColumns({
            f"{suffix}_rate": (total + PRIOR_WEIGHT * rate) / (n + PRIOR_WEIGHT),
            f"{suffix}_log_count": F.log1p(n)}).drop("_n", "_sum", "_n_own", "_sum_own")
    return df


def judge(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", sample: int = SAMPLE,
          trees: int = 15, depth: int = 4) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` (0 to
    1; NULL where a rule judges) of each row of ``pages``.

    A NULL URL, or one without ``://``, has an empty host and path and is judged
    by the trees.  If no rule fits any URL all others are allowed, and if the
    URLs that rules fit have one verdict all others get it.  Repeated rows are
    judged alike; other columns of ``pages`` are ignored."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    host, path = host_and_path(F.col("url"))
    read = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    read = read.withColumns({"host": host, "path": path})
    read = read.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    read = read.select("key", "url", "host", "path", F.col("best.name").alias("rule"), F.col("best.verdict").alias("ruled"))
    plain = [F.col("key").alias(key), "host", "path", "rule"]

    labelled = read.where("rule is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    if not seen.n or seen.blocked in (0, seen.n):
        other = F.lit("block" if seen.n and seen.blocked else "allow")
        return read.select(*plain, F.coalesce("ruled", other).alias("verdict"), F.lit(None).cast("double").alias("block_score"))

    rate = seen.blocked / seen.n
    labelled = labelled.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS)))
    suffixes = labelled.select("label", "fold", F.substring_index("host", ".", -1).alias("top"),
                               F.substring_index("host", ".", -2).alias("site"))
    statistics = {s: stored(_suffix_statistics(suffixes, s), f"suffixes-{s}") for s in ("top", "site")}
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    fitted_on = labelled.orderBy(F.xxhash64("key", "url"), "key", "url").limit(sample)
    fitted_on = stored(_with_statistics(_lexical(fitted_on), statistics, rate, fitted=True).select("label", *FEATURES), "labelled-urls")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(vector.transform(fitted_on))

    others = _with_statistics(_lexical(read.where("rule is null")), statistics, rate)
    scored = model.transform(vector.transform(others)).withColumn("block_score", vector_to_array("probability")[1])
    scored = scored.select(*plain, F.when(F.col("block_score") >= 0.5, "block").otherwise("allow").alias("verdict"), "block_score")
    ruled = read.where("rule is not null").select(*plain, F.col("ruled").alias("verdict"),
                                                  F.lit(None).cast("double").alias("block_score"))
    return ruled.unionByName(scored)
