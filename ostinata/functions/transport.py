"""What a transport needs of a query engine: as Column expressions over tables of requests. No request is made here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIMIT = 8
SKEW_SECONDS = 60
MOST_SECONDS = 30.0


def challenge(verifier: Column | str) -> Column:
    """The SHA-256 digest of a verifier in base64 for URLs, without padding."""
    v = F.col(verifier) if isinstance(verifier, str) else verifier
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(v.cast("binary"), 256))), "+/", "-_"), F.lit("="))


def expired(expiry: Column, now: Column, skew: int = SKEW_SECONDS) -> Column:
    """Whether a token is to be renewed: a little before it ends."""
    return now > expiry - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(skew))


def absolute(link: Column | str, base: str, host: str | None = None, rooted: str = "/v1/") -> Column:
    """A page's next link as a whole URL; an absent link stays ''. Links that begin with `rooted` hang on the host, others on the base."""
    x = F.coalesce(F.col(link) if isinstance(link, str) else link, F.lit(""))
    root = F.concat(F.lit(host or base), x)
    return F.when((x == "") | F.startswith(x, F.lit("http")), x).when(F.startswith(x, F.lit(rooted)), root).otherwise(F.concat(F.lit(base + "/"), F.regexp_replace(x, "^/", "")))


def wait_seconds(retry_after: Column | str, attempt: Column | str) -> Column:
    """Seconds to wait: half a second more than the service asks for, else 1, 2, 4 ... up to 30."""
    asked = (F.col(retry_after) if isinstance(retry_after, str) else retry_after).try_cast("int")
    n = F.col(attempt) if isinstance(attempt, str) else attempt
    return F.when(asked >= 0, asked + 0.5).otherwise(F.least(F.pow(F.lit(2.0), n.cast("double")), F.lit(MOST_SECONDS)))


def until_broken(rows: DataFrame, key: str, order: str, failed: str, limit: int = LIMIT) -> DataFrame:
    """The rows of each run up to the one that is the limit-th failure on end, where the run is broken off, and broken: whether it is that row."""
    w = W.partitionBy(key).orderBy(order)
    bad = F.coalesce(F.col(failed), F.lit(False))
    counted = rows.withColumn("_run", F.sum(F.when(bad, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    streak = counted.withColumn("_n", F.sum(bad.cast("int")).over(W.partitionBy(key, "_run").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    ended = streak.withColumn("broken", F.col("_n") == limit).withColumn("_before", F.coalesce(F.max((F.col("_n") >= limit).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return ended.where("_before = 0").drop("_run", "_n", "_before")
