"""Append-only logs, resumption, summaries and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Shapes of credentials, and names of fields that hold them.
SECRET_SHAPES = r"AIza[0-9A-Za-z_\-]{20,}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+|(?i:bearer )\S+|-----BEGIN"
SECRET_NAMES = r"(?i)(api[_-]?key|secret|token|password|credential)"


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; lines without a key (a torn end) are skipped. One aggregation, no sort."""
    kept = [c for c in log.columns if c != key]
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("r")).select(key, "r.*")


def to_do(inputs: DataFrame, log: DataFrame, key: str, order: list[str], done: Column) -> DataFrame:
    """Inputs whose last logged row isn't done."""
    return inputs.join(latest(log, key, order).where(done).select(key), key, "left_anti")


def summary(log: DataFrame, key: str, order: list[str], by: str, value: str) -> DataFrame:
    """by, n, total, mean: of the last rows."""
    return latest(log, key, order).groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"))


def identity(*parts: Column) -> Column:
    """The first 24 hex digits of the hash of the parts, which bars separate."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(24))


def looks_secret(text: Column) -> Column:
    """A known shape, or a run of 32 letters and digits that is no hex digest."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9_\-]{32,})"), 1)
    dense = F.exists(runs, lambda r: ~r.rlike("^[0-9a-fA-F]+$") & r.rlike("[A-Za-z]") & r.rlike("[0-9]"))
    return F.coalesce(text, F.lit("")).rlike(SECRET_SHAPES) | dense


def scrubbed(params: Column) -> Column:
    """A map without keys that name secrets, and with values that look like one replaced."""
    kept = F.map_filter(params, lambda k, v: ~k.rlike(SECRET_NAMES))
    return F.transform_values(kept, lambda k, v: F.when(looks_secret(v), F.lit("[redacted]")).otherwise(v))


def host_of(url: Column) -> Column:
    """The host of a URL, with its port, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)), F.lit(""))
