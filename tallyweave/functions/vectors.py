"""Vector helpers: cosine, norms, and a deterministic hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; inside lambdas nothing else is shared."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for an empty or all-zero vector."""
    parts = F.struct(norm(a).alias("na"), norm(b).alias("nb"), dot(a, b).alias("ab"))
    return let(
        parts,
        lambda p: F.coalesce(F.when(p["na"] * p["nb"] != 0, p["ab"] / (p["na"] * p["nb"])), F.lit(0.0)),
    )


def unit(a: Column) -> Column:
    """Scale to length 1; an all-zero vector stays as it is."""
    return let(
        F.struct(a.alias("v"), norm(a).alias("n")),
        lambda p: F.transform(p["v"], lambda x: F.when(p["n"] == 0, x.cast("double")).otherwise(x / p["n"])),
    )


def terms(text: Column) -> Column:
    """Lower-case word terms of any script."""
    return F.filter(F.split(F.lower(text), r"(?U)\W+", -1), lambda t: t != "")


def term_bucket(term: Column, width: int) -> Column:
    """A portable hash bucket: the first 8 hex digits of MD5."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % width).cast("int")


def hash_embedding(text: Column, width: int = 64) -> Column:
    """Term counts per hash bucket, scaled to length 1: the default embedder.

    It stands in for a model so that pipelines run without one; pass any other
    ``Column -> Column`` embedder (a pandas UDF over a model, say) instead.
    """
    counts = let(
        F.transform(terms(text), lambda t: term_bucket(t, width)),
        lambda buckets: F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"),
        ),
    )
    return let(counts, unit)
