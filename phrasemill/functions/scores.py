"""Numeric column builders: hashed uniforms, scores, weights, tiers, cosines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(*key) -> Column:
    """The first 13 hex digits of the key's md5, which are in order of ``bits``."""
    text = F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key))
    return F.substring(F.md5(text), 1, 13)


def bits(*key) -> Column:
    """52 bits: the first 13 hex digits of the key's md5. The same wherever and however often it is asked."""
    return F.conv(digits(*key), 16, 10).cast("long")


def digits_to(share: Column) -> Column:
    """What the digits of a ``uniform`` up to ``share`` don't exceed: hex digits, or for 1 and more a letter behind them all."""
    whole = F.lower(F.lpad(F.hex(F.ceil(share * F.lit(4503599627370496.0))), 13, "0"))
    return F.when(share < 1, whole).otherwise("g")


def uniform(*key) -> Column:
    """In [0, 1): the key's bits over 2^52."""
    return bits(*key) / F.lit(4503599627370496.0)


def whole_uniform(total: Column, *key) -> Column:
    """A whole number in [0, total): the key's bits times the total over 2^52, without rounding."""
    product = bits(*key).cast("decimal(16,0)") * total.cast("decimal(19,0)")
    return F.call_function("div", product, F.lit(1 << 52).cast("decimal(16,0)"))


def filler_score(freq: Column, pop: Column, blend: Column, missing: Column) -> Column:
    return (1 - blend) * F.log10(1 + freq) + blend * F.coalesce(pop, missing)


def base_weight(freq: Column, pop: Column, blend: Column, missing: Column) -> Column:
    return (1 - blend) * F.sqrt(freq.cast("double")) + blend * F.sqrt(F.greatest(F.coalesce(pop, missing), F.lit(0.001)))


def tone_bias(score: Column, target: Column, spread: Column, floor: Column) -> Column:
    """1 without a target."""
    return F.when(target.isNull(), 1.0).otherwise(floor + (1 - floor) * F.exp(-F.pow((score - target) / spread, 2)))


def tier(score: Column, pop: Column, mainstream: Column) -> Column:
    return F.when(score > pop, "pop").when(score >= mainstream, "mainstream").otherwise("niche")


def tier_weight(score: Column, center: Column, spread: Column) -> Column:
    return F.exp(-F.pow((score - center) / spread, 2))


def composite(quality: Column, separation: Column, weight: float = 0.5) -> Column:
    return quality * weight + separation * (1 - weight)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def approximate_cosine(dots: Column, norms_sq: Column, centroid_norm: Column, cross: Column) -> Column:
    """From arrays of the parts' centroid dots and squared norms; every two parts are taken to have the similarity ``cross``.

    Null if a part is unknown (null), there is none, or a norm isn't positive.
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    roots = total(F.transform(norms_sq, F.sqrt))
    square = total(norms_sq)
    denominator = square + cross * (roots * roots - square)  # each pair twice
    known = F.forall(dots, lambda x: x.isNotNull()) & (F.size(dots) > 0) & (centroid_norm > 0)
    return F.when(known & (denominator > 0), total(dots) / (F.sqrt(denominator) * centroid_norm))
