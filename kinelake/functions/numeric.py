"""Vector functions: slices, normalisers and their inverses, padding. All are column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ACTION_DIM = 44
MODES = ("q99", "mean_std", "min_max", "scale", "binary")


def part(c: Column, start: int, end: int) -> Column:
    """Components start to end - 1 of a raw vector."""
    return F.slice(c, start + 1, end - start)


def _each(x: Column, a: Column, b: Column, f) -> Column:
    """f(x_i, a_i, b_i) for every component."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.zip_with(x, both, lambda v, s: f(v, s["a"], s["b"]))


def normalise(x: Column, mode: str, stats: dict[str, Column]) -> Column:
    """x under one of MODES. A component whose statistics leave no range is kept (q99, mean_std) or zero (min_max, scale);
    only q99 clips to [-1, 1]."""
    if mode == "q99":
        return _each(x, stats["q01"], stats["q99"], lambda v, lo, hi: F.greatest(F.least(F.when(hi == lo, v).otherwise(F.try_divide(2 * (v - lo), hi - lo) - 1), F.lit(1.0)), F.lit(-1.0)))
    if mode == "mean_std":
        return _each(x, stats["mean"], stats["std"], lambda v, m, s: F.when(s == 0, v).otherwise(F.try_divide(v - m, s)))
    if mode == "min_max":
        return _each(x, stats["min"], stats["max"], lambda v, lo, hi: F.when(hi == lo, F.lit(0.0)).otherwise(F.try_divide(2 * (v - lo), hi - lo) - 1))
    if mode == "scale":
        return _each(x, stats["min"], stats["max"], lambda v, lo, hi: F.when(F.greatest(F.abs(lo), F.abs(hi)) == 0, F.lit(0.0)).otherwise(F.try_divide(v, F.greatest(F.abs(lo), F.abs(hi)))))
    if mode == "binary":
        return F.transform(x, lambda v: (v > 0.5).cast("double"))
    raise ValueError(f"unknown normalisation {mode!r}; one of {MODES}")


def denormalise(y: Column, mode: str, stats: dict[str, Column]) -> Column:
    """The inverse. What q99 clipped stays clipped; ``scale`` has none."""
    if mode == "q99":
        return _each(y, stats["q01"], stats["q99"], lambda v, lo, hi: (v + 1) / 2 * (hi - lo) + lo)
    if mode == "mean_std":
        return _each(y, stats["mean"], stats["std"], lambda v, m, s: v * s + m)
    if mode == "min_max":
        return _each(y, stats["min"], stats["max"], lambda v, lo, hi: (v + 1) / 2 * (hi - lo) + lo)
    if mode == "binary":
        return F.transform(y, lambda v: (v > 0.5).cast("double"))
    raise ValueError(f"{mode!r} has no inverse")


def sin_cos(x: Column) -> Column:
    return F.concat(F.transform(x, F.sin), F.transform(x, F.cos))


def minus(x: Column, reference: Column) -> Column:
    """Component-wise difference from a reference row."""
    return F.zip_with(x, reference, lambda a, b: a - b)


def pad(x: Column, to: int = MAX_ACTION_DIM) -> Column:
    """x with zeros up to ``to`` components; an error if it has more."""
    short = F.concat(x, F.array_repeat(F.lit(0.0), F.lit(to) - F.size(x)))
    return F.when(F.size(x) <= to, short).otherwise(F.raise_error(F.concat(F.lit(f"more than {to} components: "), F.size(x).cast("string"))).cast("array<double>"))


def concat_keys(columns: dict[str, Column], widths: dict[str, int]) -> Column:
    """Keys end to end, each checked to be of its width."""
    checked = [F.when(F.size(c) == widths[k], c).otherwise(F.raise_error(F.lit(f"{k}: not {widths[k]} wide")).cast("array<double>")) for k, c in columns.items()]
    return F.concat(*checked)


def split_keys(x: Column, widths: dict[str, int]) -> dict[str, Column]:
    """The inverse of concat_keys."""
    out, at = {}, 0
    for k, w in widths.items():
        out[k] = part(x, at, at + w)
        at += w
    return out


def perturb(x: Column, std: float, lo: Column, hi: Column, seed: int) -> Column:
    """x plus Gaussian noise, the same draw for the row's components' seeds, clipped to the own range of each component."""
    noisy = F.transform(x, lambda v, i: v + F.lit(std) * F.sqrt(-2 * F.log(_unit(v, i, seed))) * F.cos(2 * F.pi() * _unit(v, i, seed + 1)))
    return _each(noisy, lo, hi, lambda v, a, b: F.greatest(F.least(v, b), a))


def _unit(v: Column, i: Column, seed: int) -> Column:
    """A number in (0, 1] from a value, its place and a seed, so that reruns agree."""
    return (F.pmod(F.xxhash64(v, i, F.lit(seed)), F.lit(2**31)) + 1) / F.lit(2.0**31)


def dropout(columns: dict[str, Column], probability: float, key: Column, seed: int) -> dict[str, Column]:
    """All keys of a row zeroed together with a probability, decided by a hash of the row's key."""
    out = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(probability * 1_000_000)
    return {k: F.when(out, F.transform(c, lambda _: F.lit(0.0))).otherwise(c) for k, c in columns.items()}
