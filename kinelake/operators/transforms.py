"""Transforms of samples and chains of them. A sample is a row; a key is a column ``modality.name`` that holds a window,
array<array<double>>, one inner array a time step.

Transforms are planner objects: each turns a DataFrame into another by column expressions, so a chain is one projection
without a shuffle or a Python function. Keys that a DataFrame lacks are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, rotation

REPRESENTATIONS = ("rel_xyz_rot6d", "relative", "delta", "absolute")
#: Bounds that follow from a representation: the range of each of so many numbers.
ROTATION_BOUNDS = {"rot6d": (1.0, 6), "rot6d_rows": (1.0, 6), "quaternion": (1.0, 4), "euler": (math.pi, 3)}
NEEDS = {"q99": ("q01", "q99"), "mean_std": ("mean", "std"), "min_max": ("min", "max"), "scale": ("min", "max"), "binary": ()}


def key(name: str) -> Column:
    return F.col(f"`{name}`")


def numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


class Transform:
    """Something done to samples. ``training`` says whether random parts act."""

    training: bool = True

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def train(self) -> None:
        self.training = True

    def evaluate(self) -> None:
        self.training = False


class Reversible(Transform):
    def unapply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class Chain(Reversible):
    """Transforms in order; the way back takes those that can be reversed, last first. An error names the place."""

    def __init__(self, *parts: Transform) -> None:
        self.parts = parts

    def apply(self, df: DataFrame) -> DataFrame:
        for n, part in enumerate(self.parts):
            df = self._run(n, part.apply, df)
        return df

    def unapply(self, df: DataFrame) -> DataFrame:
        for n in range(len(self.parts) - 1, -1, -1):
            if isinstance(self.parts[n], Reversible):
                df = self._run(n, self.parts[n].unapply, df)
        return df

    @staticmethod
    def _run(n: int, step: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
        try:
            return step(df)
        except Exception as error:
            raise ValueError(f"transform {n}: {error}") from error

    def train(self) -> None:
        for part in self.parts:
            part.train()

    def evaluate(self) -> None:
        for part in self.parts:
            part.evaluate()


@dataclass(frozen=True)
class KeyInfo:
    """What is known of a key: whether its numbers are continuous and absolute, and the rotation they stand for."""

    continuous: bool = True
    absolute: bool = True
    rotation: str | None = None


class StateAction(Reversible):
    """Turns each key's rows into the rotation asked for, then normalises them.

    ``statistics`` maps a key to lists by name (min, max, mean, std, q01, q99). A rotation that changes has the bounds of
    its new representation, so it takes ``min_max`` only, and only if it is absolute; a key that is not continuous takes
    ``binary`` only. The way back undoes both, but for what q99 clipped and binary cut."""

    def __init__(self, keys: list[str], modes: dict[str, str] | None = None, statistics: dict[str, dict[str, list[float]]] | None = None, rotations: dict[str, str] | None = None, info: dict[str, KeyInfo] | None = None) -> None:
        self.keys, self.modes, self.info, self.turns, self.stats = keys, modes or {}, info or {}, {}, {}
        for k in (*keys, *self.modes, *(rotations or {})):
            if "." not in k:
                raise ValueError(f"{k!r} is not modality.name")
        for k, to in (rotations or {}).items():
            source = self.info.get(k, KeyInfo()).rotation
            if source is None:
                raise ValueError(f"{k}: no rotation is known")
            if to not in ROTATION_BOUNDS:
                raise ValueError(f"unknown rotation {to!r}; one of {tuple(ROTATION_BOUNDS)}")
            if source != to:
                self.turns[k] = (source, to)
        for k, mode in self.modes.items():
            self.stats[k] = self._statistics(k, mode, (statistics or {}).get(k))

    def _statistics(self, k: str, mode: str, given: dict[str, list[float]] | None) -> dict[str, Column]:
        about = self.info.get(k, KeyInfo())
        if mode not in NEEDS:
            raise ValueError(f"unknown normalisation {mode!r}; one of {tuple(NEEDS)}")
        if k in self.turns:
            if not about.absolute:
                raise ValueError(f"{k}: a relative rotation that changes has no bounds to normalise by")
            if mode != "min_max":
                raise ValueError(f"{k}: a rotation that changes takes min_max only")
            bound, width = ROTATION_BOUNDS[self.turns[k][1]]
            given = {"min": [-bound] * width, "max": [bound] * width}
        elif not about.continuous and mode != "binary":
            raise ValueError(f"{k} is not continuous and takes binary only")
        given = given or {}
        lacking = [n for n in NEEDS[mode] if n not in given]
        if lacking:
            raise ValueError(f"{k}: {mode} needs {', '.join(lacking)}")
        if len({len(given[n]) for n in NEEDS[mode]}) > 1:
            raise ValueError(f"{k}: statistics differ in length")
        return {n: numbers(given[n]) for n in NEEDS[mode]}

    def apply(self, df: DataFrame) -> DataFrame:
        def forward(k: str) -> Callable[[Column], Column]:
            def row(x: Column) -> Column:
                x = rotation.convert(x, *self.turns[k]) if k in self.turns else x
                return numeric.normalise(x, self.modes[k], self.stats[k]) if k in self.modes else x

            return row

        return self._each(df, forward)

    def unapply(self, df: DataFrame) -> DataFrame:
        def back(k: str) -> Callable[[Column], Column]:
            def row(x: Column) -> Column:
                x = numeric.denormalise(x, self.modes[k], self.stats[k]) if k in self.modes else x
                return rotation.convert(x, *self.turns[k][::-1]) if k in self.turns else x

            return row

        return self._each(df, back)

    def _each(self, df: DataFrame, of: Callable[[str], Callable[[Column], Column]]) -> DataFrame:
        busy = [k for k in self.keys if k in df.columns and (k in self.turns or k in self.modes)]
        return df.withColumns({k: F.transform(key(k), of(k)) for k in busy}) if busy else df


@dataclass(frozen=True)
class KeyRule:
    """How an action key is represented, and the state key that it is relative to."""

    rep: str
    state: str | None = None
    rotation: str = "quaternion"
    order: str = "xyzw"
    state_rotation: str | None = None
    state_order: str | None = None

    def __post_init__(self) -> None:
        if self.rep not in REPRESENTATIONS:
            raise ValueError(f"unknown representation {self.rep!r}; one of {REPRESENTATIONS}")
        if self.rep in REPRESENTATIONS[:2] and self.state is None:
            raise ValueError(f"{self.rep} needs a state key")


class RelativeByKey(Transform):
    """Each action key by its rule: ``rel_xyz_rot6d`` poses as seen from the state's pose (all its numbers in a row),
    ``relative`` less the state's last row, ``delta`` and ``absolute`` as they are."""

    def __init__(self, rules: dict[str, KeyRule]) -> None:
        self.rules = rules

    def apply(self, df: DataFrame) -> DataFrame:
        new = {}
        for k, rule in self.rules.items():
            if k not in df.columns or rule.rep not in REPRESENTATIONS[:2]:
                continue
            if rule.state not in df.columns:
                raise KeyError(f"{k} is relative to {rule.state}, which is missing")
            new[k] = self._relative(k, rule)
        return df.withColumns(new) if new else df

    @staticmethod
    def _relative(k: str, rule: KeyRule) -> Column:
        state = key(rule.state)
        if rule.rep == "relative":
            return F.transform(key(k), lambda x: numeric.minus(x, F.get(state, F.size(state) - 1)))
        return F.transform(key(k), lambda x: rotation.relative_pose(x, F.flatten(state), rule.rotation, rule.order, rule.state_rotation, rule.state_order))


def broadcast_mask(mask: Column, steps: Column) -> Column:
    """One flag a time step; a single flag stands for all."""
    return F.when(F.size(mask) == 1, F.array_repeat(F.get(mask, F.lit(0)), steps)).otherwise(mask)


def engaged_relative(poses: Column, reference: Column, engaged: Column, first: Column, kind: str = "rot6d", reference_kind: str | None = None) -> Column:
    """Nine numbers a step: motions from step to step, added up (positions) and multiplied up (rotations, each as seen from
    the step before) over steps that are engaged and whose predecessor is. The first step's predecessor is the reference,
    engaged if ``first``. A pose without a rotation counts as the identity."""
    n, origin = F.size(poses), numbers([0, 0, 0])
    place = lambda p, k: F.struct(F.slice(p, 1, 3).alias("at"), F.coalesce(rotation.matrix_of(p, k), rotation.identity()).alias("turn"))
    start = F.array(place(reference, reference_kind or kind))

    def motion(z: Column) -> Column:
        b, h = z["before"], z["now"]
        moved = F.struct(numeric.minus(h["at"], b["at"]).alias("at"), rotation.multiply(rotation.transpose(b["turn"]), h["turn"]).alias("turn"))
        return F.when(z["on_before"] & z["on"], moved).otherwise(F.struct(origin.alias("at"), rotation.identity().alias("turn")))

    def motions(s: Column) -> Column:
        before, on_before = F.slice(F.concat(start, s["now"]), F.lit(1), n), F.slice(F.concat(F.array(first), s["on"]), F.lit(1), n)
        return F.transform(F.arrays_zip(before.alias("before"), s["now"].alias("now"), on_before.alias("on_before"), s["on"].alias("on")), motion)

    def summed(m: Column) -> Column:
        add = lambda done, x: F.concat(done, F.array(F.zip_with(F.element_at(done, -1), x["at"], lambda a, b: a + b)))
        places = F.slice(F.aggregate(m, F.array(origin), add), F.lit(2), n)
        return F.zip_with(places, rotation.product(F.transform(m, lambda x: x["turn"])), lambda p, r: F.concat(p, rotation.to_six(r)))

    both = F.struct(F.transform(poses, lambda p: place(p, kind)).alias("now"), broadcast_mask(engaged, n).alias("on"))
    return rotation.let(rotation.let(both, motions), summed)


@dataclass
class ClutchRelative(Transform):
    """Actions of a two-armed device whose arms can be disengaged. Which arm a key belongs to is read off its name.

    Poses (key to state key) become engaged_relative, then scaled by the numbers in the scaling keys, if those exist;
    ``hold`` keys repeat their last engaged row, ``zero`` keys are zero while disengaged, all others stay. Without an
    engagement key for an arm its keys stay as they are (poses are still scaled). ``drop`` keys are left out."""

    poses: dict[str, str]
    hold: list[str] = field(default_factory=list)
    zero: list[str] = field(default_factory=list)
    engaged: dict[str, str] = field(default_factory=lambda: {"left": "state.hapticengaged_left", "right": "state.hapticengaged_right"})
    translation: str | None = None
    angle: str | None = None
    kind: str = "rot6d"
    reference_kind: str | None = None
    drop: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        there = set(df.columns)
        new = {}
        for k in [x for x in (*self.poses, *self.hold, *self.zero) if x in there]:
            side = next((s for s in ("left", "right") if s in k.lower()), None)
            flag = self.engaged.get(side)
            on = F.transform(F.flatten(key(flag)), lambda v: F.coalesce(v != 0, F.lit(False))) if flag in there else None
            if k in self.poses:
                new[k] = self._pose(k, on, there)
            elif on is not None:
                new[k] = self._gated(key(k), on, k in self.hold)
        return (df.withColumns(new) if new else df).drop(*self.drop)

    def _pose(self, k: str, on: Column | None, there: set[str]) -> Column:
        state = self.poses[k]
        if state not in there:
            raise KeyError(f"{k} is relative to {state}, which is missing")
        out = key(k)
        if on is not None:
            out = engaged_relative(out, F.flatten(key(state)), on, F.coalesce(F.get(on, F.lit(0)), F.lit(True)), self.kind, self.reference_kind)
        scales = [F.get(F.flatten(key(s)), F.lit(0)) if s in there else None for s in (self.translation, self.angle)]
        if all(s is None for s in scales):
            return out
        by, turn = (F.lit(1.0) if s is None else s for s in scales)
        return F.transform(out, lambda p: rotation.scale_motion(p, by, turn))

    @staticmethod
    def _gated(x: Column, on: Column, hold: bool) -> Column:
        both = F.arrays_zip(x.alias("v"), broadcast_mask(on, F.size(x)).alias("on"))
        if not hold:
            return F.transform(both, lambda z: F.when(z["on"], z["v"]).otherwise(F.transform(z["v"], lambda _: F.lit(0.0))))
        kept = lambda done, z: F.when(z["on"] | (F.size(done) == 0), z["v"]).otherwise(F.get(done, F.size(done) - 1))
        return F.aggregate(both, F.array().cast("array<array<double>>"), lambda done, z: F.concat(done, F.array(kept(done, z))))


@dataclass
class SinCos(Transform):
    """Each row of the keys as its sines, then its cosines."""

    keys: list[str]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({k: F.transform(key(k), numeric.sin_cos) for k in self.keys if k in df.columns})


@dataclass
class Concat(Reversible):
    """Keys, end to end at each step, as one; each row must be as wide as said. If ``exact``, a sample may have no other key
    ``name.something``. The way back cuts them apart."""

    name: str
    widths: dict[str, int]
    exact: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        lacking = [k for k in self.widths if k not in df.columns]
        if lacking:
            raise KeyError(", ".join(lacking))
        beyond = [c for c in df.columns if c.startswith(f"{self.name}.") and c not in self.widths]
        if self.exact and beyond:
            raise ValueError(f"not in the order of {self.name}: {', '.join(beyond)}")
        steps = F.arrays_zip(*[key(k).alias(f"k{n}") for n, k in enumerate(self.widths)])
        joined = F.transform(steps, lambda z: numeric.concat_keys({k: z[f"k{n}"] for n, k in enumerate(self.widths)}, self.widths))
        return df.withColumn(self.name, joined).drop(*[k for k in self.widths if k != self.name])

    def unapply(self, df: DataFrame) -> DataFrame:
        part = lambda k: F.transform(key(self.name), lambda x: numeric.split_keys(x, self.widths)[k])
        cut = {k: part(k) for k in self.widths}
        return df.withColumns(cut).drop(*([] if self.name in self.widths else [self.name]))


@dataclass
class Pad(Transform):
    """Zeros behind each row of a key, up to a width; wider rows are an error."""

    name: str
    width: int = numeric.MAX_ACTION_DIM

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, F.transform(key(self.name), lambda x: numeric.pad(x, self.width)))


@dataclass
class Cast(Transform):
    """Each key's rows as another type of number (float, double, int, long); integers are cut towards zero."""

    types: dict[str, str]

    def apply(self, df: DataFrame) -> DataFrame:
        lacking = [k for k in self.types if k not in df.columns]
        if lacking:
            raise KeyError(", ".join(lacking))
        return df.withColumns({k: key(k).cast(f"array<array<{to}>>") for k, to in self.types.items()})


@dataclass
class Rename(Reversible):
    """Keys under other names; a name that is taken already is an error."""

    names: dict[str, str]

    def apply(self, df: DataFrame) -> DataFrame:
        return self._renamed(df, self.names)

    def unapply(self, df: DataFrame) -> DataFrame:
        return self._renamed(df, {new: old for old, new in self.names.items()})

    @staticmethod
    def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
        lacking = [k for k in names if k not in df.columns]
        if lacking:
            raise KeyError(", ".join(lacking))
        columns = [names.get(c, c) for c in df.columns]
        if len({*columns}) < len(columns):
            raise ValueError(f"names would repeat: {columns}")
        return df.toDF(*columns)


@dataclass
class Dropout(Transform):
    """In training, all keys of a sample zero together, as a hash of the sample's id says."""

    keys: list[str]
    probability: float
    sample: str
    seed: int = 0

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.training:
            return df
        out = F.pmod(F.xxhash64(key(self.sample), F.lit(self.seed)), F.lit(1_000_000)) < int(self.probability * 1_000_000)
        still = lambda k: F.transform(key(k), lambda x: F.transform(x, lambda _: F.lit(0.0)))
        return df.withColumns({k: F.when(out, still(k)).otherwise(key(k)) for k in self.keys if k in df.columns})
