"""Rotations as column expressions: a 3 x 3 matrix is an array of nine doubles, row by row.

Two six-number conventions exist: by columns (the first two columns, one after the other) and by rows (the first two rows).
Everything is closed form, so plans stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
EPS = 1e-8


def identity() -> Column:
    return F.array(*map(F.lit, IDENTITY))


def _unit(v: list[Column]) -> list[Column]:
    n = F.greatest(F.sqrt(sum(x * x for x in v)), F.lit(EPS))
    return [x / n for x in v]


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def from_six(c: Column, by: str = "column") -> Column:
    """Gram-Schmidt of six numbers."""
    if by not in ("column", "row"):
        raise ValueError(f"unknown convention {by!r}")

    def second(x: Column) -> Column:
        a = [x[i] for i in range(3)]
        dot = sum(p * q for p, q in zip(a, [x[i] for i in range(3, 6)], strict=True))
        return F.array(*a, *_unit([x[3 + i] - dot * a[i] for i in range(3)]))

    def third(x: Column) -> Column:
        a, b = [x[i] for i in range(3)], [x[i] for i in range(3, 6)]
        w = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        return F.array(*[v[i] for i in range(3) for v in (a, b, w)]) if by == "column" else F.array(*a, *b, *w)

    first = let(c, lambda x: F.array(*_unit([x[i] for i in range(3)]), *[x[i] for i in range(3, 6)]))
    return let(let(first, second), third)


def to_six(m: Column, by: str = "column") -> Column:
    return let(m, lambda x: F.array(*[x[i] for i in ((0, 3, 6, 1, 4, 7) if by == "column" else range(6))]))


def from_quaternion(q: Column, order: str = "xyzw") -> Column:
    """The matrix of a quaternion, which is made a unit one; null if its norm is below EPS."""
    if sorted(order) != sorted("xyzw"):
        raise ValueError(f"unknown order {order!r}")

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(norm >= EPS, F.array(*[F.try_divide(v[i], norm) for i in range(4)]))

    def matrix(u: Column) -> Column:
        x, y, z, w = (u[order.index(k)] for k in "xyzw")
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
        )

    return let(let(q, unit), lambda u: F.when(u.isNotNull(), matrix(u)))


def from_euler(e: Column) -> Column:
    """Angles about the fixed axes x, y and z, applied in that order."""

    def matrix(v: Column) -> Column:
        sx, sy, sz = (v[i] for i in range(3))
        cx, cy, cz = (v[i] for i in range(3, 6))
        return F.array(
            cy * cz, sx * sy * cz - cx * sz, cx * sy * cz + sx * sz,
            cy * sz, sx * sy * sz + cx * cz, cx * sy * sz - sx * cz,
            -sy, sx * cy, cx * cy,
        )

    return let(let(e, lambda v: F.array(*[f(v[i]) for f in (F.sin, F.cos) for i in range(3)])), matrix)


def to_quaternion(m: Column, order: str = "xyzw") -> Column:
    """A unit quaternion of a matrix, read off from its largest component, which is positive."""
    if sorted(order) != sorted("xyzw"):
        raise ValueError(f"unknown order {order!r}")

    def read(v: Column) -> Column:
        m, t = v["m"], v["t"]
        # four times the products of two components
        pairs = {"wx": m[7] - m[5], "wy": m[2] - m[6], "wz": m[3] - m[1], "xy": m[1] + m[3], "xz": m[2] + m[6], "yz": m[5] + m[7]}
        out = F
        for n, big in enumerate("wxyz"):
            s = F.sqrt(F.greatest(t[n], F.lit(0.0)))
            parts = [s / 2 if k == big else F.try_divide(pairs["".join(sorted(k + big, key="wxyz".index))], 2 * s) for k in order]
            out = out.when(t[n] >= F.array_max(t), F.array(*parts))
        return out

    # one plus the traces: four times the squares of w, x, y and z
    squares = lambda m: F.array(1 + m[0] + m[4] + m[8], 1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8])
    return let(let(m, lambda x: F.struct(x.alias("m"), squares(x).alias("t"))), read)


def to_euler(m: Column) -> Column:
    """Angles about the fixed axes x, y and z, applied in that order; the inverse of from_euler within half a turn."""
    return let(m, lambda x: F.array(F.atan2(x[7], x[8]), F.asin(F.greatest(F.least(-x[6], F.lit(1.0)), F.lit(-1.0))), F.atan2(x[3], x[0])))


def transpose(m: Column) -> Column:
    return let(m, lambda x: F.array(*[x[3 * j + i] for i in range(3) for j in range(3)]))


def multiply(a: Column, b: Column) -> Column:
    cells = lambda x, y: F.array(*[sum(x[3 * i + k] * y[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)])
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: cells(s["a"], s["b"]))


def product(matrices: Column) -> Column:
    """The running product of an array of matrices, from the left: an ordered fold that no window function can express."""
    start = F.array(identity())
    fold = F.aggregate(matrices, start, lambda done, m: F.concat(done, F.array(multiply(F.element_at(done, -1), m))))
    return F.slice(fold, F.lit(2), F.size(matrices))


def scale_angle(m: Column, factor: Column | float) -> Column:
    """The same axis with the angle times a factor; the identity where the angle is below EPS."""
    factor = F.lit(factor) if not isinstance(factor, Column) else factor

    def axis_angle(m: Column) -> Column:
        angle = F.acos(F.greatest(F.least((m[0] + m[4] + m[8] - 1) / 2, F.lit(1.0)), F.lit(-1.0)))
        raw = [m[7] - m[5], m[2] - m[6], m[3] - m[1]]
        norm = F.sqrt(sum(x * x for x in raw))
        # at half a turn the difference vanishes and the axis is read off the diagonal
        half = [F.sqrt(F.greatest((m[i] + 1) / 2, F.lit(0.0))) for i in (0, 4, 8)]
        first = F.when(half[0] > 1e-6, 0).when(half[1] > 1e-6, 1).otherwise(2)
        sign = [F.lit(1.0), F.when((first == 0) & (m[1] < 0), -1.0).otherwise(1.0), F.when(((first == 0) & (m[2] < 0)) | ((first == 1) & (m[5] < 0)), -1.0).otherwise(1.0)]
        return F.array(*[F.when(norm > 1e-6, F.try_divide(r, norm)).otherwise(h * s) for r, h, s in zip(raw, half, sign, strict=True)], angle)

    def turn(u: Column) -> Column:
        x, y, z, t = (u[i] for i in range(4))
        s, c = F.sin(t * factor), F.cos(t * factor)
        turned = F.array(
            c + x * x * (1 - c), x * y * (1 - c) - z * s, x * z * (1 - c) + y * s,
            y * x * (1 - c) + z * s, c + y * y * (1 - c), y * z * (1 - c) - x * s,
            z * x * (1 - c) - y * s, z * y * (1 - c) + x * s, c + z * z * (1 - c),
        )
        return F.when(t > EPS, turned).otherwise(identity())

    return let(let(m, axis_angle), turn)


def matrix_of(pose: Column, kind: str, order: str = "xyzw") -> Column:
    """The rotation of a pose (three positions, then quaternion, euler or rot6d numbers)."""
    rest = F.slice(pose, F.lit(4), F.greatest(F.size(pose) - 3, F.lit(0)))
    if kind == "quaternion":
        return from_quaternion(rest, order)
    if kind == "euler":
        return from_euler(rest)
    if kind == "rot6d":
        return from_six(rest)
    raise ValueError(f"unknown rotation {kind!r}")


def relative_pose(pose: Column, reference: Column, kind: str = "quaternion", order: str = "xyzw", reference_kind: str | None = None, reference_order: str | None = None) -> Column:
    """Nine numbers: position less the reference's, and the rotation as seen from the reference's. A reference without a
    rotation (zero quaternion) counts as the identity; a pose without one becomes no motion."""
    own, base = matrix_of(pose, kind, order), F.coalesce(matrix_of(reference, reference_kind or kind, reference_order or order), identity())
    still = F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))
    parts = F.struct(own.alias("own"), base.alias("base"), pose.alias("pose"), reference.alias("ref"))
    moved = lambda s: F.concat(F.array(*[s["pose"][i] - s["ref"][i] for i in range(3)]), to_six(multiply(transpose(s["base"]), s["own"])))
    return let(parts, lambda s: F.when(s["own"].isNull(), still).otherwise(moved(s)))


def scale_motion(pose9: Column, translation: Column | float, rotation: Column | float) -> Column:
    """A relative pose with its translation and its angle scaled."""
    turned = lambda p: to_six(scale_angle(from_six(F.slice(p, 4, 6)), rotation))
    return let(pose9, lambda p: F.concat(F.transform(F.slice(p, 1, 3), lambda v: v * translation), turned(p)))


def convert(c: Column, source: str, target: str, order: str = "xyzw") -> Column:
    """One rotation representation as another, through the matrix: quaternion, euler, rot6d (by columns), rot6d_rows or
    matrix, in and out."""
    read = {"quaternion": lambda x: from_quaternion(x, order), "euler": from_euler, "rot6d": from_six, "rot6d_rows": lambda x: from_six(x, "row"), "matrix": lambda x: x}
    write = {"quaternion": lambda m: to_quaternion(m, order), "euler": to_euler, "rot6d": to_six, "rot6d_rows": lambda m: to_six(m, "row"), "matrix": lambda m: m}
    if source not in read or target not in write:
        raise ValueError(f"no conversion from {source!r} to {target!r}")
    return write[target](read[source](c))
