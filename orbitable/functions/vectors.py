"""3-vectors as tuples of three Columns. Everything stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str, fields: str = "xyz") -> Vec:
    """The vector in the struct column `prefix` (prefix.x, prefix.y, prefix.z)."""
    return tuple(F.col(f"{prefix}.{f}") for f in fields)


def cols(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def pack(v: Vec) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def scale(a: Vec, s: Column) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def angle_deg(a: Vec, b: Vec) -> Column:
    """Angle in degrees; NULL when a vector has no length, cosine clamped to [-1, 1]."""
    aa, bb = dot(a, a), dot(b, b)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(dot(a, b), F.sqrt(aa * bb))))
    return F.when((aa > 1e-12) & (bb > 1e-12), F.degrees(F.acos(cosine)))


def rotate_plane(u: Column, v: Column, degree: Column) -> tuple[Column, Column]:
    """2-D rotation of (u, v), rounded to 4 decimals."""
    c, s = F.cos(F.radians(degree)), F.sin(F.radians(degree))
    return F.round(c * u - s * v, 4), F.round(s * u + c * v, 4)


def euler_rotate(v: Vec, ax: float, ay: float, az: float, shift=(0.0, 0.0, 0.0)) -> Vec:
    """Rotate about x, then y, then z (radians), then shift."""
    x, y, z = v
    cx, sx, cy, sy, cz, sz = (F.lit(f(a)) for a in (ax, ay, az) for f in (_cos, _sin))
    y, z = cx * y - sx * z, sx * y + cx * z
    x, z = cy * x + sy * z, cy * z - sy * x
    x, y = cz * x - sz * y, sz * x + cz * y
    return x + shift[0], y + shift[1], z + shift[2]


def rotate_onto(v: Vec, source: Vec, target: Vec) -> Vec:
    """Rotate `v` by the rotation that takes unit vector `source` onto unit vector `target`.

    Rodrigues form; antiparallel vectors turn half a circle about an axis orthogonal to `source`.
    """
    axis, cosine = cross(source, target), dot(source, target)
    turned = add(
        add(scale(v, cosine), cross(axis, v)),
        scale(axis, F.try_divide(dot(axis, v), 1 + cosine)),
    )
    on_x = F.abs(source[0]) < 0.9
    flip = tuple(
        F.when(on_x, a).otherwise(b)
        for a, b in zip(
            cross(source, (F.lit(1.0), F.lit(0.0), F.lit(0.0))),
            cross(source, (F.lit(0.0), F.lit(1.0), F.lit(0.0))),
        )
    )
    half = sub(scale(flip, F.try_divide(2 * dot(flip, v), dot(flip, flip))), v)
    opposite = cosine < -1 + 1e-12
    return tuple(F.when(opposite, h).otherwise(t) for h, t in zip(half, turned))


def _cos(a: float) -> float:
    import math

    return math.cos(a)


def _sin(a: float) -> float:
    import math

    return math.sin(a)
