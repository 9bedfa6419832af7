"""Rotations over ARRAY<DOUBLE> columns.

Quaternions are (w, x, y, z); data in (x, y, z, w) is turned by
:func:`from_xyzw`.  Matrices are nine components by rows, six-component forms
hold the first two rows.  :func:`let` names an argument inside an expression, so
that compositions stay linear in size and every argument is evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(*args) -> Column:
    """``let(a, b, ..., f)``: f(a, b, ...) with each argument evaluated once."""
    *values, f = args
    if not values:
        return f()
    first, *rest = values
    return F.element_at(F.transform(F.array(first), lambda x: let(*rest, lambda *ys: f(x, *ys))), 1)


def e(v: Column, i: int) -> Column:
    return F.element_at(v, i + 1)


def from_xyzw(q: Column) -> Column:
    return F.array(e(q, 3), e(q, 0), e(q, 1), e(q, 2))


def to_xyzw(q: Column) -> Column:
    return F.array(e(q, 1), e(q, 2), e(q, 3), e(q, 0))


def unit(v: Column, n: int) -> Column:
    """v over its length; a zero vector stays."""
    return let(v, lambda v: _unit(v, n))


def _unit(v: Column, n: int) -> Column:
    length = F.sqrt(sum((e(v, i) * e(v, i) for i in range(1, n)), e(v, 0) * e(v, 0)))
    return F.array(*(F.when(length > 0, e(v, i) / length).otherwise(e(v, i)) for i in range(n)))


def standardize(q: Column) -> Column:
    """The same rotation with a real part that is not negative."""
    return let(q, lambda q: _standardize(q))


def _standardize(q: Column) -> Column:
    return F.when(e(q, 0) < 0, F.transform(q, lambda x: -x)).otherwise(q)


def multiply(a: Column, b: Column) -> Column:
    return let(a, b, lambda a, b: _multiply(a, b))


def _multiply(a: Column, b: Column) -> Column:
    aw, ax, ay, az = (e(a, i) for i in range(4))
    bw, bx, by, bz = (e(b, i) for i in range(4))
    return F.array(aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def invert(q: Column) -> Column:
    return let(q, lambda q: _invert(q))


def _invert(q: Column) -> Column:
    return F.array(e(q, 0), -e(q, 1), -e(q, 2), -e(q, 3))


def rotate(q: Column, v: Column) -> Column:
    """v turned by a unit quaternion."""
    return let(q, v, lambda q, v: _rotate(q, v))


def _rotate(q: Column, v: Column) -> Column:
    p = multiply(multiply(q, F.array(F.lit(0.0), e(v, 0), e(v, 1), e(v, 2))), invert(q))
    return F.slice(p, 2, 3)


def to_matrix(q: Column) -> Column:
    return let(q, lambda q: _to_matrix(q))


def _to_matrix(q: Column) -> Column:
    w, x, y, z = (e(q, i) for i in range(4))
    s = 2.0 / (w * w + x * x + y * y + z * z)
    return F.array(
        1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
    )


def from_matrix(m: Column) -> Column:
    """The quaternion by the numerically largest of its four components."""
    return let(m, lambda m: _from_matrix(m))


def _from_matrix(m: Column) -> Column:
    a = [[e(m, 3 * r + c) for c in range(3)] for r in range(3)]
    t = [1 + a[0][0] + a[1][1] + a[2][2], 1 + a[0][0] - a[1][1] - a[2][2], 1 - a[0][0] + a[1][1] - a[2][2], 1 - a[0][0] - a[1][1] + a[2][2]]
    half = lambda k: 2 * F.sqrt(F.greatest(t[k], F.lit(1e-300)))
    w = F.array(half(0) / 4, (a[2][1] - a[1][2]) / half(0), (a[0][2] - a[2][0]) / half(0), (a[1][0] - a[0][1]) / half(0))
    x = F.array((a[2][1] - a[1][2]) / half(1), half(1) / 4, (a[0][1] + a[1][0]) / half(1), (a[0][2] + a[2][0]) / half(1))
    y = F.array((a[0][2] - a[2][0]) / half(2), (a[0][1] + a[1][0]) / half(2), half(2) / 4, (a[1][2] + a[2][1]) / half(2))
    z = F.array((a[1][0] - a[0][1]) / half(3), (a[0][2] + a[2][0]) / half(3), (a[1][2] + a[2][1]) / half(3), half(3) / 4)
    top = F.greatest(*t)
    return F.when(t[0] == top, w).when(t[1] == top, x).when(t[2] == top, y).otherwise(z)


def matmul(a: Column, b: Column) -> Column:
    return let(a, b, lambda a, b: _matmul(a, b))


def _matmul(a: Column, b: Column) -> Column:
    return F.array(*(e(a, 3 * r) * e(b, c) + e(a, 3 * r + 1) * e(b, 3 + c) + e(a, 3 * r + 2) * e(b, 6 + c) for r in range(3) for c in range(3)))


def transpose(m: Column) -> Column:
    return let(m, lambda m: _transpose(m))


def _transpose(m: Column) -> Column:
    return F.array(*(e(m, 3 * c + r) for r in range(3) for c in range(3)))


def apply_matrix(m: Column, v: Column) -> Column:
    return let(m, v, lambda m, v: _apply_matrix(m, v))


def _apply_matrix(m: Column, v: Column) -> Column:
    return F.array(*(e(m, 3 * r) * e(v, 0) + e(m, 3 * r + 1) * e(v, 1) + e(m, 3 * r + 2) * e(v, 2) for r in range(3)))


def axis_matrix(axis: str, angle: Column) -> Column:
    """Rotation about one axis."""
    return let(angle, lambda angle: _axis_matrix(axis, angle))


def _axis_matrix(axis: str, angle: Column) -> Column:
    c, s, o, i = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    rows = {"X": (i, o, o, o, c, -s, o, s, c), "Y": (c, o, s, o, i, o, -s, o, c), "Z": (c, -s, o, s, c, o, o, o, i)}
    return F.array(*rows[axis])


def euler_to_matrix(angles: Column, convention: str) -> Column:
    """The product of three axis rotations, for any of the twelve conventions such as "XYZ"."""
    a, b, c = (axis_matrix(x, e(angles, i)) for i, x in enumerate(convention))
    return matmul(matmul(a, b), c)


def matrix_to_euler(m: Column, convention: str) -> Column:
    """The angles of :func:`euler_to_matrix`, the middle one in the principal range."""
    return let(m, lambda m: _matrix_to_euler(m, convention))


def _matrix_to_euler(m: Column, convention: str) -> Column:
    i, j, k = ("XYZ".index(x) for x in convention)
    at = lambda r, c: e(m, 3 * r + c)
    clip = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))
    even = (j - i) % 3 == 1
    sign = 1.0 if even else -1.0
    if i == k:
        n = 3 - i - j
        middle = F.acos(clip(at(i, i)))
        first = F.atan2(at(j, i), -sign * at(n, i))
        last = F.atan2(at(i, j), sign * at(i, n))
    else:
        middle = F.asin(clip(sign * at(i, k)))
        first = F.atan2(-sign * at(j, k), at(k, k))
        last = F.atan2(-sign * at(i, j), at(i, i))
    return F.array(first, middle, last)


def six_from_matrix(m: Column) -> Column:
    """The first two rows."""
    return F.slice(m, 1, 6)


def matrix_from_six(d: Column) -> Column:
    """Gram-Schmidt of two rows, and their cross product."""
    along = lambda a, v: e(a, 0) * e(v, 0) + e(a, 1) * e(v, 1) + e(a, 2) * e(v, 2)
    less = lambda a, v: let(along(a, v), lambda p: F.array(*(e(v, i) - p * e(a, i) for i in range(3))))
    cross = lambda a, b: F.array(e(a, 1) * e(b, 2) - e(a, 2) * e(b, 1), e(a, 2) * e(b, 0) - e(a, 0) * e(b, 2), e(a, 0) * e(b, 1) - e(a, 1) * e(b, 0))
    rows = lambda a, v: let(unit(less(a, v), 3), lambda b: F.concat(a, b, cross(a, b)))
    return let(d, lambda x: let(unit(F.slice(x, 1, 3), 3), F.slice(x, 4, 3), rows))


def to_axis_angle(q: Column) -> Column:
    """Axis times angle; no turn gives zeros."""
    return let(q, lambda q: _to_axis_angle(q))


def _to_axis_angle(q: Column) -> Column:
    w = F.greatest(F.least(e(q, 0), F.lit(1.0)), F.lit(-1.0))
    s = F.sqrt(F.greatest(1 - w * w, F.lit(0.0)))
    k = F.when(s < 1e-8, 0.0).otherwise(2 * F.acos(w) / F.greatest(s, F.lit(1e-300)))
    return F.array(*(e(q, i) * k for i in (1, 2, 3)))


def from_axis_angle(v: Column) -> Column:
    return let(v, lambda v: _from_axis_angle(v))


def _from_axis_angle(v: Column) -> Column:
    angle = F.sqrt(e(v, 0) * e(v, 0) + e(v, 1) * e(v, 1) + e(v, 2) * e(v, 2))
    k = F.when(angle < 1e-8, 0.5).otherwise(F.sin(angle / 2) / F.greatest(angle, F.lit(1e-300)))
    return F.array(F.cos(angle / 2), e(v, 0) * k, e(v, 1) * k, e(v, 2) * k)


def relative_pose(base: Column, pose: Column) -> Column:
    """pose (x, y, z, then quaternion x, y, z, w) as seen from base."""
    return let(base, pose, lambda base, pose: _relative_pose(base, pose))


def _relative_pose(base: Column, pose: Column) -> Column:
    qb, qp = unit(from_xyzw(F.slice(base, 4, 4)), 4), unit(from_xyzw(F.slice(pose, 4, 4)), 4)
    shift = F.zip_with(F.slice(pose, 1, 3), F.slice(base, 1, 3), lambda a, b: a - b)
    return F.concat(rotate(invert(qb), shift), to_xyzw(multiply(invert(qb), qp)))


def absolute_pose(base: Column, rel: Column) -> Column:
    """The inverse of :func:`relative_pose`."""
    return let(base, rel, lambda base, rel: _absolute_pose(base, rel))


def _absolute_pose(base: Column, rel: Column) -> Column:
    qb, qr = unit(from_xyzw(F.slice(base, 4, 4)), 4), unit(from_xyzw(F.slice(rel, 4, 4)), 4)
    moved = rotate(qb, F.slice(rel, 1, 3))
    return F.concat(F.zip_with(moved, F.slice(base, 1, 3), lambda a, b: a + b), to_xyzw(multiply(qb, qr)))


def pose_to_six(pose: Column) -> Column:
    """Position and six-component rotation of a quaternion pose."""
    return F.concat(F.slice(pose, 1, 3), six_from_matrix(to_matrix(from_xyzw(F.slice(pose, 4, 4)))))


def pose_mask_to_six(mask: Column) -> Column:
    """Mask of a quaternion pose for its six-component form: the rotation is active if any of it is."""
    return F.concat(F.slice(mask, 1, 3), F.array_repeat(F.exists(F.slice(mask, 4, 4), lambda x: x), 6))


def euler_pose_to_quaternion(pose: Column, convention: str = "XYZ") -> Column:
    return F.concat(F.slice(pose, 1, 3), to_xyzw(from_matrix(euler_to_matrix(F.slice(pose, 4, 3), convention))))


def quaternion_pose_to_euler(pose: Column, convention: str = "XYZ") -> Column:
    return F.concat(F.slice(pose, 1, 3), matrix_to_euler(to_matrix(from_xyzw(F.slice(pose, 4, 4))), convention))
