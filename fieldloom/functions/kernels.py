"""Covariance functions.

Each takes distances and a module ``m`` supplying ``exp``/``sqrt``: the default is
``pyspark.sql.functions`` (Column in, Column out); pass ``numpy`` inside Arrow blocks.
"""

from __future__ import annotations

from functools import partial
from math import sqrt
from typing import Callable

from pyspark.sql import functions as F


def rbf(r, ls=1.0, var=1.0, m=F):
    return var * m.exp((r * r) * (-0.5 / (ls * ls)))


def matern(r, nu, ls=1.0, var=1.0, m=F):
    if nu == 0.5:
        return var * m.exp(r * (-1.0 / ls))
    if nu == 1.5:
        s = r * (sqrt(3.0) / ls)
        return var * ((s + 1.0) * m.exp(-s))
    if nu == 2.5:
        s = r * (sqrt(5.0) / ls)
        return var * ((s + 1.0 + s * s / 3.0) * m.exp(-s))
    raise ValueError(f"Matern smoothness must be 0.5, 1.5 or 2.5, got {nu}")


def multiscale(r, ls=1.0, ls_local=0.2, var=1.0, var_local=1.0, m=F):
    """Broad plus local Matern-5/2."""
    return matern(r, 2.5, ls, var, m) + matern(r, 2.5, ls_local, var_local, m)


def scaled_distance(dz, dy, dx, ls_z, ls_xy, m=F):
    """Anisotropic distance: each axis divided by its own length scale."""
    return m.sqrt((dz / ls_z) * (dz / ls_z) + (dy / ls_xy) * (dy / ls_xy) + (dx / ls_xy) * (dx / ls_xy))


def planar_distance(dy, dx, m=F):
    return m.sqrt(dy * dy + dx * dx)


def separable(dz, dy, dx, ls_z, ls_xy, var=1.0, m=F):
    """Product of a vertical and a horizontal Matern-5/2."""
    horizontal = matern(planar_distance(dy, dx, m), 2.5, ls_xy, 1.0, m)
    return var * (matern(m.abs(dz), 2.5, ls_z, 1.0, m) * horizontal)


KERNELS: dict[str, Callable] = {
    "rbf": rbf,
    "matern12": partial(matern, nu=0.5),
    "matern32": partial(matern, nu=1.5),
    "matern52": partial(matern, nu=2.5),
    "multiscale": multiscale,
}


def kernel(name: str) -> Callable:
    """Kernel of the distance ``r`` by name."""
    try:
        return KERNELS[name]
    except KeyError:
        raise ValueError(f"unknown kernel {name!r}; choose from {sorted(KERNELS)}") from None
