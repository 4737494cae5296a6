"""The recurrence of a constant-velocity filter.  This module needs no other of the package: streams send it along whole."""

from __future__ import annotations


def kalman_start(z: float, r: float) -> tuple[float, ...]:
    """The state after a first measurement: level, rate and the covariance's three entries."""
    return float(z), 0.0, r, 0.0, 1e3


def kalman_step(state: tuple[float, ...], dt: float, z: float, q: float, r: float, gate: float) -> tuple[tuple[float, ...], bool]:
    """One step of a constant-velocity filter with a Joseph update, and whether the measurement was taken (within the gate)."""
    level, rate, a, b, c = state
    level += rate * dt
    a, b, c = a + 2 * dt * b + dt * dt * c + q * dt**3 / 3, b + dt * c + q * dt**2 / 2, c + q * dt
    y, s = z - level, a + r
    if y * y > gate * gate * s:
        return (level, rate, a, b, c), False
    k, m = a / s, b / s
    u = 1.0 - k
    return (level + k * y, rate + m * y, u * u * a + r * k * k, u * b - u * m * a + r * k * m, c - 2 * m * b + m * m * a + r * m * m), True
