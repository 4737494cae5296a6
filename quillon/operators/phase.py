"""Filters and loops over phases: recurrences that ``ordered.streamed`` runs over a path's rows.  Phases are in cycles, times in hours."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def wrap(x: float, period: float = 1.0) -> float:
    """x less whole periods, in [-period / 2, period / 2)."""
    return (x + period / 2) % period - period / 2


def integrated_noise(order: int, density: float, dt: float) -> np.ndarray:
    """Covariance that white noise of this density on the last of ``order`` states, each the integral of the next, adds in a step: the integral of
    t^a / a! * t^b / b! for each two states that are a and b integrations away from the noise."""
    away = np.arange(order)[::-1]
    power = away[:, None] + away[None, :] + 1
    scale = np.array([float(math.factorial(a)) for a in away])
    return density * dt**power / (power * scale[:, None] * scale[None, :])


def integrated_step(order: int, dt: float) -> np.ndarray:
    """How states, each the integral of the next, go on in a step."""
    ahead = np.arange(order)[None, :] - np.arange(order)[:, None]
    return np.where(ahead >= 0, dt ** np.maximum(ahead, 0) / np.vectorize(lambda k: float(math.factorial(k)))(np.maximum(ahead, 0)), 0.0)


def blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a) + len(b),) * 2)
    out[: len(a), : len(a)], out[len(a) :, len(a) :] = a, b
    return out


@dataclass(frozen=True)
class FrameFilter:
    """Five states, three measurements: phase, rate and acceleration of the carrier, phase and drift of the frame; measured are the carrier's phase (modulo a
    cycle) and rate and the frame's phase, with deviations that grow as coherence falls.

    A step's noise is the exact integral of white noise on the acceleration and on the drift.  A row below the least coherence isn't taken, and nothing is found in it.
    In others a carrier phase off by ``slip`` or more is a slip, and a rate off by ``turn`` or more a correction, unless one was found less than ``apart`` before; both are told and taken.
    """

    deviations: tuple[float, float, float] = (0.08, 0.3, 0.05)
    densities: tuple[float, float] = (1e-4, 1e-5)
    acceleration: float = 0.2
    least: float = 0.2
    slip: float = 0.3
    turn: float = 0.6
    apart: float = 24.0

    def start(self) -> tuple | None:
        return None

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        """row: id, t, carrier phase, rate, frame phase, coherence.  Out: id, taken, the three innovations, the five states, the phase's deviation, slip, corrected."""
        ident, t, *measured, coherence = row
        z, sigma = np.array(measured, float), np.array(self.deviations)
        seen = [0, 1, 3]
        if state is None:
            x = np.array([z[0], z[1], 0.0, z[2], 0.0])
            p = np.diag([sigma[0] ** 2, sigma[1] ** 2, self.acceleration**2, sigma[2] ** 2, self.densities[1]])
            turned = -math.inf
        else:
            before, x, p, turned = state
            f = blocks(integrated_step(3, t - before), integrated_step(2, t - before))
            x, p = f @ x, f @ p @ f.T + blocks(integrated_noise(3, self.densities[0], t - before), integrated_noise(2, self.densities[1], t - before))
        off = z - x[seen]
        off[0] = wrap(off[0])
        taken = coherence >= self.least
        slip = bool(taken and abs(off[0]) >= self.slip)
        corrected = bool(taken and abs(off[1]) >= self.turn and t - turned >= self.apart)
        if taken:
            r = np.diag((sigma / coherence) ** 2)
            gain = np.linalg.solve(p[np.ix_(seen, seen)] + r, p[seen]).T
            rest = np.eye(5)
            rest[:, seen] -= gain
            x, p = x + gain @ off, rest @ p @ rest.T + gain @ r @ gain.T
        return (t, x, p, t if corrected else turned), (ident, bool(taken), *off.tolist(), *x.tolist(), math.sqrt(max(p[0, 0], 0.0)), slip, corrected)


    def starts(self, n: int) -> tuple[np.ndarray, ...]:
        """``start`` of n paths: whether there was a row, its time, the states, their covariance, and when a correction was found."""
        return np.zeros(n, bool), np.zeros(n), np.zeros((n, 5)), np.zeros((n, 5, 5)), np.full(n, -math.inf)

    def steps(self, state: tuple[np.ndarray, ...], row: list[np.ndarray]) -> tuple[tuple[np.ndarray, ...], list[np.ndarray]]:
        """``step`` of many paths side by side."""
        there, before, x, p, turned = state
        ident, t, *measured, coherence = row
        z, sigma, n = np.stack(measured, 1).astype(float), np.array(self.deviations), len(t)
        seen = [0, 1, 3]
        first_x = np.zeros((n, 5))
        first_x[:, seen] = z
        first_p = np.diag([sigma[0] ** 2, sigma[1] ** 2, self.acceleration**2, sigma[2] ** 2, self.densities[1]])
        dt = np.where(there, t - before, 0.0)
        f, noise = np.zeros((n, 5, 5)), np.zeros((n, 5, 5))
        for at, order, density in ((0, 3, self.densities[0]), (3, 2, self.densities[1])):
            for a in range(order):
                for b in range(order):
                    i, j = order - 1 - a, order - 1 - b
                    noise[:, at + a, at + b] = density * dt ** (i + j + 1) / ((i + j + 1) * math.factorial(i) * math.factorial(j))
                    if b >= a:
                        f[:, at + a, at + b] = dt ** (b - a) / math.factorial(b - a)
        x = np.where(there[:, None], (f @ x[:, :, None])[:, :, 0], first_x)
        p = np.where(there[:, None, None], f @ p @ f.transpose(0, 2, 1) + noise, first_p)
        off = z - x[:, seen]
        off[:, 0] = (off[:, 0] + 0.5) % 1.0 - 0.5
        taken = coherence >= self.least
        slip = taken & (np.abs(off[:, 0]) >= self.slip)
        corrected = taken & (np.abs(off[:, 1]) >= self.turn) & (t - turned >= self.apart)
        r = np.zeros((n, 3, 3))
        r[:, [0, 1, 2], [0, 1, 2]] = (sigma / np.where(taken, coherence, 1.0)[:, None]) ** 2
        gain = np.linalg.solve(p[:, seen][:, :, seen] + r, p[:, seen]).transpose(0, 2, 1)
        rest = np.repeat(np.eye(5)[None], n, 0)
        rest[:, :, seen] -= gain
        x = np.where(taken[:, None], x + (gain @ off[:, :, None])[:, :, 0], x)
        p = np.where(taken[:, None, None], rest @ p @ rest.transpose(0, 2, 1) + gain @ r @ gain.transpose(0, 2, 1), p)
        return (np.ones(n, bool), t, x, p, np.where(corrected, t, turned)), [ident, taken, *off.T, *x.T, np.sqrt(np.maximum(p[:, 0, 0], 0.0)), slip, corrected]


class CarrierFilter:
    """Kalman filter with the states phase, rate, acceleration, frame phase and drift; irregular steps and Joseph updates.

    Two measurements and noise on each state by itself; ``FrameFilter`` has the carrier's rate as the third, and a step's exact noise.
    Both phases are measured modulo a cycle, with a variance that grows as coherence falls.  A measurement beyond the gate is a slip: it isn't
    taken, and after ``patience`` slips of the carrier in a row the phase is corrected to the measured one and its variance opened.
    """

    def __init__(self, noise: float = 0.02, process: tuple[float, ...] = (1e-4, 1e-4, 1e-6, 1e-4, 1e-6), gate: float = 3.0, patience: int = 3) -> None:
        self.noise, self.process, self.gate, self.patience = noise, np.array(process), gate, patience
        self.h = np.zeros((2, 5))
        self.h[0, 0] = self.h[1, 3] = 1.0

    def start(self) -> tuple | None:
        return ()

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        """row: id, t, carrier phase, frame phase, coherence.  Out: id, phase, rate, acceleration, frame phase, drift, slip, corrected."""
        ident, t, carrier, frame, coherence = row
        r = self.noise / max(coherence, 0.05)
        if not state:
            x, p = np.array([carrier, 0.0, 0.0, frame, 0.0]), np.diag([r, 1.0, 0.1, r, 1.0])
            return (t, x, p, 0), (ident, *x.tolist(), False, False)
        before, x, p, slips = state
        dt = t - before
        f = np.eye(5)
        f[0, 1] = f[1, 2] = f[3, 4] = dt
        f[0, 2] = dt * dt / 2
        x, p = f @ x, f @ p @ f.T + np.diag(self.process * max(dt, 0.0))
        slip = corrected = False
        for k, z in enumerate((carrier, frame)):
            h = self.h[k]
            y, s = wrap(z - h @ x), h @ p @ h + r
            if y * y > self.gate**2 * s:
                slip = slip or k == 0
                continue
            gain = p @ h / s
            a = np.eye(5) - np.outer(gain, h)
            x, p = x + gain * y, a @ p @ a.T + r * np.outer(gain, gain)
        slips = slips + 1 if slip else 0
        if slips >= self.patience:
            x = x.copy()
            x[0] += wrap(carrier - x[0])
            p = p.copy()
            p[0, :] = p[:, 0] = 0.0
            p[0, 0] = r
            p[1, 1] += 1.0
            slips, corrected = 0, True
        return (t, x, p, slips), (ident, *x.tolist(), slip, corrected)


class CodeFilter:
    """Carrier-aided code: states code and rate; the rate is measured directly, the code only modulo a period."""

    def __init__(self, period: float, code_noise: float, rate_noise: float, process: float) -> None:
        self.period, self.code_noise, self.rate_noise, self.process = period, code_noise, rate_noise, process

    def start(self) -> tuple:
        return ()

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        """row: id, t, code, rate.  Out: id, code (not wrapped), rate, innovation of the code."""
        ident, t, code, rate = row
        if not state:
            return (t, code, rate, self.code_noise, 0.0, self.rate_noise), (ident, code, rate, 0.0)
        before, x, v, a, b, c = state
        dt = t - before
        x, a, b, c = x + v * dt, a + 2 * dt * b + dt * dt * c + self.process * dt**3 / 3, b + dt * c + self.process * dt**2 / 2, c + self.process * dt
        y = rate - v
        s = c + self.rate_noise
        k, m = b / s, c / s
        x, v, a, b, c = x + k * y, v + m * y, a - k * b, b - k * c, c - m * c
        y = wrap(code - x, self.period)
        s = a + self.code_noise
        k, m = a / s, b / s
        return (t, x + k * y, v + m * y, a - k * a, b - k * b, c - m * b), (ident, x + k * y, v + m * y, y)


class PhaseLoop:
    """A second-order loop: a running phase is pulled towards each measured one.  A gap starts it anew; it is locked after ``hold`` small errors in a row."""

    def __init__(self, proportional: float = 0.4, integral: float = 0.1, gap: float = 12.0, small: float = 0.12, hold: int = 3) -> None:
        self.proportional, self.integral, self.gap, self.small, self.hold = proportional, integral, gap, small, hold

    def start(self) -> tuple:
        return ()

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        """row: id, t, phase.  Out: id, epoch, loop phase, frequency, error, locked."""
        ident, t, phase = row
        if not state or t - state[0] > self.gap:
            epoch = state[4] + 1 if state else 0
            return (t, phase, 0.0, 0, epoch), (ident, epoch, phase, 0.0, 0.0, False)
        before, own, frequency, small, epoch = state
        own += frequency * (t - before)
        error = wrap(phase - own)
        small = small + 1 if abs(error) <= self.small else 0
        if t > before:
            frequency += self.integral * error / (t - before)
        return (t, own + self.proportional * error, frequency, small, epoch), (ident, epoch, own + self.proportional * error, frequency, error, small >= self.hold)


class Activity:
    """Greedy activity tracking: a detection joins the open track with the nearest value within the gate, else opens one; tracks close after a gap."""

    def __init__(self, gap: float, gate: float) -> None:
        self.gap, self.gate = gap, gate

    def start(self) -> tuple:
        return 0, []

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        """row: id, t, value.  Out: id, track (numbered in order), members so far."""
        ident, t, value = row
        count, tracks = state
        tracks = [x for x in tracks if t - x[1] <= self.gap]
        near = min(((abs(value - x[2]), x[0]) for x in tracks), default=None)
        if near is None or near[0] > self.gate:
            return (count + 1, [*tracks, (count, t, value, 1)]), (ident, count, 1)
        tracks = [(x[0], t, value, x[3] + 1) if x[0] == near[1] else x for x in tracks]
        return (count, tracks), (ident, near[1], next(x[3] for x in tracks if x[0] == near[1]))
