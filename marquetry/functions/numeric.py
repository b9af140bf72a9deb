"""Curves, gates, vectors and distances as Column builders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; zero if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def gate(similarity: Column, midpoint: float, temperature: float) -> Column:
    """Logistic; a step where the temperature isn't positive."""
    if temperature <= 0:
        return F.when(similarity >= midpoint, 1.0).otherwise(0.0)
    return 1 / (1 + F.exp(-(similarity - midpoint) / temperature))


def expected_tags(chars: Column, cap: Column, saturation: Column) -> Column:
    return F.when(saturation <= 0, cap).otherwise(cap * (1 - F.exp(-chars / saturation)))


def confidence(tags: Column, expected: Column) -> Column:
    return F.when(expected <= 0, 1.0).otherwise(F.least(F.lit(1.0), tags / expected))


def toward(score: Column, multiplier: Column) -> Column:
    """A multiplier that always helps: negative scores are divided by it."""
    return F.when(score >= 0, score * multiplier).otherwise(score / multiplier)


def huber(residual: Column, delta: float = 1.5) -> Column:
    r = F.abs(residual)
    return F.when(r <= delta, 0.5 * r * r).otherwise(delta * (r - 0.5 * delta))


def ewma(old: Column, new: Column, alpha: float = 0.15) -> Column:
    return (1 - alpha) * old + alpha * new


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_MILES * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


@dataclass(frozen=True)
class Comfort:
    """An asymmetric trapezoid: one on [ideal], zero at the bounds of [zero], minus one at and beyond those of [floor]. A side whose three bounds agree is open."""

    ideal: tuple[float, float]
    zero: tuple[float, float]
    floor: tuple[float, float]
    weight: float = 1.0
    fallback_for: str | None = None
    supersedes: tuple[str, ...] = ()

    def value(self, reading: Column) -> Column:
        def side(distance: Column, ideal: float, zero: float, floor: float) -> Column:
            to_zero, to_floor = abs(zero - ideal), abs(floor - zero)
            if to_zero == 0 and to_floor == 0:
                return F.lit(1.0)
            out = F.when(distance <= 0, 1.0)
            if to_zero:
                out = out.when(distance <= to_zero, 1 - distance / to_zero)
            if to_floor:
                out = out.when(distance <= to_zero + to_floor, -(distance - to_zero) / to_floor)
            return out.otherwise(-1.0)

        low = side(F.lit(self.ideal[0]) - reading, self.ideal[0], self.zero[0], self.floor[0])
        high = side(reading - F.lit(self.ideal[1]), self.ideal[1], self.zero[1], self.floor[1])
        return F.when(reading.isNotNull(), F.when(reading < self.ideal[0], low).when(reading > self.ideal[1], high).otherwise(1.0))


# The conditions of the public WMO codes; any other code is overcast.
WMO = {"clear": (0, 1), "partly_cloudy": (2,), "overcast": (3, 45, 48), "rain": (51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 80, 81, 82), "snow": (71, 73, 75, 77, 85, 86), "thunderstorm": (95, 96, 99)}


def wmo_condition(code: Column) -> Column:
    out = F.lit("overcast")
    for name, codes in WMO.items():
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


def comfort(readings: dict[str, tuple[Column, Comfort]], condition: Column | None = None, penalties: dict[str, float] | None = None) -> Column:
    """The weighted mean over the curves that count, at most the smallest cap; zero where no curve counts, null where nothing is known at all.

    A curve with ``fallback_for`` counts only where that reading is missing. One that ``supersedes`` others is a cap and no part of the mean. A negative
    penalty of the ``condition`` caps too, unless a curve that counts supersedes that condition.
    """
    total = weight = F.lit(0.0)
    caps: list[Column] = []
    known = superseded = F.lit(False)
    for reading, curve in readings.values():
        counts = reading.isNotNull()
        if curve.fallback_for in readings:
            counts = counts & readings[curve.fallback_for][0].isNull()
        known = known | counts
        value = F.when(counts, curve.value(reading))
        if curve.supersedes:
            caps.append(value)
            superseded = superseded | (counts & condition.isin(*curve.supersedes) if condition is not None else F.lit(False))
        else:
            total = total + F.coalesce(value * curve.weight, F.lit(0.0))
            weight = weight + F.when(counts, curve.weight).otherwise(0.0)
    mean = F.when(weight > 0, total / weight).otherwise(0.0)
    for name, penalty in (penalties or {}).items():
        if penalty < 0 and condition is not None:
            caps.append(F.when((condition == name) & ~superseded, F.lit(float(penalty))))
    return F.when(known, F.least(mean, *caps) if caps else mean)


def weather_adjustment(value: Column, setting: Column, up: float = 0.15, down: float = 0.25) -> Column:
    """The comfort scaled, for what takes place outdoors; zero elsewhere and where the weather is unknown."""
    return F.when(setting == "outdoor", F.coalesce(F.when(value >= 0, value * up).otherwise(value * down), F.lit(0.0))).otherwise(0.0)


def sample_hour(hours: Column, start: Column, timed: Column, usual: int = 20) -> Column:
    """The reading of an array of structs with ``hour`` at the start's hour, or the usual one where no time is stated; null if there is none."""
    wanted = F.when(timed, F.hour(start)).otherwise(usual)
    return F.get(F.filter(hours, lambda h: h["hour"] == wanted), F.lit(0))


def choose_readings(observed: Column, forecast: Column) -> Column:
    return F.coalesce(observed, forecast)
