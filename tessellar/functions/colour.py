"""Colour arithmetic as column expressions. Channels are integers from 0 to 255 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The light paint; luminances that bound near white, very dark and light text; least channel and spread of paints;
# the share that a tint keeps; steps and offsets of debug colours; the factor of the seeded generator; the white point.
LIGHT_PAINT = (238, 232, 218)
NEAR_WHITE, DARKEST, LIGHT_TEXT, LEAST_CHANNEL, LEAST_SPREAD = 244.0, 42.0, 105.0, 24, 24
TINT = 0.16
DEBUG_STEPS, DEBUG_OFFSETS = (37, 67, 97), (73, 31, 151)
RANDOM_FACTOR = 10000
WHITE_POINT = (95.047, 100.0, 108.883)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hex_code(r, g, b) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def paint(r: Column, g: Column, b: Column) -> list[Column]:
    """A paintable colour: near-white becomes the light paint, very dark ones are lifted."""
    lum, spread = luminance(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    lifted = [F.greatest(F.lit(LEAST_CHANNEL), F.least(F.lit(255), F.bround(c * (DARKEST / F.greatest(lum, F.lit(1.0)))).cast("int"))) for c in (r, g, b)]
    return [F.when((lum > NEAR_WHITE) & (spread < LEAST_SPREAD), light).when(lum >= DARKEST, c).otherwise(dark) for c, light, dark in zip((r, g, b), LIGHT_PAINT, lifted)]


def needs_light_text(r: Column, g: Column, b: Column) -> Column:
    return luminance(r, g, b) < LIGHT_TEXT


def tint(c: Column) -> Column:
    """Strongly towards white."""
    return F.bround(255 * (1.0 - TINT) + c * TINT).cast("int")


def hsv8(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue from 0 to 179, saturation and value from 0 to 255."""
    v, m = F.greatest(r, g, b), F.least(r, g, b)
    d = v - m
    h = F.when(d == 0, 0.0).when(v == r, 60.0 * (g - b) / d).when(v == g, 120.0 + 60.0 * (b - r) / d).otherwise(240.0 + 60.0 * (r - g) / d)
    h = F.floor(F.when(h < 0, h + 360.0).otherwise(h) / 2 + 0.5).cast("int")
    return [F.when(h == 180, 0).otherwise(h), F.when(v == 0, 0).otherwise(F.floor(255.0 * d / v + 0.5)).cast("int"), v]


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """L from 0 to 100, a and b around 0."""

    def linear(c):
        s = c / F.lit(255.0)
        return F.when(s > 0.04045, F.pow((s + 0.055) / 1.055, F.lit(2.4))).otherwise(s / 12.92) * 100.0

    lr, lg, lb = map(linear, (r, g, b))
    xyz = (lr * 0.4124 + lg * 0.3576 + lb * 0.1805, lr * 0.2126 + lg * 0.7152 + lb * 0.0722, lr * 0.0193 + lg * 0.1192 + lb * 0.9505)
    fx, fy, fz = (F.when(v / w > 0.008856, F.pow(v / w, F.lit(1 / 3))).otherwise(7.787 * v / w + 16 / 116) for v, w in zip(xyz, WHITE_POINT))
    return [116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)]


def lab8(r: Column, g: Column, b: Column) -> list[Column]:
    """Lab scaled to 8 bits: L * 255 / 100, a + 128, b + 128."""
    l, a, c = rgb_to_lab(r, g, b)
    return [F.bround(l * 2.55, 0), F.bround(a + 128, 0), F.bround(c + 128, 0)]


def lab_to_rgb(l: Column, a: Column, b: Column) -> list[Column]:
    fy = (l + 16) / 116
    fx, fz = a / 500 + fy, fy - b / 200
    x, y, z = ((F.when(f * f * f > 0.008856, f * f * f).otherwise((f - 16 / 116) / 7.787)) * w / 100 for f, w in zip((fx, fy, fz), WHITE_POINT))
    lin = (x * 3.2406 - y * 1.5372 - z * 0.4986, y * 1.8758 - x * 0.9689 + z * 0.0415, x * 0.0557 - y * 0.2040 + z * 1.0570)
    return [F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(v > 0.0031308, 1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v))) * 255 + 0.5).cast("int") for v in lin]


def rgb_to_hsl(r: Column, g: Column, b: Column) -> list[Column]:
    """All from 0 to 1."""
    r, g, b = (c / F.lit(255.0) for c in (r, g, b))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d, l = hi - lo, (hi + lo) / 2
    s = F.when(d == 0, 0.0).when(l > 0.5, d / (2 - hi - lo)).otherwise(d / (hi + lo))
    h = F.when(d == 0, 0.0).when(hi == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return [h / 6, s, l]


def hsl_to_rgb(h: Column, s: Column, l: Column) -> list[Column]:
    q = F.when(l < 0.5, l * (1 + s)).otherwise(l + s - l * s)
    p = 2 * l - q

    def channel(t):
        t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
        return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)

    return [F.floor(F.when(s == 0, l).otherwise(channel(t)) * 255 + 0.5).cast("int") for t in (h + 1 / 3, h, h - 1 / 3)]


def coarse(c: Column) -> Column:
    """The upper six bits."""
    return F.shiftleft(F.shiftright(c, 2), 2)


def euclidean(a: Column, b: Column) -> Column:
    """Of two arrays of numbers."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def debug_colour(i: Column) -> list[Column]:
    return [((i * step + first) % 255).cast("int") for step, first in zip(DEBUG_STEPS, DEBUG_OFFSETS)]


def seeded_random(seed: Column, n: int) -> Column:
    """The first n values of the generator frac(sin(seed) * 10000) with ascending seeds."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin((seed + i).cast("double")) * RANDOM_FACTOR - F.floor(F.sin((seed + i).cast("double")) * RANDOM_FACTOR))


def manhattan(a: Column, b: Column) -> Column:
    """Of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
