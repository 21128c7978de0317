"""Lengths in px at 96 to the inch, and colours; as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units to the inch.
PER_INCH = {"emu": 914400, "twip": 1440, "point": 72, "half_point": 144, "eighth_point": 576, "master": 576}


def to_px(x: Column, unit: str) -> Column:
    return x * 96.0 / PER_INCH[unit]


def row_height_px(points: Column, otherwise: int = 20) -> Column:
    """Rounded px of a row height in points, at least 1; the default for null, zero and less."""
    return F.when(points > 0, F.greatest(F.lit(1), F.floor(to_px(points, "point") + 0.5))).otherwise(otherwise).cast("int")


def column_width_px(width: Column, digit: int = 7, otherwise: int = 64) -> Column:
    """px of a column width in characters of the widest digit; the default for null, zero and less."""
    chars = F.floor(width * 256 + F.floor(F.lit(128) / digit)) / 256
    return F.when(width > 0, F.greatest(F.lit(1), F.floor(chars * digit))).otherwise(otherwise).cast("int")


def channels(colour: Column) -> Column:
    """array<int> of red, green and blue of #rrggbb."""
    return F.array(*[F.conv(F.substring(colour, 2 * i + 2, 2), 16, 10).cast("int") for i in range(3)])


def colour(rgb: Column) -> Column:
    """#rrggbb of an array of three numbers, rounded and kept in 0 to 255."""
    one = lambda i: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(rgb[i] + 0.5))).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), one(0), one(1), one(2))


def tint(base: Column, amount: Column) -> Column:
    """Darker for a negative amount (by that share), lighter for a positive one; unchanged for 0 and null."""
    dark = F.transform(channels(base), lambda c: c * (1 + amount))
    light = F.transform(channels(base), lambda c: c + (255 - c) * amount)
    return F.when(amount < 0, colour(dark)).when(amount > 0, colour(light)).otherwise(base)


# Shares of the font size that the widest digit takes, by pattern of the font's name; the first that fits counts.
DIGIT_SHARES = (
    ("宋体|新宋体|仿宋|黑体|微软雅黑|simsun|nsimsun|fangsong|simhei|microsoft yahei|ms mincho|mingliu|meiryo|malgun gothic", 0.55),
    ("arial narrow", 0.45), ("calibri", 0.48), ("arial|helvetica|liberation sans", 0.525), ("courier|consolas|monaco|monospace", 0.6),
)


def digit_width(family: Column, size: Column) -> Column:
    """px of the widest digit of a font, at least 1; a font without a size has 11 points."""
    share = F.lit(0.5)
    for pattern, value in reversed(DIGIT_SHARES):
        share = F.when(F.lower(F.coalesce(family, F.lit(""))).rlike(pattern), value).otherwise(share)
    return F.greatest(F.lit(1), F.floor(F.coalesce(size, F.lit(11 * 96 / 72)) * share)).cast("int")


def transform_colour(base: Column, steps: Column) -> Column:
    """#rrggbb after steps (array<struct<type, val>>, in order): tint, shade, lumMod and lumOff in thousandths of a percent."""
    start = F.transform(channels(base), lambda c: c.cast("double"))

    def step(rgb: Column, s: Column) -> Column:
        r = s["val"] / 100000.0
        one = lambda c: F.when(s["type"] == "tint", c + (255 - c) * r).when(s["type"].isin("shade", "lumMod"), c * r).when(s["type"] == "lumOff", c + 255 * r).otherwise(c)
        return F.transform(rgb, one)

    return colour(F.aggregate(steps, start, step))


def scheme_colour(scheme: Column, mapping: Column, name: Column) -> Column:
    """The colour of a name in a theme's scheme (map), by way of the slide's colour map where that renames it."""
    return F.try_element_at(scheme, F.coalesce(F.try_element_at(mapping, name), name))


# The indexed colours of spreadsheets; 0 to 7 are 8 to 15 as well.
INDEXED = (
    "000000 ffffff ff0000 00ff00 0000ff ffff00 ff00ff 00ffff 000000 ffffff ff0000 00ff00 0000ff ffff00 ff00ff 00ffff"
    " 800000 008000 000080 808000 800080 008080 c0c0c0 808080 9999ff 993366 ffffcc ccffff 660066 ff8080 0066cc ccccff"
    " 000080 ff00ff ffff00 00ffff 800080 800000 008080 0000ff 00ccff ccffff ccffcc ffff99 99ccff ff99cc cc99ff ffcc99"
    " 3366ff 33cccc 99cc00 ffcc00 ff9900 ff6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333"
).split()


def indexed_colour(index: Column, palette: list[str] | None = None) -> Column:
    """#rrggbb of an index (a workbook may have a palette of its own); null for an index that is not there."""
    colours = F.array(*[F.lit(f"#{c}") for c in palette or INDEXED])
    return F.when(index >= 0, F.get(colours, index))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def shift_hsl(base: Column, lum_mod: Column, lum_off: Column, sat_mod: Column) -> Column:
    """#rrggbb with lightness times lum_mod plus lum_off and saturation times sat_mod, each kept in 0 to 1."""
    keep = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    def hsl(rgb: Column) -> Column:
        high, low = F.array_max(rgb), F.array_min(rgb)
        spread, total = high - low, high + low
        hue = F.when(high == rgb[0], F.pmod((rgb[1] - rgb[2]) / spread, F.lit(6.0))).when(high == rgb[1], (rgb[2] - rgb[0]) / spread + 2).otherwise((rgb[0] - rgb[1]) / spread + 4)
        plain = spread == 0
        return F.struct(F.when(plain, 0.0).otherwise(2 * hue).alias("h"), keep(F.when(plain, 0.0).otherwise(spread / (1 - F.abs(total - 1))) * sat_mod).alias("s"), keep(total / 2 * lum_mod + lum_off).alias("l"))

    def rgb_of(x: Column) -> Column:
        places = F.transform(F.array(F.lit(0.0), F.lit(8.0), F.lit(4.0)), lambda n: F.pmod(n + x["h"], F.lit(12.0)))
        return F.transform(places, lambda k: 255 * (x["l"] - x["s"] * F.least(x["l"], 1 - x["l"]) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))))

    return _let(_let(_let(F.transform(channels(base), lambda c: c / 255.0), hsl), rgb_of), colour)
