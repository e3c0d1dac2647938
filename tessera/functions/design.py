"""Design arithmetic as column expressions: contrast, grids, sheet yield, frames and scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luminance(colour: Column) -> Column:
    """Relative luminance of ``#RRGGBB``."""

    def channel(at: int) -> Column:
        v = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def column_width(total: Column, margin: Column, gutter: Column, columns: Column) -> Column:
    return (total - 2 * margin - gutter * (columns - 1)) / columns


def stable_floor(x: Column) -> Column:
    return F.floor(x + 1e-9)


def sheet_yield(sheet_w: Column, sheet_h: Column, item_w: Column, item_h: Column, gap: Column) -> Column:
    """The better of both orientations, the upright one on ties: struct of rotated and count."""

    def fit(w: Column, h: Column) -> Column:
        return stable_floor((sheet_w + gap) / (w + gap)) * stable_floor((sheet_h + gap) / (h + gap))

    plain, turned = fit(item_w, item_h), fit(item_h, item_w)
    return F.struct((turned > plain).alias("rotated"), F.greatest(plain, turned).cast("long").alias("count"))


def frames(seconds: Column, rate: Column, mode: str = "ROUND") -> Column:
    x = seconds * rate
    return {"FLOOR": stable_floor(x), "CEIL": F.ceil(x - 1e-9), "ROUND": F.floor(x + 0.5)}[mode].cast("long")


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of positive integers by a bounded Euclidean fold."""
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.when(s["y"] != 0, s["x"] % s["y"]).otherwise(F.lit(0)).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def contrast_passes(ratio: Column) -> dict[str, Column]:
    """The five readability levels; their thresholds are fixed values."""
    least = {"normal_aa": 4.5, "normal_aaa": 7.0, "large_aa": 3.0, "large_aaa": 4.5, "parts_aa": 3.0}
    return {name: ratio >= t for name, t in least.items()}


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def cut_grid(width: Column, height: Column, trim_x: Column, trim_y: Column, gap_x: Column, gap_y: Column, across: Column, down: Column) -> Column:
    """A sheet cut into equal pieces: struct of usable size, sums of gaps, pieces in all and the size of one."""
    w, h, gx, gy = width - trim_x, height - trim_y, gap_x * (across - 1), gap_y * (down - 1)
    return F.struct(
        w.alias("usable_w"), h.alias("usable_h"), (across * down).cast("long").alias("pieces"), rounded(gx).alias("gaps_w"), rounded(gy).alias("gaps_h"), ((w - gx) / across).alias("piece_w"), ((h - gy) / down).alias("piece_h")
    )


def frames_to_seconds(frames: Column, num: Column, den: Column) -> Column:
    """Struct of frames a second, duration in seconds and milliseconds a frame."""
    return F.struct(rounded(num / den).alias("fps"), rounded(frames * den / num).alias("seconds"), rounded(1000 * den / num).alias("frame_ms"))


def round_to_multiple(x: Column, multiple: Column) -> Column:
    return F.greatest(multiple, F.floor(x / multiple + 0.5) * multiple)


def scaled(width: Column, height: Column, target: Column, by_width: Column, multiple: Column) -> Column:
    """A picture size scaled to a target width or height, the other side rounded to a multiple: struct of both sides, scale, error of the aspect in percent, megapixels."""
    scale = F.when(by_width, target / width).otherwise(target / height)
    side = round_to_multiple(F.when(by_width, height * scale).otherwise(width * scale), multiple)
    w, h = F.when(by_width, target).otherwise(side), F.when(by_width, side).otherwise(target)
    own = width / height
    return F.struct(w.cast("long").alias("w"), h.cast("long").alias("h"), rounded(scale).alias("scale"), rounded(F.abs(w / h - own) / own * 100).alias("error_percent"), rounded(w * h / 1_000_000).alias("megapixels"))


# What is wrong with the input of a calculation: names of fields, in order; empty if nothing is.


def _faults(**bad: Column) -> Column:
    return F.array_compact(F.array(*[F.when(is_bad, name) for name, is_bad in bad.items()]))


def layout_faults(width: Column, height: Column, top: Column, bottom: Column, left: Column, right: Column, gutter: Column, columns: Column) -> Column:
    """A page grid needs some height within its margins, and some width beside its gutters."""
    return _faults(margins=height - top - bottom <= 0, columns=width - left - right - gutter * (columns - 1) <= 0)


def yield_faults(width: Column, height: Column, edge: Column) -> Column:
    """A sheet needs some width and some height within its edges; each lack is named."""
    return F.concat(_faults(edgeMarginMm=width - 2 * edge <= 0), _faults(edgeMarginMm=height - 2 * edge <= 0))


def cut_faults(width: Column, height: Column, left: Column, right: Column, top: Column, bottom: Column, gap_x: Column, gap_y: Column, across: Column, down: Column) -> Column:
    """Pieces of a sheet need some width and some height beside trims and gaps."""
    return _faults(horizontalGapMm=width - left - right - gap_x * (across - 1) <= 0, verticalGapMm=height - top - bottom - gap_y * (down - 1) <= 0)


def rate_faults(num: Column, den: Column) -> Column:
    """From a frame in a thousand seconds to a thousand a second."""
    return _faults(frameRate=~(num / den).between(0.001, 1000))


def scale_faults(width: Column, height: Column, target: Column, by_width: Column, multiple: Column, most: int = 100_000) -> Column:
    """The side that follows from the other has from one pixel to ``most``, rounded too."""
    side = F.when(by_width, height * (target / width)).otherwise(width * (target / height))
    return _faults(targetValue=~side.between(1, most) | (round_to_multiple(side, multiple) > most))
