"""Differences between colours as people see them: sRGB to CIE L*a*b* and the CIEDE2000 formula, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.operators.features import color_mean

# sRGB's linear parts to XYZ, and the white of daylight at 6500 K.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def to_lab(df: DataFrame, rgb: tuple[str, str, str] = ("r", "g", "b"), out: tuple[str, str, str] = ("L", "A", "B")) -> DataFrame:
    """df with lightness and the two colour axes of sRGB colours from 0 to 255; null where a channel is."""
    part = {f"_{c}": F.col(c) / F.lit(255.0) for c in rgb}
    linear = {f"_{c}": F.when(F.col(f"_{c}") <= 0.04045, F.col(f"_{c}") / 12.92).otherwise(F.pow((F.col(f"_{c}") + 0.055) / 1.055, 2.4)) for c in rgb}
    xyz = {f"_w{i}": sum((F.col(f"_{c}") * F.lit(m) for c, m in zip(rgb, row, strict=True)), F.lit(0.0)) / F.lit(w) for i, (row, w) in enumerate(zip(TO_XYZ, WHITE, strict=True))}
    bent = {f"_w{i}": F.when(F.col(f"_w{i}") > 216 / 24389, F.cbrt(f"_w{i}")).otherwise((F.col(f"_w{i}") * (24389 / 27) + 16) / 116) for i in range(3)}
    made = df.withColumns(part).withColumns(linear).withColumns(xyz).withColumns(bent)
    values = (F.col("_w1") * 116 - 16, (F.col("_w0") - F.col("_w1")) * 500, (F.col("_w1") - F.col("_w2")) * 200)
    return made.withColumns(dict(zip(out, values, strict=True))).drop(*part, *xyz)


def difference(df: DataFrame, one: tuple[str, str, str] = ("L1", "A1", "B1"), other: tuple[str, str, str] = ("L2", "A2", "B2"), out: str = "difference") -> DataFrame:
    """df with the CIEDE2000 difference of two colours in L*a*b*."""
    (l1, a1, b1), (l2, a2, b2) = (tuple(F.col(c) for c in x) for x in (one, other))
    c = F.col
    hue = lambda a, b: F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise((F.degrees(F.atan2(b, a)) + 360) % 360)
    wave = lambda k, shift: F.cos(F.radians(c("_h") * k + shift))
    seven = lambda x: F.sqrt(F.pow(x, 7) / (F.pow(x, 7) + 25.0**7))
    steps: list[dict[str, Column]] = [
        {"_c": (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2},
        {"_g": (F.lit(1.0) - seven(c("_c"))) * 0.5 + 1},
        {"_p1": a1 * c("_g"), "_p2": a2 * c("_g")},
        {"_c1": F.sqrt(c("_p1") * c("_p1") + b1 * b1), "_c2": F.sqrt(c("_p2") * c("_p2") + b2 * b2), "_h1": hue(c("_p1"), b1), "_h2": hue(c("_p2"), b2)},
        {"_grey": c("_c1") * c("_c2") == 0, "_d": c("_h2") - c("_h1"), "_lm": (l1 + l2) / 2, "_cm": (c("_c1") + c("_c2")) / 2},
        {"_turn": F.when(c("_grey"), F.lit(0.0)).when(c("_d") > 180, c("_d") - 360).when(c("_d") < -180, c("_d") + 360).otherwise(c("_d"))},
        # the mean of two hues lies between them the short way round
        {"_h": F.when(c("_grey"), c("_h1") + c("_h2")).when(F.abs("_d") <= 180, (c("_h1") + c("_h2")) / 2).when(c("_h1") + c("_h2") < 360, (c("_h1") + c("_h2") + 360) / 2).otherwise((c("_h1") + c("_h2") - 360) / 2)},
        {"_t": F.lit(1.0) - wave(1, -30) * 0.17 + wave(2, 0) * 0.24 + wave(3, 6) * 0.32 - wave(4, -63) * 0.20, "_u": F.pow(c("_lm") - 50, 2)},
        {"_r": F.sin(F.radians(F.exp(-F.pow((c("_h") - 275) / 25, 2)) * 60)) * seven(c("_cm")) * -2},
        {"_dl": (l2 - l1) / (c("_u") * 0.015 / F.sqrt(c("_u") + 20) + 1), "_dc": (c("_c2") - c("_c1")) / (c("_cm") * 0.045 + 1), "_dh": F.sqrt(c("_c1") * c("_c2")) * F.sin(F.radians(c("_turn") / 2)) * 2 / (c("_cm") * c("_t") * 0.015 + 1)},
    ]
    made = df
    for s in steps:
        made = made.withColumns(s)
    squared = c("_dl") * c("_dl") + c("_dc") * c("_dc") + c("_dh") * c("_dh") + c("_r") * c("_dc") * c("_dh")
    return made.withColumn("_s", squared).withColumn(out, F.sqrt(F.when(F.col("_s") < 0, F.lit(0.0)).otherwise(F.col("_s")))).drop("_s", *[k for s in steps for k in s])


def differences_to_mean(colors: DataFrame) -> DataFrame:
    """(specimen_id, point_id, difference): how far each specimen's colour at a point is from the mean colour there."""
    mean = to_lab(color_mean(colors), out=("L2", "A2", "B2")).drop("r", "g", "b")
    return difference(to_lab(colors, out=("L1", "A1", "B1")).join(mean, "point_id")).select("specimen_id", "point_id", "difference")


def differences_of_pairs(colors: DataFrame) -> DataFrame:
    """(specimen_1, specimen_2, points, mean, greatest): for each two specimens the differences over the points that have both colours."""
    lab = to_lab(colors).where("L is not null").select("specimen_id", "point_id", "L", "A", "B")
    side = lambda k: lab.select(F.col("specimen_id").alias(f"specimen_{k}"), "point_id", *[F.col(c).alias(f"{c}{k}") for c in "LAB"])
    both = side(1).join(side(2), "point_id").where("specimen_1 < specimen_2")
    return difference(both).groupBy("specimen_1", "specimen_2").agg(F.count("*").alias("points"), F.avg("difference").alias("mean"), F.max("difference").alias("greatest"))
