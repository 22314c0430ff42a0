"""Colours as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colour names and their channels.
NAMED = {
    "red": (1.0, 0.0, 0.0),
    "green": (0.0, 1.0, 0.0),
    "blue": (0.0, 0.0, 1.0),
    "yellow": (1.0, 1.0, 0.0),
    "orange": (1.0, 0.5, 0.0),
    "purple": (0.5, 0.0, 0.5),
    "pink": (1.0, 0.75, 0.8),
    "cyan": (0.0, 1.0, 1.0),
    "magenta": (1.0, 0.0, 1.0),
    "black": (0.0, 0.0, 0.0),
    "white": (1.0, 1.0, 1.0),
    "gray": (0.5, 0.5, 0.5),
    "grey": (0.5, 0.5, 0.5),
}
_HEX = "^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"


def channels(color: Column) -> Column:
    """struct(r, g, b), 0 to 1, of #rgb, #rrggbb or a name; null for anything else."""
    full = F.when(F.length(color) == 4, F.regexp_replace(F.substr(color, F.lit(2)), "(.)", "$1$1")).otherwise(F.substr(color, F.lit(2)))
    part = lambda at: F.conv(F.substr(full, F.lit(at), F.lit(2)), 16, 10).cast("double") / 255
    by_hex = F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))
    named = F.lit(None).cast("struct<r:double,g:double,b:double>")
    for name, rgb in NAMED.items():
        value = F.struct(*[F.lit(c).alias(k) for c, k in zip(rgb, "rgb", strict=True)])
        named = F.when(F.lower(color) == name, value).otherwise(named)
    return F.when(F.rlike(color, F.lit(_HEX)), by_hex).otherwise(named)
