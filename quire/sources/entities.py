"""HTML character references."""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: References whose decoding needs no table of code points; &amp; comes last, so that no reference is made by decoding.
COMMON = ["lt", "gt", "quot", "apos", "nbsp", "mdash", "ndash", "hellip", "lsquo", "rsquo", "ldquo", "rdquo", "sect", "copy", "middot", "bull", "pound", "deg", "amp"]


def named(name: str) -> str:
    """The character of a reference; a no-break space is read as a space."""
    return " " if name == "nbsp" else html.unescape(f"&{name};")


def decode_entities(t: Column) -> Column:
    """Decodes the common references."""
    return reduce(lambda c, n: F.replace(c, F.lit(f"&{n};"), F.lit(named(n))), COMMON, t)
