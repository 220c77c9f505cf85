"""``{{ a.b }}`` templates turned into Column expressions once, on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLOT = re.compile(r"\{\{\s*([A-Za-z_][\w.]*)\s*\}\}")


def interpolate(template: object) -> Column:
    """A lone ``{{ path }}`` keeps the column's type; anything else becomes text.

    An unknown path fails when Spark analyses the plan, before any row is read.
    """
    if not isinstance(template, str):
        return F.lit(template)
    alone = _SLOT.fullmatch(template.strip())
    if alone:
        return F.col(alone.group(1))
    pieces, end = [], 0
    for slot in _SLOT.finditer(template):
        if slot.start() > end:
            pieces.append(F.lit(template[end : slot.start()]))
        pieces.append(F.coalesce(F.col(slot.group(1)).cast("string"), F.lit("")))
        end = slot.end()
    if not pieces:
        return F.lit(template)
    if end < len(template):
        pieces.append(F.lit(template[end:]))
    return F.concat(*pieces)
