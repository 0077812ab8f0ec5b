"""Fill a text template from columns."""

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, **values: Column) -> Column:
    """Concat of the template's literal pieces and the named columns; a null value counts as ''.

    ``{{`` and ``}}`` stand for braces, as in ``str.format``.
    """
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*pieces)
