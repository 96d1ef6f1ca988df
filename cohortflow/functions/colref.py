"""Safe column references.

Survey headers carry dots, brackets, full-width punctuation and newlines, so a
bare ``F.col(name)`` would parse ``a.b`` as a struct field.  Always go through
``c(name)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(name: str) -> str:
    return "`" + str(name).replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(quote(name))
