"""Text expressions: folding, tokens and sentence patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What folding strips from both ends: space, tab, no-break space.
BLANKS = " \t\u00a0"
UNKNOWN = "<unk>"


def fold(col: Column | str) -> Column:
    """Lower case without leading and trailing space, tab or no-break space; null stays null."""
    return F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS)))


def fold_term(col: Column | str) -> Column:
    """The folded value, or null where it is blank or the sign for no label."""
    folded = fold(col)
    return F.when((folded != "") & (folded != UNKNOWN), folded)
