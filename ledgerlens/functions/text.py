"""String functions: Unicode-aware strip and URL slugs."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.strip() sees it: Unicode White_Space plus the
# four ASCII information separators (0x1C-0x1F).  (?U) makes Java's \s Unicode.
_EDGE_SPACE = r"(?U)^[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+$"


def strip_unicode(col: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace (not only blanks)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, _EDGE_SPACE, "")


# A–Z lower-cased and a blank turned into '-'; '-' is kept as is.
_SLUG_FROM = string.ascii_uppercase + " "
_SLUG_TO = string.ascii_lowercase + "-"


def slugify(col: Column | str) -> Column:
    """URL slug: ASCII letters lowered, digits and '-' kept, blank → '-', all
    other characters dropped.  Repeated dashes are not collapsed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.translate(c, _SLUG_FROM, _SLUG_TO), "[^a-z0-9-]", "")
