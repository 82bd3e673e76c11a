"""Column -> Column building blocks (all JVM-side unless noted)."""

from kiln.functions.text import (  # noqa: F401
    WHITESPACE, strip, scrub, clean_text, format_details, labelled_text,
)
from kiln.functions.predicates import is_missing, is_blank  # noqa: F401
