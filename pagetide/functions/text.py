"""Column functions on page text: cleaning, fingerprints, change labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Unicode white space plus the four ASCII separators, the class that counts as white space in Python.
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Remove white space, Unicode included, at both ends. A long run inside the text is looked at once."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def clean_html(html: Column) -> Column:
    """Drop scripts, styles and comments, and make every run of white space one blank."""
    for pattern in (r"(?is)<script.*?</script\s*>", r"(?is)<style.*?</style\s*>", r"(?s)<!--.*?-->"):
        html = F.regexp_replace(html, pattern, "")
    return F.trim(F.regexp_replace(html, rf"(?U){SPACE}+", " "))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(text.cast("binary"), 256)


def truthy(text: Column) -> Column:
    """Neither NULL nor empty."""
    return F.coalesce(text != "", F.lit(False))


def change_label(current: Column, previous: Column) -> Column:
    """new, updated or unchanged."""
    return (
        F.when(~truthy(previous), "new").when(current != previous, "updated").otherwise("unchanged")
    )
