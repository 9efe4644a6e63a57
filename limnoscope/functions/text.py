"""Text helpers for names, headers and search."""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Accented letters of the sensor pages and their plain forms.
_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def strip_accents(text: Column) -> Column:
    """Plain letters; any other character beyond ASCII is dropped. Most texts have none and are left as they are."""
    plain = F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)


def name_key(name: Column) -> Column:
    """Lookup form of a reservoir name."""
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def alias_key(name: Column) -> Column:
    """Accent- and case-blind form used to look up aliases."""
    return F.lower(strip_accents(F.trim(name)))


def safe_band_name(name: str) -> str:
    return name.replace("/", "_")


def calibrated_band_name(target: Column) -> Column:
    """`Calibrated_` and the target with anything but letters and digits as `_`."""
    cleaned = F.regexp_replace(target, r"[^\p{L}\p{N}]", "_")
    trimmed = F.regexp_replace(cleaned, r"^_+|_+$", "")
    safe = F.when(F.length(trimmed) > 0, trimmed).otherwise(F.lit("calibrated"))
    return F.substring(F.concat(F.lit("Calibrated_"), safe), 1, 80)


def any_column_contains(columns: Sequence[str], term: str) -> Column:
    """Case-blind search in the text form of the given columns; `%` and `_` are wildcards."""
    hits = [F.coalesce(F.col(c).cast("string").ilike(f"%{term}%"), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


# Entities met in the sensor tables.
_ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"',
    "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó",
    "&uacute;": "ú", "&ntilde;": "ñ", "&amp;": "&",
}


def plain_cell(html: Column) -> Column:
    """Visible text of a table cell; the replacements run only where there is something to replace."""
    bare = F.when(html.contains("<"), F.regexp_replace(html, r"(?s)<[^>]*>", "")).otherwise(html)
    decoded = bare
    for entity, plain in _ENTITIES.items():
        decoded = F.replace(decoded, F.lit(entity), F.lit(plain))
    decoded = F.when(html.contains("&"), decoded).otherwise(bare)
    return F.trim(F.regexp_replace(decoded, r"\s+", " "))
