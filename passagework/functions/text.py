"""String expressions: white space, truncation, previews."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.isspace() accepts, as a regex class both Java and RE2 read.
WHITE_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def strip_text(col: Column) -> Column:
    """Remove leading and trailing white space of any script."""
    return F.regexp_replace(F.regexp_replace(col, f"^{WHITE_SPACE}+", ""), f"{WHITE_SPACE}+$", "")


def has_text(col: Column) -> Column:
    """True when some character is not white space; null counts as blank."""
    return F.coalesce(col.rlike("[^" + WHITE_SPACE[1:]), F.lit(False))


def truncate_text(col: Column, limit: int = 800) -> Column:
    """First ``limit`` code points, then the number of code points left out."""
    rest = F.length(col) - F.lit(limit)
    return F.when(
        rest > 0,
        F.concat(F.substring(col, 1, limit), F.lit("… [+"), rest.cast("string"), F.lit(" chars]")),
    ).otherwise(col)


def page_preview(col: Column, limit: int = 1200) -> Column:
    """Page body cut at ``limit`` (0 keeps all) with the remaining count; a blank body shows as ``<empty>``."""
    body = F.substring(col, 1, limit) if limit else col
    shown = F.when(has_text(body), body).otherwise(F.lit("<empty>"))
    if not limit:
        return shown
    rest = F.length(col) - F.lit(limit)
    note = F.concat(F.lit("  … (+"), F.format_number(rest, 0), F.lit(" more chars)"))
    return F.concat(shown, F.when(rest > 0, note).otherwise(F.lit("")))


def join_ordered(order: list[Column], text: Column, separator: str) -> Column:
    """Aggregate: texts of a group joined in the given order."""
    fields = [c.alias(f"o{i}") for i, c in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.struct(*fields, text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def file_extension(name: Column) -> Column:
    """Lower-cased extension of the last path part; leading dots do not start an extension."""
    last = F.element_at(F.split(name, "/"), -1)
    return F.lower(F.regexp_extract(last, r"(?s)[^.].*\.([^.]*)$", 1))


def unescape_markup(col: Column) -> Column:
    """Decode the five named XML entities and numeric character references."""

    def decode(piece: Column) -> Column:
        code = F.when(
            piece.rlike("^&#[xX]"), F.conv(F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]+);$", 1), 16, 10)
        ).otherwise(F.regexp_extract(piece, "^&#([0-9]+);$", 1))
        wide = F.lpad(F.hex(code.cast("bigint")), 8, "0")
        return F.when(piece.rlike("^&#(x[0-9A-Fa-f]{1,6}|X[0-9A-Fa-f]{1,6}|[0-9]{1,7});$"),
                      F.decode(F.unhex(wide), "UTF-32")).otherwise(piece)

    pieces = F.regexp_extract_all(col, F.lit(r"&#[xX]?[0-9A-Fa-f]+;|[^&]+|&"), F.lit(0))
    named = F.when(col.contains("&#"), F.array_join(F.transform(pieces, decode), "")).otherwise(col)
    # The predefined XML entities, ampersand last so nothing is decoded twice.
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        named = F.replace(named, F.lit(entity), F.lit(plain))
    return named
