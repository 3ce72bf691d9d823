"""Text expressions used to harmonise names and addresses."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word keeps inner apostrophes and dots; everything else separates words.
_WORD_OR_GAP = r"([\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_]+)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def literal_pattern(text: str) -> str:
    """Java regular expression that matches ``text`` literally."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-#])", r"\\\1", text)


def title_case(col: Column | str) -> Column:
    """Title case that also starts a word after a hyphen, slash or bracket."""
    pieces = F.regexp_extract_all(_c(col), F.lit(_WORD_OR_GAP), F.lit(1))
    return F.array_join(F.transform(pieces, F.initcap), "")


def remove_first(col: Column | str, pattern: str) -> Column:
    """Remove the first match of a regular expression only."""
    return F.regexp_replace(_c(col), f"(?s)^(.*?)(?:{pattern})", "$1")


def remove_first_text(col: Column | str, text: str) -> Column:
    """Remove the first occurrence of a fixed text only."""
    return remove_first(col, literal_pattern(text))


def remove_first_of(col: Column | str, needle: Column | str, literal: bool = True) -> Column:
    """Remove the first occurrence of another column's value.

    ``literal=False`` reads the other column as a regular expression.
    """
    c, n = _c(col), _c(needle)
    if literal:
        at = F.position(n, c)
        cut = F.concat(
            F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(n), F.length(c))
        )
        return F.when(at > 0, cut).when(at == 0, c)
    return F.regexp_replace(c, F.concat(F.lit("(?s)^(.*?)(?:"), n, F.lit(")")), F.lit("$1"))


def trim_space(col: Column | str) -> Column:
    """Strip all white space (not only blanks) at both ends."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def prefix(col: Column | str, n: int) -> Column:
    return F.substring(_c(col), 1, n)


def paste(*cols: Column | str, sep: str = " ", na: str = "NA") -> Column:
    """Join texts; a missing part is written out as ``na``."""
    return F.concat_ws(sep, *[F.coalesce(_c(c), F.lit(na)) for c in cols])


def piece(col: Column | str, delimiter: str, index: int, limit: int = -1) -> Column:
    """Piece ``index`` after splitting on a fixed delimiter; NULL past the end.

    ``limit`` keeps the remainder joined in the last piece.
    """
    return F.get(F.split(_c(col), literal_pattern(delimiter), limit), F.lit(index))


def split_columns(
    col: Column | str, delimiter: str, names: Sequence[str], surplus: str = "error"
) -> dict[str, Column]:
    """Named pieces; too few give NULL on the right.

    ``surplus``: more pieces than names are an error, are merged into the last piece
    ("merge"), or are left out ("drop").
    """
    if surplus not in ("error", "merge", "drop"):
        raise ValueError(f"surplus pieces can't be treated by {surplus!r}")
    text = _c(col)
    parts = F.split(text, literal_pattern(delimiter), len(names) if surplus == "merge" else -1)
    out = {n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}
    if surplus == "error":
        told = F.raise_error(F.concat(F.lit(f"more than {len(names)} parts: "), text)).cast("string")
        out = {n: F.when(F.size(parts) > len(names), told).otherwise(c) for n, c in out.items()}
    return out


def piece_count(col: Column | str, delimiter: str) -> Column:
    return F.size(F.split(_c(col), literal_pattern(delimiter), -1))


def before_any(col: Column | str, delimiters: Sequence[str]) -> Column:
    """Text before the first occurrence of any of several fixed delimiters."""
    out = _c(col)
    for d in delimiters:
        out = F.substring_index(out, d, 1)
    return out


def listed_or_starts(col: Column | str, listed: Sequence[str], prefixes: Sequence[str], trait: str | None = None) -> Column:
    """Is the value listed, or does it start with one of the prefixes and is not ``trait``?

    One expression reads the value once: written as many comparisons, a value that is itself a long expression would be
    worked out once for each of them.
    """
    either = "|".join([f"(?:{literal_pattern(v)})\\z" for v in listed] + [literal_pattern(p) for p in prefixes])
    other = "" if trait is None else f"(?!{literal_pattern(trait)}\\z)"
    return _c(col).rlike(f"\\A{other}(?:{either})")


def recode(col: Column | str, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Value lookup in a small fixed mapping; unmatched rows take ``default``."""
    c = _c(col)
    if not mapping:
        return c if default is None else default
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(c if default is None else default)


def tract_id(county_code: Column | str, tract: Column | str) -> Column:
    """Eleven-character tract id from a county code and a number such as ``12.1``.

    The part before the dot is padded to four places on the left, the part after
    it to the remaining places on the right.
    """
    whole = piece(tract, ".", 0)
    part = F.coalesce(piece(tract, ".", 1), F.lit(""))
    whole = F.when(F.length(whole) < 4, F.lpad(whole, 4, "0")).otherwise(whole)
    body = F.concat(whole, part)
    body = F.when(F.length(body) < 6, F.rpad(body, 6, "0")).otherwise(body)
    return F.concat(_c(county_code), body)
