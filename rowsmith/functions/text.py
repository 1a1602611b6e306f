"""Text cleaning and path names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Fixed value: the Hangul syllables, as a regex character range.
HANGUL = "가-힣"

# White space as Python's str methods and re see it. Java's Unicode-aware \s leaves
# out the four separators U+001C to U+001F.
_SPACE = r"\s\x1c-\x1f"


def keep_script(col: Column | str, char_class: str = HANGUL) -> Column:
    """Keep the characters of `char_class` and white space; collapse and trim the space.

    Null gives the empty string.
    """
    col = F.col(col) if isinstance(col, str) else col
    kept = F.regexp_replace(col, f"(?U)[^{char_class}{_SPACE}]+", "")
    spaced = F.regexp_replace(kept, f"(?U)[{_SPACE}]+", " ")
    # Most words have nothing to take away, and one plain match tells so.
    whole = F.when(col.rlike(rf"\A[{char_class}]*\z"), col).otherwise(F.trim(spaced))
    return F.coalesce(whole, F.lit(""))


def strip_space(col: Column | str) -> Column:
    """Without white space at both ends, of all kinds that Python's strip takes away."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(col, f"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")


def base_name(path: Column | str) -> Column:
    """Last part of a path that may use / or \\ as separator."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)


def uri_path(path: Column | str) -> Column:
    """A path as it was written, from its URI form, in which other signs are %xx; + is itself."""
    path = F.col(path) if isinstance(path, str) else path
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def full_path(path: Column | str, roots: Mapping[str, str] | None = None) -> Column:
    """A path with / as its only separator, without scheme; the roots named are exchanged.

    Two paths of one file, as two systems see it, become the same text.
    """
    path = F.col(path) if isinstance(path, str) else path
    plain = F.regexp_replace(F.regexp_replace(path, r"[/\\\\]+", "/"), "^[A-Za-z][A-Za-z0-9+.-]+:(?=/)", "")
    mapped = plain
    for old, new in (roots or {}).items():
        old, new = old.replace("\\", "/").rstrip("/"), new.rstrip("/")
        mapped = F.when(plain.startswith(f"{old}/"), F.concat(F.lit(new), F.substr(plain, F.lit(len(old) + 1)))).otherwise(mapped)
    return mapped


def dir_name(path: Column | str) -> Column:
    """Everything before the last separator."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]+$", 1)


def stem(path: Column | str) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def output_name(path: Column | str) -> Column:
    """Name of the image written for an input image."""
    return F.concat(stem(path), F.lit("_translated_replace_on_original.jpg"))
