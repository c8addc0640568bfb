"""String rules: blanks, numeric guards, header names, slugs and labels."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from campaign_metrics.schema import CSV_MISSING_TOKENS, SLUG_PREFIX

# PHP is_numeric: optional sign, digits with optional fraction (or leading dot),
# optional exponent, surrounding whitespace allowed. 'NaN', '5d', '0x1A' are not numeric.
NUMERIC_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c) -> Column:
    """Text without spaces, tabs, line ends, NULs and vertical tabs at both ends."""
    return F.btrim(_col(c).cast("string"), F.lit(" \t\n\r\0\x0b"))


def blank(c) -> Column:
    """Null, empty or whitespace-only."""
    return F.coalesce(trimmed(c), F.lit("")) == F.lit("")


def filled(c) -> Column:
    """Trimmed value, or NULL when blank or 'NA' (any case)."""
    t = trimmed(c)
    return F.when(t.isNotNull() & ~F.upper(t).isin(*CSV_MISSING_TOKENS), t)


def first_filled(cols: Iterable) -> Column:
    """First filled value over ordered columns."""
    cols = [filled(c) for c in cols]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def is_numeric(c) -> Column:
    return F.coalesce(_col(c).rlike(NUMERIC_PATTERN), F.lit(False))


def first_numeric(cols: Iterable, default) -> Column:
    """The first *filled* value; if it is not numeric the default applies
    (later aliases are not tried)."""
    v = first_filled(cols)
    return F.when(is_numeric(v), F.trim(v).cast("double")).otherwise(F.lit(default).cast("double"))


def truthy(c) -> Column:
    """PHP truthiness of a string value: NULL, '' and '0' are false."""
    return F.nullif(F.nullif(_col(c), F.lit("")), F.lit("0"))


def normalize_header(name: str) -> str:
    """Lower-case, runs of non-alphanumerics to '_', trimmed of '_'."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def header_forms(name: str) -> list[str]:
    """Original, lower-case and snake forms of a header, de-duplicated in order."""
    out: list[str] = []
    for form in (name, name.lower(), normalize_header(name)):
        if form and form not in out:
            out.append(form)
    return out


def canonical_slug(year, season, prefix: str = SLUG_PREFIX) -> Column:
    """slugify('<prefix> <year> <season>'), null parts omitted."""
    season = _col(season)
    raw = F.concat_ws(" ", F.lit(prefix), _col(year).cast("string"),
                      F.when(F.trim(season) != "", season))
    slug = F.regexp_replace(F.lower(raw), r"[^a-z0-9]+", "-")
    return F.regexp_replace(slug, r"^-+|-+$", "")


def display_name(alias, slug, year, season, prefix: str = SLUG_PREFIX) -> Column:
    """Non-blank alias, else title-cased slug words with the prefix restored."""
    alias_t = F.trim(_col(alias))
    words = F.trim(F.regexp_replace(F.regexp_replace(_col(slug), "-", " "), r"\s+", " "))
    fallback = F.trim(F.concat_ws(" ", _col(year).cast("string"), F.initcap(_col(season))))
    label = F.when(F.coalesce(words, F.lit("")) == "", fallback).otherwise(words)
    lower_prefix = prefix.lower()
    label = F.when(F.lower(label).startswith(lower_prefix), label).otherwise(F.concat(F.lit(prefix + " "), label))
    # Headline: capitalise each word; the brand prefix keeps its own spelling.
    headline = F.initcap(label)
    headline = F.regexp_replace(headline, "^" + prefix.capitalize() + r"\b", prefix)
    return F.when(F.coalesce(alias_t, F.lit("")) != "", alias_t).otherwise(headline)


def season_label(year, season) -> Column:
    """N19: '<year> <Season>', or the year alone without a season."""
    s = trimmed(season)
    return F.when(F.coalesce(s, F.lit("")) == "", _col(year).cast("string")).otherwise(
        F.concat_ws(" ", _col(year).cast("string"), F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))))
