"""Text identity, length, truncation and whitespace diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 29 characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Remove surrounding Unicode whitespace, as Python's ``str.strip`` does.

    A trim looks at the edges only; a regular expression would try every gap in the text.
    """
    return F.btrim(_col(text), F.lit(WHITESPACE))


def text_id(text: Column | str) -> Column:
    """Identity of a text: hex md5 of the stripped text."""
    return F.md5(strip(text))


def text_len(text: Column | str) -> Column:
    """Length in code points."""
    return F.char_length(_col(text))


def excerpt(text: Column | str, width: int = 100) -> Column:
    """The first ``width`` characters, for report tables."""
    return F.substring(_col(text), 1, width)


def starts_with_newline(text: Column | str) -> Column:
    return F.startswith(_col(text), F.lit("\n"))


def ends_with_newline(text: Column | str) -> Column:
    return F.endswith(_col(text), F.lit("\n"))


def cache_key(model: Column | str, text: Column | str, rep: Column | str) -> Column:
    """Key of one annotation call: md5 of ``model|text|{"rep": n}``."""
    return F.md5(F.concat(_col(model), F.lit("|"), _col(text), F.lit('|{"rep": '),
                          _col(rep).cast("string"), F.lit("}")))


def uniform(identity: Column | str, seed: int | str) -> Column:
    """A uniform draw in (0, 1] that depends only on the row's identity and the seed.

    A retried or re-planned task draws the same number, unlike ``rand()``.
    """
    digest = F.md5(F.concat(_col(identity).cast("string"), F.lit(str(seed))))
    word = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return (word + F.lit(1.0)) / F.lit(4294967296.0)


def shuffle_key(identity: Column | str, seed: int | str) -> Column:
    """A seeded pseudo-random order key: md5 of identity and seed, as hex."""
    return F.md5(F.concat(_col(identity).cast("string"), F.lit("|"), F.lit(str(seed))))
