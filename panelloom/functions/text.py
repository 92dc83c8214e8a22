"""Text clean-up as built-in expressions.

Accent stripping is "compatibility-decompose, then drop combining marks".
Spark has no normaliser, but because *every* combining mark is dropped the
result can be stated per character, so lookup tables built once from Python's
Unicode data give the exact answer inside the JVM, with no Python worker.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import once

# Every white-space character.
_WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
# No character above this one decomposes or combines.
_LAST_DECOMPOSING = 0x2FFFF


@lru_cache(maxsize=1)
def _decomposition_tables() -> tuple[str, str, dict[str, str]]:
    """(chars to replace or delete, their replacements, multi-character map).

    ``translate`` deletes characters that have no partner, so the deletions
    are placed last.
    """
    single: list[tuple[str, str]] = []
    deleted: list[str] = []
    multi: dict[str, str] = {}
    for code in range(0x80, _LAST_DECOMPOSING + 1):
        if _HANGUL_FIRST <= code <= _HANGUL_LAST or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if plain == char:
            continue
        if not plain:
            deleted.append(char)
        elif len(plain) == 1:
            single.append((char, plain))
        else:
            multi[char] = plain
    source = "".join(a for a, _ in single) + "".join(deleted)
    return source, "".join(b for _, b in single), multi


def _letter(first: int, last: int, index: Column) -> Column:
    """The letter at ``index`` (from 0) of a run of code points."""
    run = F.lit("".join(map(chr, range(first, last + 1))))
    return F.substring(run, index.cast("int") + 1, F.lit(1))


def _expand_hangul(char: Column) -> Column:
    """A precomposed Hangul syllable as its two or three letters."""
    index = F.ascii(char) - F.lit(_HANGUL_FIRST)
    vowel = F.floor(F.pmod(index, F.lit(588)) / 28)
    tail = F.pmod(index, F.lit(28))
    return F.concat(
        _letter(0x1100, 0x1112, F.floor(index / 588)),
        _letter(0x1161, 0x1175, vowel),
        F.when(tail > 0, _letter(0x11A8, 0x11C2, tail - 1)).otherwise(""),
    )


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip_accents(value: Column | str) -> Column:
    """Decompose every character and drop the combining marks.

    ASCII text, the common case, costs one count of its bytes and Latin letters
    one pass of ``translate``; only text with other scripts is looked at further.
    """
    text = F.col(value) if isinstance(value, str) else value
    source, target, multi = _decomposition_tables()
    long = "".join(multi)
    # Latin letters that stay as they are, like the sharp s.
    plain_latin = "".join(
        chr(c) for c in range(0x80, 0x250) if chr(c) not in source and chr(c) not in multi
    )

    def letters(char: Column) -> Column:
        # One literal string parsed into a map keeps the plan small.
        pairs = F.str_to_map(
            F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in multi.items())),
            F.lit("\x1e"),
            F.lit("\x1f"),
        )
        is_hangul = char.between(chr(_HANGUL_FIRST), chr(_HANGUL_LAST))
        return (
            F.when(is_hangul, _expand_hangul(char))
            .when(F.contains(F.lit(long), char), F.try_element_at(pairs, char))
            .otherwise(char)
        )

    def expand(mapped: Column) -> Column:
        has_multi = (F.translate(mapped, long, "") != mapped) | mapped.rlike("[가-힣]")
        expanded = F.array_join(F.transform(F.split(mapped, ""), letters), "")
        latin = _is_ascii(mapped) | _is_ascii(F.translate(mapped, plain_latin, ""))
        return F.when(~latin & has_multi, expanded).otherwise(mapped)

    stripped = once(F.translate(text, source, target), expand)
    return F.when(_is_ascii(text), text).otherwise(stripped)


def plain_words(value: Column | str, keep: str = "") -> Column:
    """Accent-free lower case with everything but letters, digits and ``keep`` as blanks."""
    plain = F.lower(strip_accents(value))
    return F.regexp_replace(
        F.replace(plain, F.lit("&"), F.lit(" and ")), f"[^a-z0-9{keep}]+", " "
    )


def normalize_text(value: Column | str) -> Column:
    """Accent-free lower-case words separated by single blanks; NULL gives ''."""
    return F.coalesce(F.trim(plain_words(value)), F.lit(""))


def normalize_name(value: Column | str) -> Column:
    """:func:`normalize_text` with underscores: column identifiers and file slugs."""
    return F.replace(normalize_text(value), F.lit(" "), F.lit("_"))


def title_label(value: Column | str) -> Column:
    """``lower_case_name`` as ``Lower Case Name``."""
    text = F.col(value) if isinstance(value, str) else value
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def strip_space(value: Column | str) -> Column:
    """Drop white space of any kind at both ends (plain ``trim`` drops blanks only)."""
    text = F.col(value) if isinstance(value, str) else value
    return F.trim(text, F.lit(_WHITE_SPACE))
