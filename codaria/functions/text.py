"""Text functions as Column expressions; only NFKC needs Python, batch-wise over Arrow.

Word and white-space classes are spelled out, since Java's \\w and \\s are ASCII
and the records' are Unicode.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"\p{L}\p{N}_"
# White space beyond Latin-1 is behind an intersection with its range, and what is in Latin-1 is spelled out,
# since Java tests a class's ranges one by one for every character but has a bitmap for single ones.
_WIDE = "[ -　&&[  -     　]]"
_NARROW = r"\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x85\xA0"
SPACE = r"\x09\x0A" + _NARROW + _WIDE
#: White space but the line end.
BLANK = r"\x09" + _NARROW + _WIDE
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
# Code points without width that are dropped.
ZERO_WIDTH = "[\u00ad[\u200b-\ufeff&&[\u200b-\u200f\u202a-\u202e\ufeff]]]"
# Lower-case letters that only Vietnamese text has.
VIETNAMESE = "ăắằẳẵặâấầẩẫậđêếềểễệôốồổỗộơớờởỡợưứừửữự"
# Line prefixes that end a title.
STRUCTURE = ("incl", "excl", "use additional", "bao gồm", "loại trừ", "sử dụng mã")
ROMAN = ("I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI XXII").split()


def _re(column: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(column, pattern, to)


def strip(column: Column) -> Column:
    """Trims all Unicode white space."""
    return F.btrim(column, F.lit(_SPACES))


def nfkc(column: Column) -> Column:
    """Unicode normal form KC; ASCII text is returned as it is."""

    def normal(text: pa.Array) -> pa.Array:
        return pa.array((unicodedata.normalize("NFKC", t.as_py()) if t.is_valid else None for t in text), pa.string())

    # ASCII text isn't sent to the workers, and they hold one text at a time as Python's
    wide = F.octet_length(column) != F.char_length(column)
    return F.coalesce(F.arrow_udf(normal, StringType())(F.when(wide, column)), column)


def document_text(text: Column, normal_form: Callable[[Column], Column] = nfkc) -> Column:
    """Normalised document text: NFKC, \\n line ends, no zero-width characters, single spaces, and punctuation spacing.

    White space before .,;:!? goes, line ends too; a space follows it unless white space or a digit does.
    """
    out = _re(normal_form(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    out = _re(out, ZERO_WIDTH)
    out = _re(out, f"[{BLANK}]+", " ")
    out = _re(out, f"[{SPACE}]+([.,;:!?])", "$1")
    out = _re(out, rf"([.,;:!?])([^{SPACE}\p{{Nd}}])", "$1 $2")
    return strip(out)


def retrieval_text(normalised: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    out = _re(F.lower(normalised), f"[^{WORD}{SPACE}]", " ")
    return strip(_re(out, f"[{SPACE}]+", " "))


def mention_text(surface: Column, normal_form: Callable[[Column], Column] = nfkc) -> Column:
    return strip(_re(_re(normal_form(surface), ZERO_WIDTH), f"[{SPACE}]+", " "))


def alias_key(text: Column) -> Column:
    """Lower case, single spaces, no trailing .,:;"""
    out = strip(_re(F.lower(text), f"[{SPACE}]+", " "))
    return strip(_re(out, r"[.,:;]+$"))


def title_text(text: Column) -> Column:
    """Trimmed, runs of plain spaces as one; tabs stay."""
    return strip(_re(text, " {2,}", " "))


def ontology_alias_key(text: Column) -> Column:
    return title_text(F.lower(text))


def rule_text(text: Column) -> Column:
    return strip(_re(text, f"[{SPACE}]+", " "))


def page_text(text: Column, single_spaces: bool = False) -> Column:
    """\\n line ends, trimmed, at most one empty line in a row."""
    out = _re(strip(_re(text, r"\r\n?", "\n")), r"\n{3,}", "\n\n")
    return _re(out, " {2,}", " ") if single_spaces else out


def nos_form(text: Column) -> Column:
    """The first NOS or KXĐK as a word, in capitals; null if there is none."""
    found = F.regexp_extract(text, rf"(?iu)(?<![{WORD}])(nos|kxđk)(?![{WORD}])", 1)
    return F.when(found != "", F.upper(found))


def hash8(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def chapter_id(roman: Column) -> Column:
    """I..XXII to Ch-1..Ch-22, else null."""
    place = F.array_position(F.array(*[F.lit(r) for r in ROMAN]), F.upper(roman))
    return F.when(place > 0, F.concat(F.lit("Ch-"), place.cast("string")))


def is_vietnamese(line: Column) -> Column:
    return line.rlike(f"[{VIETNAMESE}]")


def chapter_heading(line: Column) -> Column:
    """The Roman numeral of a chapter heading, or an empty string."""
    return F.regexp_extract(line, rf"^(?iu:chapter|chương)[{SPACE}]+((?i)X{{0,3}}IX|X{{0,3}}IV|X{{0,3}}V?I{{0,3}})(?![{WORD}])", 1)


def is_structural(line: Column) -> Column:
    heading = line.rlike(rf"^(?iu:chapter|chương)[{SPACE}]+(?i:X{{0,3}}IX|X{{0,3}}IV|X{{0,3}}V?I{{0,3}})(?![{WORD}])")
    return F.lower(line).rlike("^(" + "|".join(STRUCTURE) + ")") | line.rlike(r"\([A-Z]\p{Nd}{2}-[A-Z]\p{Nd}{2}\)") | heading


def code_line(line: Column) -> Column:
    """The three-character code that is the whole trimmed line, or an empty string."""
    return F.regexp_extract(line, r"^([A-Z]\p{Nd}{2})$", 1)


def subcode_line(line: Column, group: int) -> Column:
    """Of a four-character line, the code (1) or title (2)."""
    return F.regexp_extract(line, rf"^([A-Z]\p{{Nd}}{{2}})\.\p{{Nd}}+[†*]?[{SPACE}]+([^\n]+)$", group)


def leading_code(line: Column) -> Column:
    """The code that a line begins with, as a word."""
    return F.regexp_extract(line, rf"^([A-Z]\p{{Nd}}{{2}})(?![{WORD}])", 1)


def is_full_form(text: Column) -> Column:
    """At least three characters, one of them lower case."""
    return (F.length(text) >= 3) & text.rlike(r"\p{IsLowercase}")


def fold_key(text: Column) -> Column:
    return strip(F.lower(text))


def space_tokens(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.array_remove(F.split(F.lower(text), f"[{SPACE}]+"), "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts between .!? with white space and an upper-case letter, trimmed; empty ones go."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?])[{SPACE}]+(?=\p{{Lu}})"), strip), lambda s: s != "")


def query_text(retrieval: Column, normalised: Column) -> Column:
    """Retrieval text, or normalised text if that is null or empty."""
    return F.when(F.length(retrieval) > 0, retrieval).otherwise(normalised)


def best_text(normalised: Column, retrieval: Column, raw: Column) -> Column:
    """The first of normalised, retrieval and raw text that isn't empty; raises if none is."""
    pick = F.coalesce(*[F.when(F.length(c) > 0, c) for c in (normalised, retrieval, raw)])
    return F.when(pick.isNotNull(), pick).otherwise(F.raise_error(F.lit("document has no text")))


def search_text(code: Column, title_vi: Column, title_en: Column, aliases: Column) -> Column:
    return F.concat_ws(" | ", code, title_vi, F.nullif(title_en, F.lit("")), aliases)


def label_prompt(code: Column, title_vi: Column, title_en: Column, search: Column, max_chars: int = 256) -> Column:
    """Lines of code, titles and a compact descriptor that differs from both titles."""
    brief = strip(_re(F.substring(search, 1, max_chars), f"[{SPACE}]+", " "))
    fresh = (F.lower(brief) != F.lower(F.coalesce(title_vi, F.lit("")))) & (F.lower(brief) != F.lower(F.coalesce(title_en, F.lit("")))) & (brief != "")
    return F.concat_ws("\n", code, F.nullif(title_vi, F.lit("")), F.nullif(title_en, F.lit("")), F.when(fresh, brief))
