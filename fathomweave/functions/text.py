"""Column functions over text: headers, clauses, captions, sentences, chunks, names, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns decide what is a header, a clause or a caption.
HEADER_NUMBERED = r"^\d+(\.\d+)*\s+"
HEADER_ANNEX = r"^[A-Z]\.\d+(\.\d+)*\s+[A-Z]"
HEADER_ONTOLOGY = r"^[A-Z]?\.?\d+(\.\d+)*\s+"
HEADER_CLAUSE = r"^\d+(\.\d+)*\s+[A-Z]"
HEADER_TITLE = r"^([0-9]+|[A-Z])[.)]?\s+[A-Z][a-z]"
CLAUSE = r"^(\d+(\.\d+)*|[A-Z](\.\d+)*)"
CAPTION = r"(?i)Figure\s+([\d\.-]+a?):?"
# End of the fixed values.


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def literal(word: str) -> str:
    """The word as a pattern for Java's engine."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", word)


def is_header(style: Column, text: Column) -> Column:
    """A heading style, or a text that starts with a clause number or an annex clause."""
    return style.startswith("Heading") | style.rlike(r"^H\d+$") | text.rlike(HEADER_NUMBERED) | text.rlike(HEADER_ANNEX)


def is_simple_header(style: Column) -> Column:
    return style.startswith("Heading")


def is_ontology_header(style: Column, text: Column) -> Column:
    return style.startswith("Heading") | text.rlike(HEADER_ONTOLOGY)


def header_rules(style: Column, text: Column) -> Column:
    """0, or the number of the first of five header rules that holds."""
    words = F.size(F.split(strip(text), r"\s+"))
    return (
        F.when(style.startswith("Heading"), 1)
        .when(text.rlike(HEADER_CLAUSE), 2)
        .when(text.rlike(HEADER_ANNEX), 3)
        .when((F.length(text) < 80) & (F.upper(text) == text) & text.rlike("[A-Z]") & words.between(2, 7) & ~text.rlike(r"[.:;!?]$"), 4)
        .when(text.rlike(HEADER_TITLE) & (words < 12) & ~text.endswith("."), 5)
        .otherwise(0)
    )


def clause_number(text: Column) -> Column:
    found = F.regexp_extract(text, CLAUSE, 1)
    return F.when(found == "", "unknown").otherwise(found)


def parent_clause(clause: Column) -> Column:
    """The clause above, a last part "0" not counted; null at the top."""
    parts = F.split(clause, r"\.")
    kept = F.when(F.element_at(parts, -1) == "0", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.size(kept) >= 2, F.array_join(F.slice(kept, 1, F.size(kept) - 1), "."))


def figure_base(text: Column) -> Column:
    """The number in a figure caption up to its first hyphen; empty if there's no caption."""
    return F.split(F.regexp_extract(text, CAPTION, 1), "-")[0]


def is_own_figure(text: Column, clause: Column) -> Column:
    base = figure_base(text)
    return (base != "") & (base == F.regexp_replace(clause, r"\.0[a-z]?$", ""))


def sentences(text: Column, marks: str = "[.!?]") -> Column:
    return F.split(text, marks)


def chunks(text: str, size: int, least: int = 10) -> Column:
    """Slices of ``size`` characters of a text column, without those of fewer than ``least`` characters but for white space."""
    all_ = F.expr(f"transform(sequence(0, cast(floor(greatest(length({text}) - 1, 0) / {size}) as int)), i -> substring({text}, i * {size} + 1, {size}))")
    return F.filter(all_, lambda x: F.length(strip(x)) >= least)


def is_stop_word(word: Column, stop_words: list[str], phrases: list[str]) -> Column:
    return is_stop_low(strip(F.lower(word)), stop_words, phrases)


def is_stop_low(low: Column, stop_words: list[str], phrases: list[str]) -> Column:
    """As :func:`is_stop_word`, of a word in lower case without blanks around."""
    out = low.isin(stop_words) | (F.length(low) < 2) | (F.length(low) > 50)
    for p in phrases:
        out = out | low.contains(p)
    return out


def natural_key(c: str) -> Column:
    """Sorts digit runs by value and the rest by character."""
    return F.expr(rf"transform(regexp_extract_all({c}, '(\\d+|\\D+)', 1), x -> struct(coalesce(try_cast(x as bigint), -1L) as n, x as s))")


def file_name(name: Column) -> Column:
    """Without the nine characters that file systems refuse, at most 200 long."""
    one = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), "_+", "_")
    return F.substring(F.regexp_replace(one, "^[_ ]+|[_ ]+$", ""), 1, 200)


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def keywords(*parts: Column) -> Column:
    """Distinct lower-case words of several columns, sorted."""
    # no word is null, and sort_array compares without a lambda
    return F.sort_array(F.array_remove(F.array_distinct(F.split(F.lower(F.concat_ws(" ", *parts)), r"\s+")), ""))
