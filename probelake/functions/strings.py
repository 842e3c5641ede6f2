"""String expressions of statement generation and prompt handling; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in a country's name that ask for the article.
COUNTRY_WORDS = ("Republic", "United", "Kingdom", "of", "Territory", "South", "North", "Island", "Islands", "Coast", "Central", "Netherlands")
#: Definitions that start with one of these take no article.
NO_ARTICLE = ("any", "one", "once", "something", "someone", "somebody", "anything", "anyone", "anybody")


def capitalised(s: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**31 - 1)))


def abbreviated(s: Column) -> Column:
    """The first letters of the words, upper case."""
    return F.upper(F.array_join(F.transform(F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))


def is_abbreviation(s: Column) -> Column:
    """Upper case with a letter and at most five characters, dots aside."""
    bare = F.replace(s, F.lit("."), F.lit(""))
    return (bare == F.upper(bare)) & bare.rlike("[A-Z]") & (F.char_length(bare) <= 5)


def without_brackets(s: Column) -> Column:
    """s without (...) and [...]."""
    return F.regexp_replace(s, r"\(.*?\)|\[.*?\]", "")


def first_part(s: Column, mark: str) -> Column:
    """What comes before the first mark."""
    return F.split_part(s, F.lit(mark), F.lit(1))


def stripped(s: Column, chars: str = "#+ ") -> Column:
    """s without any of the characters at either end."""
    return F.trim(s, F.lit(chars))


def right_stripped(s: Column, chars: str) -> Column:
    """s without any of the characters at its end; a set of characters, not a suffix."""
    return F.rtrim(s, F.lit(chars))


def without_end_token(s: Column, token: str) -> Column:
    """s with the token at its end, and the space after it, as one space."""
    from re import escape

    return F.regexp_replace(s, escape(token) + r"\s*$", " ")


def indefinite(s: Column) -> Column:
    """s after "a" or "an", by its first letter."""
    return F.concat(F.when(F.lower(F.substring(s, 1, 1)).isin("a", "e", "i", "o", "u"), "an ").otherwise("a "), s)


def looks_plural(s: Column) -> Column:
    """Whether the first word ends like a plural: in s, but not ss, us or is."""
    word = F.lower(first_part(s, " "))
    return word.rlike("s$") & ~word.rlike("(ss|us|is)$")


def country_with_article(country: Column, admin: Column | None = None) -> Column:
    """The country after "the" where its name has one of COUNTRY_WORDS or looks plural; a state follows "United States" if it is letters only."""
    name = country
    if admin is not None:
        name = F.when((country == "United States") & admin.rlike("^[A-Za-z]+$"), F.concat(country, F.lit(", "), admin)).otherwise(country)
    keyed = F.lower(name).rlike("|".join(w.lower() for w in COUNTRY_WORDS))
    return F.when(keyed | looks_plural(name), F.concat(F.lit("the "), name)).otherwise(name)


def definition(text: Column, part_of_speech: Column) -> Column:
    """A dictionary definition as it stands in a statement: without brackets, its first clause, with an article (noun) or "to" (verb), without a last dot."""
    clause = first_part(F.trim(F.regexp_replace(text, r"\s*\(.*?\)\s*", " ")), ";")
    low = F.lower(clause)
    bare = low.rlike("^(" + "|".join(NO_ARTICLE) + ")") | low.rlike("^(a|an|the) ")
    out = F.when(part_of_speech == "noun", F.when(bare, clause).otherwise(indefinite(clause))).when(part_of_speech == "verb", F.when(clause.startswith("to "), clause).otherwise(F.concat(F.lit("to "), clause))).otherwise(clause)
    return F.trim(F.regexp_replace(out, r"\.$", ""))


def coloured(token: Column, weight: Column) -> Column:
    """token in an HTML span whose background runs from blue (0) over white (0.5) to red (1)."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))
    side = F.round(255 * (1 - F.abs(2 * w - 1))).cast("int")
    two = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    red, blue = F.when(w >= 0.5, F.lit(255)).otherwise(side), F.when(w <= 0.5, F.lit(255)).otherwise(side)
    return F.concat(F.lit('<span style="background-color:#'), two(red), two(side), two(blue), F.lit('">'), token, F.lit("</span>"))
