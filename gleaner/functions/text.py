"""Text columns: patterns with ASCII word borders, markup removal and identity keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Entities that are decoded before tags are removed.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'"}
#: Endings that do not tell companies apart.
COMPANY_SUFFIXES = ("co", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "ltd", "plc")
#: Words of a title that mean the same.
TITLE_WORDS = {"swe": "software engineer", "engineering": "engineer", "internship": "intern", "internships": "intern"}
#: White space as browsers count it.
SPACE = r"[\s\x{00A0}\x{FEFF}\x{2028}\x{2029}]+"


def bounded(alternatives: str) -> str:
    """A pattern for whole words; letters beyond ASCII count as borders."""
    return f"(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])"


def has_word(text: Column, alternatives: str) -> Column:
    return text.rlike("(?i)" + bounded(alternatives))


def distinct_matches(text: Column, alternatives: str) -> Column:
    """How many different whole words of the pattern the text holds, whatever their case."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(bounded(alternatives)), F.lit(0))))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def html_to_text(html: Column) -> Column:
    """Entities decoded once, then tags replaced by a space, then white space collapsed."""
    out = F.coalesce(html, F.lit(""))
    # the ampersand comes last, so that what it uncovers is not decoded again
    for name in [*(k for k in ENTITIES if k != "&amp;"), "&amp;"]:
        out = F.regexp_replace(out, "(?i)" + name, ENTITIES[name])
    return collapse(F.regexp_replace(out, "<[^>]+>", " "))


def page_text(html: Column) -> Column:
    """Scripts, styles and drawings dropped with their content, tags dropped, then entities decoded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|svg)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for name in [*(k for k in ENTITIES if k != "&amp;"), "&amp;"]:
        out = F.regexp_replace(out, "(?i)" + name, ENTITIES[name])
    return collapse(out)


def markdown_to_text(text: Column) -> Column:
    """Images dropped, links replaced by their labels, marks by spaces, then as HTML."""
    out = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return html_to_text(F.regexp_replace(out, r"[*_`>#-]", " "))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, in lower case."""
    def fold(x: str | None) -> str | None:
        if x is None or x.isascii():
            return x and x.lower()
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not "\u0300" <= c <= "\u036f").lower()

    return text.map(fold)


def identity_terms(text: Column, fold=folded) -> Column:
    """The text as words of a-z and 0-9, one space apart."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def canonical_company(name: Column, fold=folded) -> Column:
    return F.regexp_replace(identity_terms(name, fold), f"(?<=.)( ({'|'.join(COMPANY_SUFFIXES)}))+$", "")


def canonical_title(title: Column, fold=folded) -> Column:
    """Distinct words, synonyms replaced, in order."""
    terms = F.split(identity_terms(title, fold), " ")
    swapped = F.transform(terms, lambda w: F.coalesce(*(F.when(w == k, F.lit(v)) for k, v in TITLE_WORDS.items()), w))
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.array_join(swapped, " "), " "))), " ")


def canonical_location(location: Column, fold=folded) -> Column:
    terms = identity_terms(location, fold)
    return F.when(terms.isin("nyc", "new york city", "new york ny"), "new york ny").when(terms.isin("remote", "remote us", "remote usa", "remote united states"), "remote").otherwise(terms)


def overlap(a: Column, b: Column) -> Column:
    """Shared words by the words of the smaller set; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


#: Locations that name no place.
GENERIC_LOCATIONS = ("unknown", "unspecified", "n/a", "na", "not listed", "not specified", "tbd", "see description", "see job")


def generic_location(location: Column) -> Column:
    """Whether a location is missing or a placeholder."""
    return F.lower(F.trim(F.coalesce(location, F.lit("")))).isin("", *GENERIC_LOCATIONS)


def plain_words(text: Column) -> Column:
    """The text in lower case with letters, digits and ``+#/`` only, words one space apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9+#/ ]+", " "), " +", " "))


def heads(words: Column) -> Column:
    """All beginnings of a title of plain words: its first 1, 2, ... words, and the letters of the first one."""
    w = F.split(words, " ")
    whole = F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: F.concat(F.lit("w "), F.array_join(F.slice(w, F.lit(1), n), " ")))
    first = F.get(w, F.lit(0))
    return F.concat(whole, F.transform(F.sequence(F.lit(1), F.greatest(F.length(first), F.lit(1))), lambda n: F.concat(F.lit("c "), F.substring(first, F.lit(1), n))))


def own_head(words: Column) -> Column:
    """The beginning under which titles that begin with this one are found: all words but the last, which may be cut."""
    w = F.split(words, " ")
    return F.when(F.size(w) > 1, F.concat(F.lit("w "), F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "))).otherwise(F.concat(F.lit("c "), words))
