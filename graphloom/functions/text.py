"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def rel_type(label: Column) -> Column:
    """A relation's name in upper case with underscores; RELATED_TO if nothing is left, REL_ before a digit."""
    x = F.regexp_replace(F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when((x == "") | x.isNull(), "RELATED_TO").when(x.rlike("^[0-9]"), F.concat(F.lit("REL_"), x)).otherwise(x)


#: Letters with marks and what they fold to.
FOLD = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def fold(x: Column) -> Column:
    """Lower case without marks, for Latin letters."""
    return F.translate(F.lower(x), *FOLD)


def wiki_slug(name: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(fold(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(x == "", "entity").otherwise(x)


def clean_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def tokens(x: Column) -> Column:
    """Runs of letters and digits in lower case, as a simple full-text configuration splits."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Words that carry no name, and legal forms of companies.
STOPWORDS = ("the", "a", "an", "of", "and", "for", "in", "on", "at", "to", "by", "with", "der", "die", "das", "und", "von")
LEGAL_FORMS = ("gmbh", "ag", "kg", "inc", "ltd", "llc", "corp", "co", "sa", "plc", "se")


def significant_words(name: Column) -> Column:
    """Words split at blanks, hyphens and slashes, without stopwords and legal forms, in order."""
    words = F.filter(F.split(fold(name), r"[\s/\-]+"), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS, *LEGAL_FORMS))


def trigrams(x: Column, pad: int = 1) -> Column:
    """Distinct three-letter windows of the lower-cased text between `pad` blanks."""
    p = F.concat(F.lit(" " * pad), F.lower(x), F.lit(" " * pad))
    n = F.length(p) - 2
    return F.array_distinct(F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(p, i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def set_jaccard(a: Column, b: Column) -> Column:
    """jaccard() of arrays without repeated elements: what both hold is looked for once."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def model_tokens(name: Column, least: int = 6) -> Column:
    """Alphanumeric tokens with a digit, of at least `least` characters, in lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(name), F.lit(r"[a-z0-9]+(?:[#\-][a-z0-9]+)*"), F.lit(0)), lambda t: (F.length(t) >= least) & t.rlike("[0-9]")))


EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
PHONE = r"\+[0-9]{1,3}[ \-]?[0-9]{2,5}[ \-]?[0-9]{3,}(?:[ \-]?[0-9]+)*"
ISO_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
PERCENT = r"[0-9]+(?:[.,][0-9]+)? ?%"
#: Names of months in English and German, units of large numbers, standards.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MONATE = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
UNITS = "million|billion|Mio\\.?|Mrd\\.?|bn|Tsd\\.?"
GERMAN_DATE = rf"[0-9]{{1,2}}\.(?: ?(?:{MONATE}) |[0-9]{{1,2}}\.)[0-9]{{4}}"
ENGLISH_DATE = rf"(?:(?:{MONTHS}) [0-9]{{1,2}},? [0-9]{{4}}|[0-9]{{1,2}} (?:{MONTHS}) [0-9]{{4}})"
QUARTER = r"\bQ[1-4][ /\-]?[0-9]{4}\b"
AMOUNT = rf"[0-9]+(?:[.,][0-9]+)* ?(?:(?:{UNITS}) ?)?(?:€|EUR|USD|Euro|Dollar)"
STANDARD = r"\b(?:ISO(?:/IEC)? ?[0-9]{4,5}|SOC ?[12]|PCI DSS|GDPR|DSGVO|HIPAA|NIS2)\b"
MONEY = r"(?:€|\$|EUR|USD) ?[0-9]+(?:[.,][0-9]+)*"


def redacted(x: Column) -> Column:
    for kind, pattern in (("EMAIL", EMAIL), ("IBAN", IBAN), ("PHONE", PHONE)):
        x = F.regexp_replace(x, pattern, f"[REDACTED:{kind}]")
    return x


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))


def markdown_text(md: Column) -> Column:
    """Markdown without front matter, links' targets, emphasis, headings and code marks."""
    x = F.regexp_replace(md, r"(?s)^---\n.*?\n---\n", "")
    x = F.regexp_replace(x, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2")
    x = F.regexp_replace(x, r"\[\[([^\]]+)\]\]", "$1")
    x = F.regexp_replace(x, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?m)^#+ *", ""), r"[*`_]", ""))


def wikilinks(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]|]+)"), F.lit(1)), lambda t: F.trim(t))


def fact_lines(x: Column, least: int = 20, most: int = 400, n: int = 12) -> Column:
    """The first n bulleted or numbered lines without their marks, of `least` to `most` characters."""
    marked = F.transform(F.split(x, "\n"), lambda line: F.trim(F.regexp_extract(F.trim(line), r"^(?:[-*•]|[0-9]+[.)]) +(.*)$", 1)))
    return F.slice(F.filter(marked, lambda line: F.length(line).between(least, most)), 1, n)


def snippet(x: Column, size: int = 400) -> Column:
    """The first `size` characters, cut at a word, with an ellipsis if something was cut."""
    return F.when(F.length(x) <= size, x).otherwise(F.regexp_replace(F.substring(x, 1, size), " [^ ]*$", "…"))
