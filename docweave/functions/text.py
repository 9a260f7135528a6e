"""Text functions as Column expressions: all of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no entities, labels that are, trimmed punctuation.
STOP_ENTITIES = ("et al", "et al.", "al.", "fig", "figure", "table", "section", "sec.", "appendix", "eq.", "equation")
ENTITY_LABELS = ("ORG", "PERSON", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE", "DATE", "NORP", "FAC")
ENTITY_TRIM = " ,.;:()[]{}"
TOKEN_TRIM = ".,;:!?()[]{}\"'"
#: Title-case words that name nothing.
NON_ENTITY_WORDS = (
    "a", "additionally", "although", "an", "and", "because", "but", "consequently", "dec", "december", "feb", "february", "finally", "first", "for", "from",
    "furthermore", "he", "however", "i", "in", "it", "jan", "january", "jul", "july", "jun", "june", "mar", "march", "may", "meanwhile", "moreover", "nov", "november",
    "oct", "october", "of", "on", "or", "overall", "second", "sep", "sept", "september", "she", "that", "the", "their", "therefore", "these", "they", "third", "this", "those",
    "to", "we", "while", "with", "you",
)
#: Month names, dates and numbers.
MONTHS = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATES = rf"(?i)\b(?:{MONTHS})\.?\s+\d{{1,2}}(?:,\s*|\s+)\d{{4}}\b|\b\d{{1,2}}\s+(?:{MONTHS})\.?\s+\d{{4}}\b|\b(?:{MONTHS})\.?\s+\d{{4}}\b|\b(?:\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}})\b"
NUMBERS = r"(?<![\w.\d])[+-]?\d[\d,]*(?:\.\d+)?%?(?!\w)"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def sentences(text: Column) -> Column:
    """Trimmed, non-empty parts between a full stop, ! or ? and white space."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def clean_entity(text: Column) -> Column:
    """White space collapsed, punctuation at both ends gone."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r"^[ ,.;:()\[\]{}]+|[ ,.;:()\[\]{}]+$", "")


def canonical_surface(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), r"[,.;:()\[\]{}_-]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def canonical_id(surface: Column, label: Column | None = None) -> Column:
    base = F.concat(F.lit("ent_"), F.replace(surface, F.lit(" "), F.lit("_")))
    return base if label is None else F.concat(base, F.lit("_"), F.lower(label))


def endpoint_key(text: Column) -> Column:
    """Key of a relation's end; deliberately not the canonical surface."""
    return F.concat(F.lit("ent_"), F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("_")))


def metric_tokens(text: Column) -> Column:
    """Distinct lower-case words with inner hyphens and apostrophes, ASCII only."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*)"), 1))


def allocator_tokens(text: Column) -> Column:
    """Distinct words of Unicode letters, digits, underscores and apostrophes, ß folded."""
    return F.array_distinct(F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(r"(?U)([\w']+)"), 1))


def vocabulary(text: Column) -> Column:
    """Distinct lower-case runs between white space, punctuation at both ends gone."""
    strip = r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$"""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(text), r"(?U)\s+"), lambda w: F.regexp_replace(w, strip, "")), lambda w: w != ""))


def named_like(text: Column) -> Column:
    """Distinct lower-case acronyms and title-case words, but for function words and words before a comma."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,})\b"), 1), F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+)\b(?!\s*,)"), 1))
    return F.array_distinct(F.filter(F.transform(found, lambda w: F.lower(w)), lambda w: ~w.isin(*NON_ENTITY_WORDS)))


def dates(text: Column) -> Column:
    """Distinct dates: numeric ones as integers joined by -, others in lower case with three-letter months."""
    def one(d: Column) -> Column:
        d = F.lower(F.replace(F.regexp_replace(d, r"\s+", " "), F.lit(","), F.lit("")))
        numeric = F.array_join(F.transform(F.split(d, "[-/]"), lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")), "-")
        short = F.regexp_replace(d, r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?", "$1")
        return F.when(d.rlike(r"^\d+[-/]\d+[-/]\d+$"), numeric).otherwise(short)

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({DATES})"), 1), one))


def numbers_and_dates(text: Column) -> Column:
    """Distinct dates and the numbers outside them, commas gone."""
    rest = F.regexp_replace(text, DATES, "\u0001")
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(f"({NUMBERS})"), 1), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.array_distinct(F.concat(dates(text), numbers))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(3)).cast("bigint")


def truncate(text: Column, n: int, more: str = "") -> Column:
    """At most n characters; what is cut off is marked by ``more``."""
    cut = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(F.rtrim(cut), F.lit(more)) if more else cut).otherwise(text)


def clamp_confidence(value: Column, default: Column) -> Column:
    """Within [0, 1]; null, NaN and infinities become the default."""
    bad = value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(bad, default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def key_component(text: Column) -> Column:
    """Percent-encoded but for letters, digits and -_.~"""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password)(\s*[:=]\s*)\S+", "$1$2[redacted]")


def collection_name(text: Column) -> Column:
    """Letters, digits and - kept, the rest _, lower case, no _ at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}-]", "_")), "^_+|_+$", "")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def section_key(section_id: Column, section: Column) -> Column:
    return F.coalesce(blank_to_null(section_id), blank_to_null(section), F.lit(""))


def plain_text(text: Column) -> Column:
    """Markup tags and Markdown signs gone."""
    t = F.regexp_replace(text, r"<[^<>]+>", "")
    t = F.regexp_replace(t, r"(?m)^#{1,6}\s+", "")
    return F.regexp_replace(t, r"\*\*|`", "")


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID, version 5, from SHA-1; ``namespace`` is a UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))) + 8)), -1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: The namespace of URLs, a fixed value of RFC 9562.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
#: What stands before a chunk's uid in the name its point id is made of.
POINT_PREFIX = "docweave:"
