"""Text functions as column expressions; they stay in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters whose full case folding is more than lower case. Fixed values.
FOLDS = {"ß": "ss", "ẞ": "ss", "ŉ": "ʼn", "ſ": "s", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ", "ẙ": "ẙ", "ẚ": "aʾ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: White space as Unicode has it, for Java and for RE2. Fixed values.
SPACE_JAVA = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
SPACE_RE2 = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Institutions that say none. Fixed values.
NO_INSTITUTION = ("", "institution not provided", "unknown institution", "not listed")
#: Words that do not tell titles apart. Fixed values.
STOPWORDS = ("academic", "assistant", "associate", "full", "in", "of", "or", "position", "professor", "specialization", "tenure", "track", "with")


def normalize(c: Column) -> Column:
    """Case-folded, without http(s)://(www.), every run of other than a-z and 0-9 one space, trimmed; null is empty."""
    low = out = F.lower(F.coalesce(c, F.lit("")))
    for a, b in FOLDS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    # Texts of ASCII alone, told by two counters, and texts without addresses are spared their replacements.
    out = F.when(F.octet_length(low) != F.char_length(low), out).otherwise(low)
    out = F.when(F.contains(out, F.lit("://")), F.regexp_replace(out, r"https?://(www\.)?", "")).otherwise(out)
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def canonical_id(title: Column, institution: Column, url: Column) -> Column:
    """24 hex digits of the SHA-256 of the normalized URL, or of title and institution where there is none to use."""
    u = normalize(url)
    source = F.when((u != "") & ~u.contains("configure me"), F.concat(F.lit("url:"), u)).otherwise(F.concat(F.lit("title-inst:"), normalize(title), F.lit("::"), normalize(institution)))
    return F.substring(F.sha2(source, 256), 1, 24)


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE_JAVA, " "))


def strip_html(c: Column) -> Column:
    return clean_text(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def missing_institution(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*NO_INSTITUTION)


def institution_key(c: Column) -> Column:
    return F.when(missing_institution(c), "").otherwise(F.regexp_replace(normalize(c), r"^the\s+", ""))


def plain(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 one space; URLs stay."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(plain(c), " "), lambda x: x != "")


def soft_contains(a: Column, b: Column) -> Column:
    a, b = plain(a), plain(b)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def title_matches(title: Column, target: Column) -> Column:
    terms = F.array_except(tokens(target), F.array(*map(F.lit, STOPWORDS)))
    return F.when(F.size(terms) == 0, soft_contains(title, target)).otherwise(F.size(F.array_except(terms, tokens(title))) == 0)


def searchable(*cols: Column) -> Column:
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in cols))
