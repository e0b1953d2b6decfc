"""Text columns: URLs, normalisation, word n-grams, durations, dates in many formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Super- and subscript characters and their plain forms, public suffixes, bad-text marks, date formats.
RAISED, RAISED_PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖᵠʳˢᵗᵘᵛʷˣʸᶻ", "0123456789abcdefghijklmnopqrstuvwxyz"
LOWERED, LOWERED_PLAIN = "₀₁₂₃₄₅₆₇₈₉ₐₑᵢₒᵣᵤᵥₓ", "0123456789aeioruvx"
SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br", "com", "org", "net", "edu", "gov", "info", "io", "fr", "de", "es", "it", "uk", "eu")
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy", "d MMM yyyy HH:mm:ss")
WORD = r"[\p{L}\p{N}_]"
OUTSIDE = r"[^\p{L}\p{N}_\p{Z}\t-\r.,'\"()\[\]]"


def source_from_url(url: Column) -> Column:
    """The third part between slashes; null without a scheme."""
    return F.get(F.split(url, "/"), F.lit(2))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def website_name(url: Column) -> Column:
    """First label of the host without www., else Unknown."""
    first = F.split_part(F.replace(host(url), F.lit("www."), F.lit("")), F.lit("."), F.lit(1))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("Unknown"))


def registered_domain(url: Column) -> Column:
    """The label before the public suffix; empty if there is none."""
    ending = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    return F.coalesce(F.regexp_extract(F.lower(host(url)), rf"([^.]+)\.(?:{ending})$", 1), F.lit(""))


def clean_redirect_url(url: Column) -> Column:
    """What follows ``url=`` up to the next ampersand, unquoted."""
    return F.try_url_decode(F.split_part(F.split_part(url, F.lit("url="), F.lit(-1)), F.lit("&"), F.lit(1)))


def normalise_french(text: Column) -> Column:
    """One apostrophe, hyphens and special characters to blanks, raised and lowered characters plain, camel case split."""
    t = F.replace(text, F.lit("’"), F.lit("'"))
    t = F.regexp_replace(t, rf"(?<={WORD})[-/;:]", " ")
    t = F.regexp_replace(t, OUTSIDE, " ")
    t = F.translate(F.translate(t, RAISED, RAISED_PLAIN), LOWERED, LOWERED_PLAIN)
    t = F.regexp_replace(t, r"(?<=[a-z])(?=[A-Z])", " ")
    return F.regexp_replace(t, r"[ \t]+", " ")


def aggressive_normalise(text: Column) -> Column:
    """Lower case without hyphens, elided articles (l', d'), punctuation or repeated blanks."""
    t = F.lower(F.replace(text, F.lit("’"), F.lit("'")))
    t = F.regexp_replace(t, r"[-/;:]", " ")
    t = F.regexp_replace(t, rf"(^|[^\p{{L}}\p{{N}}_])[ld]'", "$1")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\p{Z}\t-\r]", " ")
    t = F.translate(F.translate(t, RAISED, RAISED_PLAIN), LOWERED, LOWERED_PLAIN)
    return F.trim(F.regexp_replace(t, r"[\p{Z}\t-\r]+", " "))


def words(text: Column) -> Column:
    """Lower-case words of two letters or digits at least, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))


def ngrams(tokens: Column, stop_words: list[str]) -> Column:
    """Words and neighbouring word pairs, after the stop words have gone."""
    kept = F.filter(tokens, lambda w: ~w.isin(*stop_words)) if stop_words else tokens
    shifted = F.slice(kept, F.lit(2), F.greatest(F.size(kept), F.lit(1)))
    pairs = F.filter(F.zip_with(kept, shifted, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    return F.concat(kept, pairs)


def parse_date(text: Column) -> Column:
    """The first format that fits, as yyyy-MM-dd HH:mm:ss; null if none does."""
    text = F.regexp_replace(text, "^[A-Z][a-z]{2}, ", "")  # the day of the week says nothing new
    return F.date_format(F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS)), "yyyy-MM-dd HH:mm:ss")


def duration(seconds: Column) -> Column:
    """Days, hours, minutes and seconds in words, without those that are zero."""
    s = seconds.cast("long")
    parts = [(F.floor(s / 86400), "day"), (F.floor(s % 86400 / 3600), "hour"), (F.floor(s % 3600 / 60), "minute"), (s % 60, "second")]
    told = F.concat_ws(", ", *(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise(""))) for n, name in parts))
    return F.when(told == "", "0 seconds").otherwise(told)
