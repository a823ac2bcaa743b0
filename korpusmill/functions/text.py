"""Scalar text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and the plain letters they fold to, one for one, so that positions stay.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
#: Typographic quotes and dashes, and what they are compared as.
CURLY, STRAIGHT = "“”„«»‘’‚–—−", "\"\"\"\"\"'''---"


def time_to_seconds(c: Column) -> Column:
    """``m:ss`` or ``h:mm:ss`` as seconds; fields are not range-checked. Null where a field is not a number."""
    return F.aggregate(F.split(c, ":"), F.lit(0), lambda acc, x: acc * 60 + x.try_cast("int"))


def seconds_to_time(c: Column) -> Column:
    """Seconds as ``m:ss``, or ``h:mm:ss`` from an hour on."""
    h, m, s = F.floor(c / 3600), F.floor(c % 3600 / 60), c % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def deep_link(url: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.concat(url, F.lit("?t="), seconds.cast("string"))).otherwise(url)


def fold(c: Column) -> Column:
    """Letters without accents; the length does not change."""
    return F.translate(c, MARKED, PLAIN)


def match_norm(c: Column) -> Column:
    """Lower case, no accents, single spaces, trimmed."""
    return F.trim(F.regexp_replace(fold(F.lower(c)), r"\s+", " "))


def quote_norm(c: Column) -> Column:
    """Without emphasis marks, with straight quotes and dashes and single spaces, in lower case."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.regexp_replace(c, r"[*_`]", ""), CURLY, STRAIGHT)), r"\s+", " "))


def alias_variants(c: Column) -> Column:
    """The alias, without accents, without a trailing bracket, and without both; distinct."""
    bare = F.trim(F.regexp_replace(c, r"\s*\([^()]*\)\s*$", ""))
    return F.array_distinct(F.array(c, fold(c), bare, fold(bare)))


def stable_id(c: Column) -> Column:
    """The first 60 bits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("long")


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def slug(c: Column, most: int = 60) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one dash; at most ``most`` characters."""
    dashed = F.regexp_replace(fold(F.lower(c)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, most)


def trim_section(c: Column, headings: str = "Citations?|Citas|Referencias|References|Fuentes") -> Column:
    """The text before the first second-level heading that is one of ``headings`` (a pattern)."""
    return F.regexp_replace(c, rf"(?ims)^##\s+(?:{headings})[ \t]*$.*", "")


def first_section(c: Column, cap: int = 1500) -> Column:
    """Body of the first second-level heading without quoted and arrow lines, cut at ``cap`` characters."""
    body = F.get(F.split(c, r"(?m)^## "), F.lit(1))
    lines = F.filter(F.slice(F.split(body, "\n"), 2, 1_000_000), lambda x: ~F.ltrim(x).startswith(">") & ~F.ltrim(x).startswith("→"))
    return F.substring(F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", ""), 1, cap)


def snippet(c: Column, cap: int = 800) -> Column:
    """The text up to the second heading's first paragraph: all before the first ``## ``, that heading, and one paragraph.

    Longer results end at the last whole word within ``cap``, with "..." behind.
    """
    parts = F.split(c, r"(?m)^## ")
    section = F.get(parts, F.lit(1))
    head = F.substring_index(section, "\n", 1)
    rest = F.regexp_replace(F.substr(section, F.length(head) + 2, F.length(section)), r"^\s+", "")
    paragraph = F.substring_index(rest, "\n", 1)
    whole = F.trim(F.when(section.isNull(), c).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit("## "), head, F.lit("\n"), paragraph)))
    return F.when(F.length(whole) > cap, F.concat(F.regexp_replace(F.substring(whole, 1, cap), r"\s+\S*$", ""), F.lit("..."))).otherwise(whole)


def one_liner(c: Column, cap: int = 180) -> Column:
    """The first sentence, or as many characters of the text as ``cap``."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    sentence = F.regexp_extract(flat, r"^(.*?[.!?])(?: |$)", 1)
    return F.when((F.length(sentence) > 0) & (F.length(sentence) <= cap), sentence).otherwise(F.substring(flat, 1, cap))


def context(text: Column, quote: Column, around: int = 1500, default: int = 3000) -> Column:
    """``around`` characters on both sides of the quote's first place; the first ``default`` if it has none."""
    at = F.instr(text, quote)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at + F.length(quote) + around - start)).otherwise(F.substring(text, 1, default))


def query_variants(c: Column, most: int = 3) -> Column:
    """Search phrases for an id: words of it, without a year and what follows, and a two-part name turned round."""
    base = F.regexp_replace(c, r"-(?:1[0-9]{3}|20[0-9]{2})(?:-.*)?$", "")
    spaced = lambda x: F.regexp_replace(x, "[-_]+", " ")
    words = F.split(spaced(base), " ")
    turned = F.when(F.size(words) == 2, F.concat(F.get(words, F.lit(1)), F.lit(" "), F.get(words, F.lit(0))))
    return F.slice(F.filter(F.array_distinct(F.array(spaced(c), spaced(base), turned)), lambda x: x.isNotNull() & (x != "")), 1, most)


def balanced_json(c: Column) -> Column:
    """What lies from the first "{" to the last "}", for text around a JSON object; null if there is none."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def coerce_enum(c: Column, allowed: list[str], default: str | None = None) -> Column:
    """The value in lower case if allowed; "", "null" and "none" are null; anything else is ``default``."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(*allowed), low).when(low.isNull() | low.isin("", "null", "none"), None).otherwise(default)


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def section_bullets(c: Column, heading: str) -> Column:
    """How many top-level bullets the section of that heading has."""
    section = F.regexp_extract(c, rf"(?ims)^##\s+(?:{heading})[ \t]*\n(.*?)(?:^## |\z)", 1)
    return F.size(F.regexp_extract_all(section, F.lit(r"(?m)^- "), F.lit(0)))
