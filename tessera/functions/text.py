"""Text, licence and JSON helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as the corpus tools count it: Java's set and the four information separators.
SPACE = r"[\s\x1c-\x1f]"

#: Licences that may be used, after normalisation.
ALLOWED_LICENSES = (
    "CC0", "CC00", "CCBY", "CCBY4", "CCBY40", "CCBYSA", "CCBYSA4", "CCBYSA40", "PUBLICDOMAIN", "PD",
)


#: The same characters, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at either end; reads the ends only."""
    return F.btrim(text, F.lit(SPACES))


def normalize_ws(text: Column) -> Column:
    """Every run of white space becomes one blank; none at either end."""
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def fold(text: Column) -> Column:
    """Caseless form: lower case, with the sharp s written out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_license(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def license_allowed(normalized: Column) -> Column:
    return normalized.isin(*ALLOWED_LICENSES)


def source_allowed(source: Column) -> Column:
    """Empty (a null is a missing value) or from the s2orc family."""
    return F.coalesce(source, F.lit("")).eqNullSafe("") | F.contains(F.lower(source), F.lit("s2orc"))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def json_field(document: Column, key: str) -> Column:
    """A top-level field of a JSON object; null where the text is no object."""
    return F.when(F.ltrim(document).startswith("{"), F.get_json_object(document, f"$.{key}"))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def json_text(text: Column) -> Column:
    """A text as a JSON string, ``null`` for null; code points stay, control characters are escaped in lower-case hex."""
    inside = lambda t: once(F.to_json(F.struct(t.alias("v"))), lambda j: F.substr(j, F.lit(7), F.length(j) - 8))
    # Spark writes these in upper-case hex, so texts that have any are cut at them
    odd = r"[\x0B\x0E\x0F\x1A-\x1F]"
    mark = lambda c: F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))

    def joined(s: Column) -> Column:
        part = lambda p, i: F.concat(F.when(i > 0, mark(s["marks"][i - 1])).otherwise(""), inside(p))
        return F.array_join(F.transform(s["parts"], part), "")

    cut = F.struct(F.split(text, odd, -1).alias("parts"), F.regexp_extract_all(text, F.lit(odd), F.lit(0)).alias("marks"))
    body = F.when(F.rlike(text, F.lit(odd)), once(cut, joined)).otherwise(inside(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_list(items: Column) -> Column:
    """A list of texts as a JSON array with a blank after commas."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(items, json_text), ", "), F.lit("]")), F.lit("null"))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often its result is used."""
    return F.transform(F.array(value), use)[0]


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")


def has_duplicates(items: Column) -> Column:
    return F.size(F.array_distinct(F.transform(items, lambda i: fold(normalize_ws(i))))) != F.size(items)


def excerpt(text: Column, *, min_chars: int = 1200, max_chars: int = 6000, min_paragraph: int = 80) -> Column:
    """Leading paragraphs of a text that fit, or null where they are too short.

    Paragraphs are parted by blank lines, white space is normalised, paragraphs under
    ``min_paragraph`` characters fall away.  The first always stays; later ones while the sum of
    lengths, two more for each, is at most ``max_chars``.  Row-wise: no explode and no shuffle.
    """
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?U)\n{SPACE}*\n")
    kept = F.filter(F.transform(parts, normalize_ws), lambda p: F.length(p) >= min_paragraph)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def take(state: Column, p: Column) -> Column:
        fits = ~state["full"] & ((state["n"] == 0) | (state["n"] + F.length(p) + 2 <= max_chars))
        return F.when(
            fits,
            F.struct(
                F.when(state["n"] == 0, p).otherwise(F.concat(state["out"], F.lit("\n\n"), p)).alias("out"),
                (state["n"] + F.length(p) + 2).alias("n"), F.lit(False).alias("full"),
            ),
        ).otherwise(F.struct(state["out"].alias("out"), state["n"].alias("n"), F.lit(True).alias("full")))

    whole = F.aggregate(kept, start, take, lambda s: s["out"])
    return F.when(F.length(whole) >= F.greatest(F.lit(min_chars), F.lit(1)), whole)
