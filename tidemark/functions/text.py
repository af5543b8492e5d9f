"""Column functions on text: phrases, subtitle times and colours, escapes, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def normalize_phrase(text: Column) -> Column:
    """Lower case, punctuation to spaces, white space collapsed and trimmed."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]+", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; milliseconds are rounded before they are split, so they carry."""
    ms = F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.expr("0L") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def parse_srt_time(text: Column) -> Column:
    part = lambda k: F.regexp_extract(text, r"(\d+):(\d+):(\d+)[,.](\d+)", k).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc."""
    cs = F.greatest(F.lit(0), F.rint(seconds * 100)).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def ass_color(red: Column, green: Column, blue: Column, opacity: Column) -> Column:
    """&HAABBGGRR with inverted alpha."""
    return F.format_string("&H%02X%02X%02X%02X", (255 - opacity).cast("int"), blue.cast("int"), green.cast("int"), red.cast("int"))


def ass_color_tag(red: Column, green: Column, blue: Column) -> Column:
    return F.format_string("&H%02X%02X%02X&", blue.cast("int"), green.cast("int"), red.cast("int"))


def ass_escape(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "\\{}", "/()"), r"\r?\n", " ")


def filter_escape(text: Column) -> Column:
    """A value quoted for a filter graph."""
    return F.concat(F.lit("'"), F.regexp_replace(text, r"([\\':])", r"\\$1"), F.lit("'"))


def translatable(text: Column) -> Column:
    """At least two letters or digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) >= 2


def unique_id(base: Column, order: Column) -> Column:
    """base for the first row with it, base-2, base-3 ... for the next."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return F.when(n == 1, base).otherwise(F.concat(base, F.lit("-"), n.cast("string")))


def truncated(text: Column, most: int) -> Column:
    """At most `most` characters, the last three an ellipsis if cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def first_present(tags: Column, keys: list[str]) -> Column:
    """The first tag of a map that is there and not blank."""
    return F.coalesce(*[F.when(F.trim(F.try_element_at(tags, F.lit(k))) != "", F.trim(F.try_element_at(tags, F.lit(k)))) for k in keys])


def creation_time(text: Column) -> Column:
    """An ISO time with a zone in UTC with Z; one without as it is; what can't be read as it is."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    at = F.try_to_timestamp(text)
    return F.when(zoned & at.isNotNull(), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(text)


def geo(text: Column) -> Column:
    """latitude, longitude, altitude of +lat+lon[+alt]/ or lat,lon[,alt]; null if neither, or out of range."""
    number = r"([+-]\d+(?:\.\d+)?)"
    iso = rf"^{number}{number}{number}?/?$"
    pair = r"^\s*([+-]?\d+(?:\.\d+)?)\s*,\s*([+-]?\d+(?:\.\d+)?)\s*(?:,\s*([+-]?\d+(?:\.\d+)?)\s*)?$"
    take = lambda k: F.expr("cast(null as double)") if k is None else F.when(text.rlike(iso), F.regexp_extract(text, iso, k)).when(text.rlike(pair), F.regexp_extract(text, pair, k))
    number_of = lambda k: F.nullif(take(k), F.lit("")).cast("double")
    lat, lon, alt = number_of(1), number_of(2), number_of(3)
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("latitude"), lon.alias("longitude"), alt.alias("altitude")))
