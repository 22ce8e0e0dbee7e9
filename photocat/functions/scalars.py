"""Row functions of catalogue building and search, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and classes that decide results.
PRO_BODY = (
    r"(?i)EOS (5D|6D|7D|R\d?\b|[1-9]0D|M\d+)"
    r"|NIKON (D[5-9]\d\d|Z ?\d)"
    r"|\bX-(H\d|T\d+|Pro\d|S\d+)"
    r"|ILCE-|DSLR-A|\bSLT-"
    r"|DMC-G[X1-9H]|DC-G[H9X]")
RECENT_PHONE = r"iPhone (1[3-9]|[2-9]\d)"
SOURCE_CLASSES = ("pro", "archive", "amateur", "unknown")
HISTORICAL = (
    r"(?i)\b(hillary|sir ed|expedition|historic|history|archive|archival|vintage|old photo|"
    r"founding|founder|195\d|196\d|197\d|1950s|1960s|1970s|1980s|black and white|b&w)\b")
FILENAME = r"^(.+?)\s*\((\d{2})\.(\d{2})\.(\d{2})\)\s*-(\d+)"
HASHED_BYTES = 8192
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


@dataclass(frozen=True)
class SourceRules:
    """What a library's folders say about who took a picture."""

    archive_prefixes: tuple[str, ...] = ()
    photographers: tuple[str, ...] = ()


def image_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def file_hash(content: Column) -> Column:
    """Of the first 8,192 bytes."""
    return F.sha2(F.substring(content, 1, HASHED_BYTES), 256)


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_folder(path: Column, root: str) -> Column:
    """The parent relative to ``root``, "." for the root itself, else the parent's own name."""
    base = root.rstrip("/") + "/"
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    inner = F.substring(parent, len(base) + 1, 1 << 30)
    return F.when(parent == base[:-1], ".").when(path.startswith(base), inner).otherwise(F.element_at(F.split(parent, "/"), -1))


def parse_filename(name: Column) -> Column:
    """struct(event_name, day, month, year, sequence), null without a match."""
    part = lambda i: F.regexp_extract(name, FILENAME, i)
    found = F.struct(
        F.btrim(part(1)).alias("event_name"), part(2).cast("int").alias("day"), part(3).cast("int").alias("month"),
        (part(4).cast("int") + 2000).alias("year"), part(5).cast("long").alias("sequence"))
    return F.when(name.rlike(FILENAME), found)


def exif_datetime(text: Column) -> Column:
    """YYYY:MM:DD HH:MM:SS as a timestamp without zone; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(text, r"\s+", " "), F.lit("yyyy:M:d H:m:s")).cast("timestamp_ntz")


def date_taken(original: Column, generic: Column) -> Column:
    return F.coalesce(exif_datetime(original), exif_datetime(generic))


def exif_rational(nums: Column, text: Column) -> Column:
    """The first of ``nums`` (array of num, den) if its den is not 0, else the text as a number."""
    first = F.get(nums, F.lit(0))
    ratio = first["num"].cast("double") / F.nullif(first["den"], F.lit(0)).cast("double")
    return F.coalesce(ratio, text.try_cast("double"))


def _decimal(dms: Column, reference: Column, negative: str, default: str) -> Column:
    part = lambda i: F.get(dms, F.lit(i))["num"].cast("double") / F.nullif(F.get(dms, F.lit(i))["den"], F.lit(0)).cast("double")
    value = part(0) + part(1) / 60 + part(2) / 3600
    return F.when(F.coalesce(reference, F.lit(default)) == negative, -value).otherwise(value)


def gps_decimal(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column) -> Column:
    """struct(latitude, longitude), both null if either cannot be had."""
    a, b = _decimal(lat, lat_ref, "S", "N"), _decimal(lon, lon_ref, "W", "E")
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(both, a).alias("latitude"), F.when(both, b).alias("longitude"))


def iso_speed(text: Column) -> Column:
    return F.btrim(text).try_cast("int")


def camera_texts(tags: Column) -> Column:
    """struct of the camera's texts in a map of tags, each as it stands, and of
    the speed as a number; a tag that is absent is null."""
    tag = lambda name: F.try_element_at(tags, F.lit(name))
    return F.struct(
        tag("Image Make").alias("camera_make"), tag("Image Model").alias("camera_model"), tag("EXIF LensModel").alias("lens_model"),
        tag("EXIF ExposureTime").alias("shutter_speed"), iso_speed(tag("EXIF ISOSpeedRatings")).alias("iso"))


def long_edge(width: Column, height: Column) -> Column:
    edge = F.greatest(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0)))
    return F.nullif(edge, F.lit(0))


def classify_source(folder: Column, camera: Column, rules: SourceRules) -> Column:
    """pro, archive, amateur or unknown; the first rule that fits decides."""
    folder = F.coalesce(folder, F.lit(""))
    camera = F.regexp_replace(F.coalesce(camera, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    none = F.lit(False)
    archive, named = none, none
    for prefix in rules.archive_prefixes:
        archive = archive | folder.startswith(prefix)
    for name in rules.photographers:
        named = named | F.upper(folder).contains(name)
    good = (camera != "") & (camera.rlike(PRO_BODY) | camera.rlike(RECENT_PHONE))
    return F.when(archive, "archive").when(named | good, "pro").when(camera != "", "amateur").otherwise("unknown")


def archive_mode(archive: Column, query: Column) -> Column:
    """include, exclude, only or capped; anything else asked for counts as auto."""
    historical = F.coalesce(query, F.lit("")).rlike(HISTORICAL)
    return F.when(archive.isin("include", "exclude", "only"), archive).when(historical, "include").otherwise("capped")


def human_size(n: Column, largest: str = "PB") -> Column:
    """Steps of 1,024 with one decimal (ties to even), B to ``largest``; a null stays null."""
    shown = lambda power, sign: F.format_string(f"%.1f {sign}", F.bround(n / F.lit(1024.0**power), 1))
    below = SIZE_UNITS.index(largest)
    out = shown(below, largest)
    for power, sign in reversed(list(enumerate(SIZE_UNITS[:below]))):
        out = F.when(n / F.lit(1024.0**power) < 1024.0, shown(power, sign)).otherwise(out)
    return F.when(n.isNotNull(), out)


def human_duration(seconds: Column) -> Column:
    """Seconds, minutes or hours; a null stays null."""
    whole = F.floor(seconds).cast("long")
    minutes, rest = F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60))
    hours = F.floor(whole / 3600).cast("long")
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).when(seconds < 3600, F.format_string("%dm %ds", minutes, rest)).when(
        seconds.isNotNull(), F.format_string("%dh %dm", hours, F.pmod(minutes, F.lit(60))))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; within a lambda function an
    expression is computed again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """v by its length; null for a zero vector."""
    return let(F.sqrt(dot(v, v)), lambda length: F.when(length > 0, F.transform(v, lambda x: (x / length).cast("float"))))


def cosine_from_l2(squared: Column) -> Column:
    """For vectors of length 1."""
    return 1 - squared / 2


def needs_upright(orientation: Column) -> Column:
    return ~F.coalesce(orientation, F.lit(1)).isin(0, 1)
