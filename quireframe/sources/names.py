"""File names in urls and headers, and kinds of office documents by extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds by file extension and by media type.
KINDS = {".docx": "docx", ".xlsx": "xlsx", ".pptx": "pptx", ".doc": "doc", ".wps": "doc", ".xls": "xls", ".ppt": "ppt"}
MEDIA_TYPES = {
    "application/msword": ".doc",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.ms-powerpoint": ".ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
}


def file_name(url: Column) -> Column:
    """The last segment of a url's path, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)


def header_name(disposition: Column) -> Column:
    """The name in a Content-Disposition header: filename*=UTF-8''... before filename=...; null for none."""
    star = F.regexp_extract(disposition, r"(?i)filename\*\s*=\s*UTF-8''([^;]+)", 1)
    plain = F.regexp_extract(disposition, r'(?i)filename\s*=\s*"?([^";]+)"?', 1)
    return F.when(star != "", F.try_url_decode(star)).when(plain != "", F.trim(plain))


def kind_of(name: Column) -> Column:
    """The kind by the name's extension, in any case; null for an unknown one."""
    out = F.lit(None).cast("string")
    for extension, kind in reversed(KINDS.items()):
        out = F.when(F.lower(name).endswith(extension), kind).otherwise(out)
    return out


def extension_of(media_type: Column) -> Column:
    known = F.map_from_arrays(F.array(*map(F.lit, MEDIA_TYPES)), F.array(*map(F.lit, MEDIA_TYPES.values())))
    return F.try_element_at(known, F.lower(F.trim(F.split(media_type, ";")[0])))
