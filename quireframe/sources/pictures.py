"""Pictures of packages: media by path, pictures of cells, and what targets of relationships stand for."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.operators.lineage import cut
from quireframe.sources import office

# The first bytes of kinds of pictures (hexadecimal), and the pattern of a cell's picture formula.
SIGNATURES = {"89504e47": "image/png", "ffd8ff": "image/jpeg", "47494638": "image/gif", "424d": "image/bmp", "49492a00": "image/tiff", "4d4d002a": "image/tiff", "d7cdc69a": "image/wmf", "01000000": "image/emf"}
DISPIMG = r"(?i)\bDISPIMG\b[^\"']*[\"']([^\"']+)[\"']"


def media(files: DataFrame, prefix: str = "xl/media/") -> DataFrame:
    """(file_id, path, name, data): the media parts of each package; a picture is a row, so a file's may be many rows."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for part in z.namelist():
            if part.startswith(prefix) and not part.endswith("/"):
                with office._stream(z, part) as source:
                    yield part, part.rpartition("/")[2], source.read()

    return office._rows(files, read, "path string, name string, data binary")


def media_names(files: DataFrame, prefix: str = "xl/media/") -> DataFrame:
    """(file_id, path, name): the media parts without their data, which are read to their end but not kept."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for part in z.namelist():
            if part.startswith(prefix) and not part.endswith("/"):
                with office._stream(z, part) as source:
                    while source.read(1 << 20):
                        pass
                yield part, part.rpartition("/")[2]

    return office._rows(files, read, "path string, name string")


def media_type(data: Column) -> Column:
    """The kind of a picture by its first bytes; null for others."""
    head = F.lower(F.hex(F.substring(data, 1, 4)))
    kind = F.lit(None).cast("string")
    for signature, name in SIGNATURES.items():
        kind = F.when(head.startswith(signature), name).otherwise(kind)
    return kind


def archive_totals(files: DataFrame) -> DataFrame:
    """(file_id, parts, packed, unpacked, bytes): how many parts a package has, their sizes, and the file's own."""
    sums = office.entries(files).groupBy("file_id").agg(F.count("*").alias("parts"), F.sum("packed").alias("packed"), F.sum("size").alias("unpacked"))
    return files.select("file_id", F.octet_length("content").cast("long").alias("bytes")).join(sums, "file_id").select("file_id", "parts", "packed", "unpacked", "bytes")


def resolved(targets: DataFrame, found: DataFrame, root: str) -> DataFrame:
    """targets (file_id, target and more) with path: the medium (file_id, path, name) that a target stands for.

    The first that is there of: the path as it is, below the package's root folder, any medium of that file name (of
    several the least path). Null where there is none. Spark takes what is read from packages for as small as the table
    that the packages come from, so the joins say how they are done: else the rows could be broadcast.
    """
    by = lambda rank, kind, c: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), c.alias("key"))
    bare = F.regexp_replace("target", f"^{root}/", "")
    tried = F.array(by(0, "path", F.col("target")), by(1, "path", F.concat(F.lit(f"{root}/"), bare)), by(9, "name", F.element_at(F.split("target", "/"), -1)))
    asked = targets.select("file_id", "target").distinct().select("file_id", "target", F.explode(tried).alias("t")).select("file_id", "target", "t.rank", "t.kind", "t.key")
    there = found.select("file_id", "path", F.explode(F.array(by(0, "path", F.col("path")), by(0, "name", F.col("name")))).alias("t")).select("file_id", "path", "t.kind", "t.key")
    best = asked.join(there.hint("merge"), ["file_id", "kind", "key"]).groupBy("file_id", "target").agg(F.min(F.struct("rank", "path"))["path"].alias("path"))
    return targets.join(best.hint("merge"), ["file_id", "target"], "left")


def cell_image_parts(files: DataFrame) -> DataFrame:
    """(file_id, image_id, description, rel_id, part): the pictures that a workbook keeps for its cells."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        part = next((p for p in z.namelist() if p.lower() == "xl/cellimages.xml"), None)
        for x in office._below(office._tree(z, part), "cellImage") if part else ():
            label, blip = office._first(x, "cNvPr"), office._first(x, "blip")
            name = None if label is None else (label.get("name") or "").strip()
            if name and blip is not None:
                yield name, label.get("descr"), office._attribute(blip, "embed"), part

    return office._rows(files, read, "image_id string, description string, rel_id string, part string")


def cell_images(files: DataFrame) -> DataFrame:
    """(file_id, sheet_id, row_index, column_index, image_id, name, path): the cells that show a picture of their own.

    A cell's formula, or else its value, names the picture; path is null where the workbook does not have it.
    """
    named = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), DISPIMG, 1)
    cells = office.cells(files).withColumn("image_id", F.trim(F.when(named(F.col("formula")) != "", named(F.col("formula"))).otherwise(named(F.col("value"))))).where("image_id <> ''")
    parts = cut(cell_image_parts(files).join(office.relationships(files).select("file_id", "part", "rel_id", "target").hint("merge"), ["file_id", "part", "rel_id"]))
    known = resolved(parts, media_names(files), "xl").groupBy("file_id", "image_id").agg(F.max(F.struct("rel_id", "description", "path")).alias("i"))
    found = cells.join(known.hint("merge"), ["file_id", "image_id"], "left")
    return found.select("file_id", "sheet_id", "row_index", "column_index", "image_id", F.coalesce("i.description", "image_id").alias("name"), "i.path")
