"""Decks as tables: sizes, slides with their layouts and masters, shapes with their groups and places, theme colours.

As in sources.office a generator reads the parts of one file at a time; what joins parts with each other is a join of
the tables, and groups are flattened by operators.trees.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireframe.operators import trees
from quireframe.sources import office

# Fixed value: English Metric Units in a px.
EMU = 9525.0
KINDS = {"sp": "shape", "pic": "image", "cxnSp": "connector", "graphicFrame": "frame", "grpSp": "group"}
SHAPE = "part string, node int, parent int, ord int, type string, name string, placeholder string, " + ", ".join(f"{c} double" for c in ("x", "y", "width", "height", "child_x", "child_y", "child_width", "child_height"))


def _child(node: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    """The first child of that name, then that one's, and so on."""
    for name in path:
        node = None if node is None else next((x for x in node if office._local(x.tag) == name), None)
    return node


def _px(node: ElementTree.Element | None, name: str) -> float | None:
    return None if node is None or node.get(name) is None else int(node.get(name)) / EMU


def sizes(files: DataFrame) -> DataFrame:
    """(file_id, width, height) of the slides of each deck, in px."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        if "ppt/presentation.xml" in z.namelist():
            size = _child(office._tree(z, "ppt/presentation.xml"), "sldSz")
            yield _px(size, "cx"), _px(size, "cy")

    return office._rows(files, read, "width double, height double")


def listed(files: DataFrame) -> DataFrame:
    """(file_id, part, kind, ord): a deck's slides and masters in its own order, from 1."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        if "ppt/presentation.xml" not in z.namelist():
            return
        targets = {r[1]: r[2] for r in office._relations(z, "ppt/presentation.xml")}
        for kind, group in (("slide", "sldIdLst"), ("master", "sldMasterIdLst")):
            for i, x in enumerate(_child(office._tree(z, "ppt/presentation.xml"), group) or (), 1):
                yield targets.get(office._relation(x)), kind, i

    return office._rows(files, read, "part string, kind string, ord int")


def _colour(node: ElementTree.Element | None) -> str | None:
    """The colour of a fill: six digits, or the name of a theme colour."""
    return None if node is None else next((x.get("lastClr") or x.get("val") for x in node if office._local(x.tag) in ("srgbClr", "schemeClr", "sysClr")), None)


def backgrounds(files: DataFrame) -> DataFrame:
    """(file_id, part, fill) of slides, layouts and masters that have a background of their own."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for part in z.namelist():
            if part.startswith(("ppt/slides/", "ppt/slideLayouts/", "ppt/slideMasters/")) and part.endswith(".xml"):
                own = _child(office._tree(z, part), "cSld", "bg")
                fill = _colour(_child(own, "bgPr", "solidFill")) or _colour(_child(own, "bgRef"))
                if fill:
                    yield part, fill

    return office._rows(files, read, "part string, fill string")


def theme_colours(files: DataFrame) -> DataFrame:
    """(file_id, part, name, value): the colour scheme of each theme of a package (decks, workbooks, text documents)."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for part in z.namelist():
            if "/theme/theme" in part and part.endswith(".xml"):
                for x in _child(office._tree(z, part), "themeElements", "clrScheme") or ():
                    if value := _colour(x):
                        yield part, office._local(x.tag), value

    return office._rows(files, read, "part string, name string, value string")


def shapes(files: DataFrame) -> DataFrame:
    """(file_id, part, node, parent, ord, type, name, placeholder, x, y, width, height, child_x and so on) of all slides,
    layouts and masters, as the parts have them: in px of the group (parent) that holds a shape, groups being nodes too.
    Sizes that a shape leaves to its layout are null. ord counts what is drawn, in order.
    """

    def below(tree: ElementTree.Element, part: str) -> Iterator[tuple]:
        todo, node, at = [(tree, None)], 0, 0
        while todo:  # not recursive: groups may lie in each other to any depth
            x, parent = todo.pop()
            name = office._local(x.tag)
            if name in KINDS and x is not tree:
                own = _child(x, "xfrm") if name == "graphicFrame" else _child(x, "grpSpPr" if name == "grpSp" else "spPr", "xfrm")
                off, ext, start, size = (_child(own, c) for c in ("off", "ext", "chOff", "chExt"))
                label, holder = office._first(x, "cNvPr"), None if name == "grpSp" else office._first(x, "ph")
                kind = KINDS[name]
                inner = size if size is not None else ext  # a group without sizes of its children has its own
                group = (_px(start, "x"), _px(start, "y"), _px(inner, "cx"), _px(inner, "cy")) if kind == "group" else (None,) * 4
                yield (part, node, parent, None if kind == "group" else at, kind, None if label is None else label.get("name"), None if holder is None else holder.get("type") or "body",
                       _px(off, "x"), _px(off, "y"), _px(ext, "cx"), _px(ext, "cy"), *group)
                at += kind != "group"
                own_node, node = node, node + 1
                if kind != "group":
                    continue
                parent = own_node
            todo += [(c, parent) for c in reversed(list(x)) if office._local(c.tag) in KINDS or office._local(c.tag) == "spTree"]

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for part in z.namelist():
            if part.startswith(("ppt/slides/", "ppt/slideLayouts/", "ppt/slideMasters/")) and part.endswith(".xml"):
                tree = _child(office._tree(z, part), "cSld", "spTree")
                if tree is not None:
                    yield from below(tree, part)

    return office._rows(files, read, SHAPE)


def flattened(shapes: DataFrame) -> DataFrame:
    """What shapes() gives without the groups, in the slide's own px."""
    keys = ["file_id", "part"]
    elements = shapes.where("type <> 'group'").drop("child_x", "child_y", "child_width", "child_height", "node")
    return trees.flattened(elements, shapes.where("type = 'group'"), keys).drop("parent")


def inherited(files: DataFrame) -> DataFrame:
    """(file_id, slide_index, part, layout, master, background) of each slide.

    The layout is what the slide's relationships name, the master what the layout's do; without a layout it is the deck's
    first master. The background is the slide's own, else its layout's, else its master's.
    """
    parts, rels, fills = listed(files), office.relationships(files), backgrounds(files)
    to = lambda kind, name, of: rels.where(F.col("type") == kind).groupBy("file_id", F.col("part").alias(of)).agg(F.min_by("target", "rel_id").alias(name))
    first = parts.where("kind = 'master'").groupBy("file_id").agg(F.min_by("part", "ord").alias("first_master"))
    slides = parts.where("kind = 'slide'").select("file_id", F.col("ord").alias("slide_index"), "part")
    known = slides.join(to("slideLayout", "layout", "part"), ["file_id", "part"], "left").join(to("slideMaster", "own_master", "layout"), ["file_id", "layout"], "left").join(first, "file_id", "left")
    known = known.withColumn("master", F.when(F.col("layout").isNull(), F.col("first_master")).otherwise(F.col("own_master")))
    for name in ("part", "layout", "master"):
        known = known.join(fills.select("file_id", F.col("part").alias(name), F.col("fill").alias(f"{name}_fill")), ["file_id", name], "left")
    return known.select("file_id", "slide_index", "part", "layout", "master", F.coalesce("part_fill", "layout_fill", "master_fill").alias("background"))


def composed(files: DataFrame) -> DataFrame:
    """(file_id, slide_index, z_index, source, type, name, x, y, width, height): what each slide shows, in order.

    The master's shapes come first, then the layout's, then the slide's own; placeholders of master and layout are only
    patterns and are left out. A slide's placeholder without a place has that of its layout's placeholder of the same
    type, else of its master's.
    """
    flat, of = flattened(shapes(files)), inherited(files)
    parts = [of.select("file_id", "slide_index", F.lit(rank).alias("rank"), F.lit(source).alias("source"), F.col(name).alias("part")) for rank, (source, name) in enumerate((("master", "master"), ("layout", "layout"), ("slide", "part")))]
    shown = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(flat, ["file_id", "part"])
    holders = shown.where("placeholder IS NOT NULL AND source <> 'slide' AND x IS NOT NULL")
    best = holders.groupBy("file_id", "slide_index", "placeholder").agg(F.max_by(F.struct("x", "y", "width", "height"), F.struct("rank", -F.col("ord"))).alias("p"))
    own = shown.where("placeholder IS NULL OR source = 'slide'").join(best, ["file_id", "slide_index", "placeholder"], "left")
    z = F.row_number().over(Window.partitionBy("file_id", "slide_index").orderBy("rank", "ord")) - 1
    return own.select("file_id", "slide_index", z.cast("int").alias("z_index"), "source", "type", "name", *[F.coalesce(c, f"p.{c}").alias(c) for c in ("x", "y", "width", "height")])
