"""Cells, groups, listings and text search over the line catalogue."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import stem, stems
from waymark.sources.versions import checkpointed

#: Categories of ways one can walk.
WALKABLE = ("path", "footway", "track", "bridleway", "steps")
FOOT = ("designated", "yes")
#: Words that a text search leaves out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with")


def normalised(lat1: Column, lng1: Column, lat2: Column | None = None, lng2: Column | None = None) -> dict[str, Column]:
    """Cell range of one point or of two corners in any order."""
    if lat2 is None:
        return {"min_lat": F.floor(lat1), "min_lng": F.floor(lng1), "max_lat": F.floor(lat1) + 1, "max_lng": F.floor(lng1) + 1}
    return {
        "min_lat": F.floor(F.least(lat1, lat2)),
        "min_lng": F.floor(F.least(lng1, lng2)),
        "max_lat": F.ceil(F.greatest(lat1, lat2)),
        "max_lng": F.ceil(F.greatest(lng1, lng2)),
    }


def corners(min_lat: str, min_lng: str, max_lat: str, max_lng: str) -> Column:
    """Two corners, south-west first, as an array of structs."""
    point = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lng"))
    return F.array(point(min_lat, min_lng), point(max_lat, max_lng))


def cells(ranges: DataFrame) -> DataFrame:
    """lat, lng of every cell of (min_lat, min_lng, max_lat, max_lng), upper bounds exclusive."""
    valid = ranges.where("max_lat > min_lat and max_lng > min_lng")
    return valid.select(F.explode(F.sequence("min_lat", F.col("max_lat") - 1)).alias("lat"), "min_lng", "max_lng").select(
        "lat", F.explode(F.sequence("min_lng", F.col("max_lng") - 1)).alias("lng")
    ).distinct()


def node_counts(quads: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes per cell (0 without any); `quads` and `nodes` have the cell's keys."""
    counted = nodes.groupBy(*keys).agg(F.count("*").alias("node_count"))
    return quads.join(counted, keys, "left").withColumn("node_count", F.coalesce("node_count", F.lit(0)))


def filled_counts(quads: DataFrame, fresh: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`quads` with a null count taken from `fresh` (0 where that has no row); counts that stand stay."""
    new = fresh.select(*keys, F.col(column).alias("__new"))
    missing = F.col(column).isNull()
    lacking = quads.where(missing).join(new, keys, "left").withColumn(column, F.coalesce("__new", F.lit(0)).cast("long")).drop("__new")
    return quads.where(~missing).withColumn(column, F.col(column).cast("long")).unionByName(lacking)


def intersection_counts(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell, point keys that occur twice among all points, first points and last points."""
    points = vertices.select("gx", "gy", *keys)
    # each end counts once more, as in the union of all, first and last points
    times = F.lit(1) + F.when(F.col("idx") == 1, 1).otherwise(0) + F.when(F.col("idx") == F.col("n"), 1).otherwise(0)
    grouped = vertices.select(*points.columns, times.alias("times")).groupBy(*points.columns).agg(F.sum("times").alias("times"))
    return grouped.where("times > 1").groupBy(*keys).agg(F.count("*").alias("intersections"))


def walkable(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("highway").isin(*WALKABLE) | F.col("foot").isin(*FOOT))


def by_name(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Lines grouped by name: count and the sorted list of structs."""
    return lines.groupBy("name").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct(*columns))).alias("members"))


def by_name_and_kind(lines: DataFrame, columns: list[str], kind: str = "highway") -> DataFrame:
    """Two levels: a row per name, with a sorted list of (kind, lines, members)."""
    inner = lines.groupBy("name", kind).agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct(*columns))).alias("members"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(kind).alias("kind"), "lines", "members"))).alias("kinds")
    return inner.groupBy("name").agg(F.sum("lines").alias("lines"), listed)


def group_members(groups: DataFrame, members: DataFrame, lines: DataFrame) -> DataFrame:
    return members.join(lines, "line_id").join(groups, "group_id")


def terms(text: Column) -> Column:
    """Stems of the lower-case words, with their places: an array of (term, position) without stop words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    placed = F.zip_with(stems(words), F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("position"))), lambda t, p: F.struct(t.alias("term"), p["position"].alias("position"), p["word"].alias("word")))
    return F.filter(placed, lambda x: ~x["word"].isin(*STOP_WORDS))


def text_index(lines: DataFrame, key: str = "line_id", text: str = "name") -> DataFrame:
    """The inverted index of a text column: term, key, position, sorted by term and written once.

    Each row is one occurrence, so no term makes a wide row; files are in ranges of terms,
    so a look-up reads the few row groups that can hold its term.
    """
    found = lines.select(F.col(key).alias("key"), F.explode(terms(F.col(text))).alias("t")).select("t.term", "key", "t.position")
    return checkpointed(found.repartitionByRange("term", "key").sortWithinPartitions("term", "key"))


_TOKEN = re.compile(r"\s*(<->|[&|!()]|'(?:[^']|'')*'(?::\*)?|[A-Za-z0-9]+(?::\*)?)")


def matching(index: DataFrame, keys: DataFrame, query: str) -> DataFrame:
    """`key` of the texts of an index that satisfy a query with & | ! <-> ( ) and prefixes `word:*`.

    A word is a look-up by its stem, a prefix a range of terms, a phrase an equi-join on
    the next position, `&` a semi-join, `|` a union, and `!` an anti-join: against what
    stands beside it, or, alone, against all of `keys`.
    """
    items, at = [], 0
    while at < len(query.rstrip()):
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"cannot read the query at {query[at:]!r}")
        items.append(m.group(1))
        at = m.end()
    every = keys.select("key").distinct()

    def look(item: str) -> DataFrame:
        text = item.removesuffix(":*").strip("'").lower()
        held = F.col("term").startswith(text) if item.endswith(":*") else F.col("term") == stem(F.lit(text))
        return index.where(held).select("key", "position")

    def phrase() -> tuple[DataFrame, bool]:
        """Keys, and whether they are those that do not match."""
        if items and items[0] == "!":
            items.pop(0)
            df, out = phrase()
            return df, not out
        if items and items[0] == "(":
            items.pop(0)
            inner = either()
            if not items or items.pop(0) != ")":
                raise ValueError("a bracket is not closed")
            return inner
        if not items or items[0] in "&|)":
            raise ValueError("a word is missing")
        here = look(items.pop(0))
        while items and items[0] == "<->":
            items.pop(0)
            following = look(items.pop(0))
            here = following.join(here.select("key", (F.col("position") + 1).alias("position")).distinct(), ["key", "position"], "left_semi")
        return here.select("key").distinct(), False

    def both() -> tuple[DataFrame, bool]:
        df, out = phrase()
        while items and items[0] == "&":
            items.pop(0)
            other, not_other = phrase()
            if out and not_other:
                df = df.unionByName(other).distinct()
            elif out:
                df, out = other.join(df, "key", "left_anti"), False
            else:
                df = df.join(other, "key", "left_anti" if not_other else "left_semi")
        return df, out

    def either() -> tuple[DataFrame, bool]:
        df, out = both()
        while items and items[0] == "|":
            items.pop(0)
            other, not_other = both()
            if out and not_other:
                df = df.join(other, "key", "left_semi")
            elif out or not_other:
                df, out = (df.join(other, "key", "left_anti"), True) if out else (other.join(df, "key", "left_anti"), True)
            else:
                df = df.unionByName(other).distinct()
        return df, out

    df, out = either()
    if items:
        raise ValueError(f"cannot read the query at {items[0]!r}")
    return every.join(df, "key", "left_anti") if out else df


def search(lines: DataFrame, query: str, walk_only: bool = True, index: DataFrame | None = None) -> DataFrame:
    """The lines whose names satisfy a query, looked up in `index` (`text_index`).

    Where none is given, the lines are written once and an index of their different names
    is made, each name stemmed once; lines of a name match or fail together.
    """
    own = walkable(lines) if walk_only else lines
    if index is not None:
        found = matching(index, own.select(F.col("line_id").alias("key")), query)
        return own.join(found.withColumnRenamed("key", "line_id"), "line_id", "left_semi")
    own, name = checkpointed(own), F.coalesce("name", F.lit(""))
    names = checkpointed(own.select(name.alias("key")).distinct())
    # written, so that the join knows its size and does not move lines to few names
    found = checkpointed(matching(text_index(names, "key", "key"), names, query))
    return own.join(found.withColumnRenamed("key", "__name"), name == F.col("__name"), "left_semi")


def page(table: DataFrame, key: str, last: int | None, size: int) -> DataFrame:
    """The next rows after `last` by key: a report of bounded size."""
    rows = table if last is None else table.where(F.col(key) > last)
    return rows.orderBy(key).limit(size)
