"""Ignore files as data: which paths of a scan they leave out.

Every line of every ignore file is a row (folder, line, text). A path's entries are its folders and itself; each meets
the rules of the folders above it by an equality join, and the last rule that matches decides, deeper files
after outer ones and later lines after earlier ones. A path is ignored if any of its entries is: what lies in an
ignored folder cannot be taken back. Folders that many paths share are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.frames import small


def _pattern(body: Column) -> Column:
    """A glob as a regular expression: ``**`` crosses folders, ``*`` and ``?`` don't, classes stay."""
    steps = (
        (r"([.+^$(){}|])", r"\\$1"),
        (r"\[!", "[^"),
        (r"\*\*/", "\u0001"),
        (r"/\*\*$", "\u0002"),
        (r"\*+", "[^/]*"),
        (r"\?", "[^/]"),
        ("\u0001", "(?:.*/)?"),
        ("\u0002", "/.+"),
    )
    for old, new in steps:
        body = F.regexp_replace(body, old, new)
    return body


def rules(lines: DataFrame) -> DataFrame:
    """(folder, depth, line, negated, folders_only, regex) of the lines (folder, line, text) that are rules.

    Blank lines and comments are none. A backslash makes a first ``!`` or ``#`` plain. A rule with a slash before its end
    is bound to its folder, another matches names at any depth below it. The root's folder is the empty text.
    """
    plain = lines.select("folder", "line", F.regexp_replace("text", r"\s+$", "").alias("text")).where("text <> '' and not startswith(text, '#')")
    negated = F.startswith(F.col("text"), F.lit("!"))
    cut = plain.withColumn("negated", negated).withColumn("text", F.regexp_replace(F.when(negated, F.substring("text", 2, 1 << 20)).otherwise(F.col("text")), r"^\\([!#])", "$1"))
    cut = cut.withColumn("folders_only", F.endswith(F.col("text"), F.lit("/"))).withColumn("text", F.regexp_replace("text", "/$", "")).where("text <> ''")
    bound = F.contains(F.col("text"), F.lit("/"))
    regex = F.concat(F.when(bound, "^").otherwise("^(?:.*/)?"), _pattern(F.regexp_replace("text", "^/", "")), F.lit("$"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return cut.select("folder", depth.alias("depth"), "line", "negated", "folders_only", regex.alias("regex"))


def ignored_entries(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """(entry) of the folders and files, among the entries of the paths (path), whose last matching rule ignores them."""
    entries = _entries(paths).select("entry", "folder_entry").distinct()
    parts = F.split("entry", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    placed = entries.withColumn("folder", F.explode(above))
    met = placed.join(small(rules(lines)), "folder").where(F.col("folder_entry") | ~F.col("folders_only"))
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.substring(F.col("entry"), F.length("folder") + 2, F.length("entry")))
    hit = met.where(F.rlike(below, F.col("regex")))
    return hit.groupBy("entry", "folder_entry").agg(F.max_by("negated", F.struct("depth", "line")).alias("negated")).where("not negated").select("entry", "folder_entry")


def _entries(paths: DataFrame) -> DataFrame:
    """(path, entry, folder_entry): each path with its folders, outermost first, and itself."""
    parts = F.split("path", "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("entry"), (i < F.size(parts)).alias("folder_entry")))
    return paths.select("path").distinct().select("path", F.inline(every))


def ignored(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, ignored) of every distinct path (relative, parts between slashes), by the ignore files' lines (folder, line, text)."""
    gone = ignored_entries(paths, lines).withColumn("gone", F.lit(True))
    told = _entries(paths).join(small(gone), ["entry", "folder_entry"], "left")
    return told.groupBy("path").agg(F.coalesce(F.bool_or("gone"), F.lit(False)).alias("ignored"))
