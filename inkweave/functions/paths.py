"""Column functions over note paths, references and URIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders looked up for a bare note name, in order.
LOOKUP_FOLDERS = ["", "knowledge/", "journal/", "projects/"]
PRIVATE_FOLDER = "private/"
NOTE_SUFFIX = ".md"
URI_PREFIX = "memory:"
# Fixed value: longest path, in bytes, that may be exchanged.
MAX_SYNC_PATH_BYTES = 1024


def trim_space(c: Column) -> Column:
    """Trim Unicode white space (``trim`` only removes the space character)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def file_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def stem(c: Column) -> Column:
    """File name without its last extension; a leading dot is not an extension."""
    return F.regexp_replace(file_name(c), r"(?s)^(.+)\.[^.]*$", "$1")


def folder(c: Column) -> Column:
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit(""))


def extension(c: Column) -> Column:
    name = file_name(c)
    return F.when(F.instr(F.substring(name, 2, 2**31 - 1), ".") > 0, F.substring_index(name, ".", -1))


def with_path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    c = F.col(path)
    return df.withColumns({"stem": stem(c), "folder": folder(c), "extension": extension(c)})


def strip_md(c: Column) -> Column:
    return F.regexp_replace(c, r"\.md$", "")


def ensure_md(c: Column) -> Column:
    return F.when(c.endswith(NOTE_SUFFIX), c).otherwise(F.concat(c, F.lit(NOTE_SUFFIX)))


def normalize_ref(c: Column) -> Column:
    """``[[memory:folder/Note.md]]`` and its shorter forms -> STRUCT<path, name>."""
    bare = F.regexp_replace(trim_space(c), r"(?s)^\[\[(.*)\]\]$", "$1")
    path = strip_md(F.regexp_replace(bare, "^" + URI_PREFIX, ""))
    return F.struct(path.alias("path"), file_name(path).alias("name"))


def search_paths(name: Column, include_private: bool = False) -> Column:
    folders = LOOKUP_FOLDERS + ([PRIVATE_FOLDER] if include_private else [])
    return F.array(*[F.concat(F.lit(f), name) for f in folders])


def is_private(c: Column) -> Column:
    return c.startswith(PRIVATE_FOLDER)


def folder_priority(c: Column) -> Column:
    """0 root, 1 knowledge, 2 journal, 3 projects, 4 any other, 5 private."""
    return (
        F.when(F.instr(c, "/") == 0, 0)
        .when(c.startswith("knowledge/"), 1)
        .when(c.startswith("journal/"), 2)
        .when(c.startswith("projects/"), 3)
        .when(is_private(c), 5)
        .otherwise(4)
    )


def check_relative_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``clean_path`` and ``path_error`` (null when the path is safe)."""
    clean = F.regexp_replace(F.col(path), "^/", "")
    return df.withColumn("clean_path", clean).withColumn(
        "path_error",
        F.when(F.instr("clean_path", "..") > 0, "directory traversal").when(
            F.col("clean_path").startswith("/"), "absolute path"
        ),
    )


def check_sync_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``path_error``: the first rule a path breaks, null when it may be exchanged."""
    c = F.col(path)
    error = (
        F.when(c == "", "empty path")
        .when(F.instr(c, "..") > 0, "path traversal")
        .when(F.instr(c, "//") > 0, "empty path segment")
        .when(c.startswith("/"), "absolute path")
        .when(F.substring(c, 2, 1) == ":", "drive letter")
        .when(F.instr(c, "\\") > 0, "backslash")
        .when(F.contains(c, F.lit("\0")), "null byte")
        .when(~c.endswith(NOTE_SUFFIX), "not a markdown file")
        .when(c.rlike(r"\p{Cc}"), "control character")
        .when(F.octet_length(c) > MAX_SYNC_PATH_BYTES, "path too long")
    )
    return df.withColumn("path_error", error)


def percent_encode(c: Column) -> Column:
    """Percent-encode all but unreserved characters (``url_encode`` is form encoding)."""
    coded = F.url_encode(c)
    for form, percent in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(form), F.lit(percent))
    return coded


def note_uris(df: DataFrame, vault: str, scheme: str, path: str = "path") -> DataFrame:
    """Add ``memory_uri`` and ``open_uri`` (a link an editor with that scheme opens)."""
    bare = strip_md(F.col(path))
    return df.withColumns(
        {
            "memory_uri": F.concat(F.lit(URI_PREFIX), bare),
            "open_uri": F.concat(
                F.lit(f"{scheme}://open?vault="),
                percent_encode(F.lit(vault)),
                F.lit("&file="),
                percent_encode(bare),
            ),
        }
    )


def expand_ancestors(
    dirs: DataFrame, cwd: str = "cwd", home: str = "home"
) -> DataFrame:
    """One row per directory from ``cwd`` up to ``home`` (or the root): path, name, depth."""
    parts = F.filter(F.split(F.col(cwd), "/"), lambda p: p != "")
    n = F.size("_parts")
    step = F.concat(F.lit("/"), F.array_join(F.slice("_parts", 1, n - F.col("depth")), "/"))
    home_depth = F.size(F.filter(F.split(F.col(home), "/"), lambda p: p != ""))
    below_home = (F.col(cwd) == F.col(home)) | (F.col(home) == "/") | F.startswith(
        F.col(cwd), F.concat(F.col(home), F.lit("/"))
    )
    top = F.when(below_home, n - home_depth).otherwise(n)
    return (
        dirs.withColumn("_parts", parts)
        .withColumn("depth", F.explode(F.sequence(F.lit(0), top)))
        .withColumn("dir_path", step)
        .withColumn(
            "dir_name",
            F.when(
                n > F.col("depth"), F.element_at("_parts", F.greatest(n - F.col("depth"), F.lit(1)))
            ).otherwise(F.lit("")),
        )
        .drop("_parts")
    )


def normalize_remote(c: Column) -> Column:
    """Bring ssh and https forms of a repository address to ``host/owner/name``."""
    c = trim_space(c)
    host_path = F.when(
        c.startswith("git@"), F.replace(F.regexp_replace(c, "^git@", ""), F.lit(":"), F.lit("/"))
    ).otherwise(c)
    bare = F.regexp_replace(host_path, "^(https|http|ssh)://", "")
    bare = F.regexp_replace(bare, r"\.git$", "")
    return F.lower(F.regexp_replace(bare, "/+$", ""))
