"""Documents from files in any store that Spark reads: listing, pruning and reading by Spark's binaryFile source."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.sources.files import SKIPPED, SPECIAL, TEXT, documents_of, load_files, loader_of


def _any_case(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def name_pattern() -> str:
    """Glob of the loadable extensions, so that other files are listed but never opened."""
    return "*{" + ",".join(_any_case(e) for e in (*TEXT, *SPECIAL)) + "}"


def pruned_directory() -> str:
    """Expression of relative paths that lie below a directory that is left out."""
    return rf"(?:^|/)(?:{'|'.join(map(re.escape, SKIPPED))}|\.[^/]*)/"


def passed_over(spark: SparkSession, root: str) -> list[str]:
    """Loadable files that Spark's readers do not see, as they or a directory above begin with _ or, a file, with a dot."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, open_dirs = [], [(top, False)]
    while open_dirs:
        at, hidden = open_dirs.pop()
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if s.isDirectory():
                if name not in SKIPPED and not name.startswith("."):
                    open_dirs.append((s.getPath(), hidden or name.startswith("_")))
            elif (hidden or name[0] in "_.") and s.getLen() and any(name.lower().endswith(e) for e in (*TEXT, *SPECIAL)):
                found.append(s.getPath().toString())
    return sorted(found)


def load_stored(spark: SparkSession, root: str) -> DataFrame:
    """(source, text, error) of a file, or of the loadable files below a directory, in any file system that Spark knows;
    sources are relative to a directory, and a file's own path else.

    Spark lists and reads, in parallel and with only loadable names opened. A file that cannot be parsed is one row with an
    error and no text. Files whose name, or a directory's, begins with _ are not seen by Spark's readers: on the local file
    system they are read beside them, elsewhere each is a row with an error. Raises FileNotFoundError if there is no root.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    top = fs.makeQualified(path)
    is_file = fs.getFileStatus(path).isFile()
    base = top.toString().rstrip("/")
    files = spark.read.format("binaryFile")
    if not is_file:
        files = files.option("recursiveFileLookup", "true").option("pathGlobFilter", name_pattern())
    plain = lambda p: F.regexp_replace(p, "^file:/+", "/")  # noqa: E731  file:/x and file:///x are one place
    start = re.sub("^file:/+", "/", base)
    name = F.lit(root) if is_file else F.substr(plain(F.col("path")), F.lit(len(start) + 2))
    rows = files.load(root).select(name.alias("path"), "content")
    rows = rows.filter(~F.rlike("path", F.lit(pruned_directory()))) if not is_file else rows
    rows = rows.withColumn("loader", loader_of(F.col("path"))).filter("loader is not null and length(content) > 0")
    out = documents_of(rows)
    hidden = [] if is_file else passed_over(spark, root)
    if hidden and fs.getScheme() == "file":
        return out.unionByName(load_files(spark, [re.sub("^file:/+", "/", h) for h in hidden], start))
    if hidden:
        errors = [(h[len(base) + 1 :], None, "Spark's readers pass over names that begin with _ or a dot") for h in hidden]
        return out.unionByName(spark.createDataFrame(errors, "source string, text string, error string"))
    return out
