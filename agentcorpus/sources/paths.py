"""Names of files relative to the folder that was given."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LOCAL = "^file:/+"
GLOB = re.compile(r"[*?\[{]")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as file listings spell it before encoding."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(at).toString()


def relative(spark: SparkSession, root: str, path: Column, encoded: bool = True) -> Column:
    """The part of a listed path beneath ``root``; the base name where the root is the file itself.

    Paths in ``_metadata`` are percent-encoded and are decoded first; those of binary files are plain
    (``encoded=False``).  A root with a pattern counts up to the folder before it.  Equal base names in
    two folders stay apart, and a file that is not beneath the root is an error.
    """
    base = qualified(spark, root).rstrip("/")
    mark = GLOB.search(base)
    if mark:
        base = base[: base.rfind("/", 0, mark.start())]
    base = "file:/" + base.removeprefix("file:").lstrip("/") if base.startswith("file:") else base
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    spelled = F.regexp_replace(plain, LOCAL, "file:/")
    outside = F.raise_error(F.concat(spelled, F.lit(" is not beneath "), F.lit(base)))
    return (
        F.when(spelled.startswith(base + "/"), F.substring(spelled, len(base) + 2, 1 << 20))
        .when(spelled == base, F.lit(base.rsplit("/", 1)[-1]))
        .when(spelled.isNotNull(), outside.cast("string"))
    )
