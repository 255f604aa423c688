"""Solutions read from files: projects, their references and packages, and documents, as fact tables.

Files are read by Spark, whole, from any folder that it can read; nothing is opened by the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import declarations

#: Names the solution folder that ``from_environment`` reads.
VARIABLE = "FACTGRAPH_SOLUTION"
_PROJECT = r'(?m)^Project\("[^"]*"\)\s*=\s*"([^"]*)"\s*,\s*"([^"]*\.csproj)"'


def slashes(path: Column) -> Column:
    """A path with forward slashes, without a scheme and without ``.`` and ``..`` steps."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^file:/*(?=/)", "")
    steps = F.filter(F.split(plain, "/", -1), lambda s: s != ".")

    def step(done: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(back, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(s)))

    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")


def relative(path: Column, folder: str) -> Column:
    """The path below a folder; a path elsewhere stays whole."""
    head = folder.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(head)), F.substring(path, F.lit(len(head) + 1), F.length(path))).otherwise(path)


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, text) of the files whose name fits, below the folder; a byte-order mark goes."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    return read.select(slashes(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """(project, path, dir, xml, in_solution): project files, and whether a solution file names them.

    The name is the solution's, else the file's. Without any solution file all projects count as in it.
    """
    found = _files(spark, folder, "*.csproj").withColumnRenamed("text", "xml")
    entry = F.arrays_zip(F.regexp_extract_all("text", F.lit(_PROJECT), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(_PROJECT), F.lit(2)).alias("file"))
    listed = _files(spark, folder, "*.sln").select(_folder(F.col("path")).alias("at"), F.explode(entry).alias("e"))
    listed = listed.select(slashes(F.concat_ws("/", "at", "e.file")).alias("path"), F.col("e.name").alias("listed")).groupBy("path").agg(F.min("listed").alias("listed"))
    solutions = listed.isEmpty()
    out = found.join(listed, "path", "left")
    name = F.regexp_extract("path", r"([^/]*)\.csproj$", 1)
    return out.select(F.coalesce("listed", name).alias("project"), "path", _folder(F.col("path")).alias("dir"), "xml", (F.col("listed").isNotNull() | F.lit(solutions)).alias("in_solution"))


def project_references(found: DataFrame) -> DataFrame:
    """(src, dst): projects that a project file refers to, by its path; references to files that are no project are left out."""
    items = F.regexp_extract_all("xml", F.lit(r"<ProjectReference\b[^>]*?\bInclude\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    refs = found.select(F.col("project").alias("src"), "dir", F.explode(items).alias("item")).select("src", slashes(F.concat_ws("/", "dir", "item")).alias("path"))
    return refs.join(found.select(F.col("project").alias("dst"), "path"), "path").select("src", "dst").distinct()


def packages(found: DataFrame) -> DataFrame:
    """The package references of every project."""
    return declarations.packages(found.select("project", "xml"))


def documents(spark: SparkSession, folder: str, found: DataFrame, pattern: str = "*.cs") -> DataFrame:
    """(doc_id, project, name, path, text, is_generated): source files with the project whose folder holds them, null if none does.

    Files below an output folder and files with a generator's ending count as generated. The id is a
    hash of the path, so that it stays the same from one read to the next.
    """
    files = _files(spark, folder, pattern)
    owned = declarations.owning_project(files.select("path"), found.select("dir", "project"))
    generated = F.col("path").rlike(r"(?i)/(?:obj|bin)/|\.(?:g|g\.i|designer|generated)\.cs$")
    return files.join(owned, "path").select(F.xxhash64("path").alias("doc_id"), "project", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path", "text", generated.alias("is_generated"))


def at_paths(found: DataFrame, paths: DataFrame) -> DataFrame:
    """The documents at the paths asked for, whichever slashes they are written with; null columns where there is none."""
    wanted = paths.select("path").distinct().withColumn("asked", F.col("path")).withColumn("path", slashes(F.col("path")))
    return wanted.join(found, "path", "left")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a solution folder by name."""
    found = projects(spark, folder)
    return {"projects": found, "project_references": project_references(found), "packages": packages(found), "documents": documents(spark, folder, found)}


def from_environment(spark: SparkSession) -> dict[str, DataFrame] | None:
    """The solution that the environment names; None if it names none."""
    folder = os.environ.get(VARIABLE)
    return load(spark, folder) if folder else None
