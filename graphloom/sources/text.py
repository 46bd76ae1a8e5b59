"""Files as rows: whole texts, solution and project files, and unsaved texts that replace those on disk."""

from __future__ import annotations

from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def read_files(spark: SparkSession, root: str, pattern: str = "*.cs") -> DataFrame:
    """path (below root) and content of the files that match, outside ignored folders."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    found = F.col("_metadata.file_path")  # with %20 for a space
    path = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))), found), "^file:/*", "/")
    rows = raw.select(paths.relative(path, root.removeprefix("file://")).alias("path"), F.col("value").alias("content"))
    return rows.where(~paths.ignored(F.col("path")))


def with_open_documents(files: DataFrame, opened: DataFrame) -> DataFrame:
    """Texts of opened (path, content) replace those on disk, but for empty ones."""
    other = opened.where("content <> ''").select("path", F.col("content").alias("open_content"))
    return files.join(other, "path", "left").select("path", F.coalesce("open_content", "content").alias("content"))


def solution_projects(files: DataFrame) -> DataFrame:
    """path of each project that a solution lists: .sln lines or .slnx elements."""
    sln = files.where(F.lower("path").endswith(".sln")).select(F.explode(F.regexp_extract_all("content", F.lit(r'(?m)^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+)"'), 1)).alias("p"))
    slnx = files.where(F.lower("path").endswith(".slnx")).select(F.explode(F.xpath(F.when(well_formed(F.col("content")), F.col("content")).otherwise("<Solution/>"), F.lit("//Project/@Path"))).alias("p"))
    return sln.union(slnx).select(paths.normalized(F.col("p")).alias("path")).distinct()


def _well_formed(texts: pd.Series) -> pd.Series:
    def parses(text: str) -> bool:
        try:
            expat.ParserCreate().Parse(text or "", True)
        except expat.ExpatError:
            return False
        return True

    return texts.map(parses).astype(bool)


def well_formed(xml: Column) -> Column:
    """Whether a text parses. XPath functions fail the query on one that doesn't."""
    return F.pandas_udf(_well_formed, "boolean")(xml)


def _first(content: Column, path: str) -> Column:
    return F.xpath_string(content, F.lit(path))


def _list(content: Column, path: str) -> Column:
    return F.xpath(content, F.lit(path))


def project_type(sdk: Column, output: Column, name: Column, is_test: Column, packages: Column) -> Column:
    has = lambda text: F.exists(packages, lambda p: F.lower(p).contains(text))
    return (
        F.when(is_test, "test")
        .when(F.lower(sdk).contains("web"), "web")
        .when(F.lower(name).contains("lambda") | has("amazon.lambda"), "lambda")
        .when((F.lower(output) == "exe") & (F.lower(name).contains("worker") | has("hosting")), "worker")
        .when(F.lower(output) == "exe", "executable")
        .otherwise("classlib")
    )


def read_projects(files: DataFrame) -> DataFrame:
    """One row per project file: name, sdk, frameworks, output type, packages, references, whether a test project, type.

    A file that doesn't parse counts as an empty project.
    """
    own = files.where(F.lower("path").endswith(".csproj")).withColumn("xml", F.regexp_replace("content", r"\sxmlns\s*=\s*\"[^\"]*\"", ""))
    own = own.withColumn("xml", F.when(well_formed(F.col("xml")), F.col("xml")).otherwise("<Project/>"))
    x = F.col("xml")
    last = F.element_at(F.concat(F.array(F.lit("")), _list(x, "//OutputType/text()")), -1)
    read = own.select(
        "path", paths.stem(F.col("path")).alias("name"), _first(x, "/Project/@Sdk").alias("sdk"),
        F.filter(F.transform(F.split(F.concat_ws(";", _list(x, "//TargetFramework/text()"), _list(x, "//TargetFrameworks/text()")), ";"), lambda t: F.trim(t)), lambda t: t != "").alias("frameworks"),
        last.alias("output_type"), _list(x, "//PackageReference/@Include").alias("packages"),
        F.transform(_list(x, "//ProjectReference/@Include"), lambda p: F.regexp_replace(paths.basename(p), r"\.[^.]*$", "")).alias("references"), F.lower(_first(x, "//IsTestProject")).alias("flag"),
    )
    known = F.exists("packages", lambda p: F.lower(p).rlike(r"^(microsoft\.net\.test\.sdk|xunit|nunit|mstest)"))
    is_test = (F.col("flag") == "true") | paths.test_project(F.col("name"), F.col("path")) | known
    return read.withColumn("is_test", is_test).withColumn("type", project_type(F.col("sdk"), F.col("output_type"), F.col("name"), F.col("is_test"), F.col("packages"))).drop("flag")


def fingerprints(files: DataFrame) -> DataFrame:
    """project_id, name and (path, modified, size) of its files to one digest of all of them in order."""
    line = F.concat_ws("|", "path", "modified", "size")
    return files.groupBy("project_id", "name").agg(F.sha2(F.concat_ws("\n", F.first("name"), F.array_join(F.array_sort(F.collect_list(line)), "\n")), 256).alias("fingerprint"))
