"""A catalog of versions in local or shared folders: ``root/org/name/major.minor.patch``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import select as sel
from chronoloom.operators.store import _fs

REFERENCE = re.compile(r"^([a-z0-9][\w.-]*)/([a-z0-9][\w.-]*)(?:@(latest|(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)))?$")
SCHEMA = "id string, source int, major int, minor int, patch int, path string, name string, description string, tags array<string>, domain string, license string"


def parse_reference(text: str) -> tuple[str, str | None]:
    """``org/name[@version]`` as id and version; anything else is an error."""
    m = REFERENCE.match(text)
    if not m:
        raise ValueError(f"not a dataset reference: {text!r}")
    return f"{m[1]}/{m[2]}", m[3]


def versions(spark: SparkSession, roots: list[str]) -> DataFrame:
    """A row per version found in ``roots`` (source is the place in the list). Hidden and staging folders, and folders whose
    name isn't a version, are skipped. All cards of a root are read by one job."""
    found = spark.createDataFrame([], SCHEMA)
    card = "name string, description string, tags array<string>, domain string, license string"
    number = r"(0|[1-9]\d*)"
    for i, root in enumerate(roots):
        pattern = f"{root.rstrip('/')}/*/*/*/card.json"
        fs, p = _fs(spark, pattern)
        if not fs.globStatus(p):
            continue
        rows = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", card).alias("c"))
        at = rf"/([^./][^/]*)/([^./][^/]*)/{number}\.{number}\.{number}/card\.json$"
        part = [F.regexp_extract("file", at, k) for k in range(1, 6)]
        found = found.unionByName(
            rows.where(F.col("file").rlike(at)).select(
                F.concat_ws("/", *part[:2]).alias("id"), F.lit(i).alias("source"), *[x.cast("int").alias(n) for n, x in zip(("major", "minor", "patch"), part[2:])], F.regexp_replace("file", r"/card\.json$", "").alias("path"),
                "c.name", "c.description", F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"), "c.domain", "c.license",
            )
        )
    return found


def newest(found: DataFrame) -> DataFrame:
    return sel.newest(found, "id", ["major", "minor", "patch"]).orderBy("id")


def search(found: DataFrame, query: list[str] | None = None, domains: list[str] | None = None, licenses: list[str] | None = None, tags: list[str] | None = None, limit: int | None = 100) -> DataFrame:
    """Newest versions that match: any term in name, description or tags; any domain; any license; all tags."""
    any_of = {k: v for k, v in (("domain", domains), ("license", licenses)) if v}
    cards = newest(found)
    cards = cards.withColumn("_text", F.concat_ws(" ", "name", "description", F.concat_ws(" ", "tags")))
    return sel.search(cards, query, ["_text"], any_of, {"tags": tags} if tags else None, "id", limit).drop("_text")


def resolve(found: DataFrame, reference: str) -> str:
    """Path of a reference: an exact version from the first source that has it, ``latest`` from all sources, none the
    newest of the first source."""
    key, version = parse_reference(reference)
    mine = found.where(found["id"] == key)
    if version not in (None, "latest"):
        major, minor, patch = map(int, version.split("."))
        rows = mine.where((mine["major"] == major) & (mine["minor"] == minor) & (mine["patch"] == patch)).orderBy("source").limit(1)
    else:
        rows = sel.resolve_version(mine, "id", "source", ["major", "minor", "patch"], latest=version == "latest")
    hit = rows.select("path").head()
    if hit is None:
        raise LookupError(reference)
    return hit["path"]
