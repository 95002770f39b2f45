"""Daily file drops laid out as `<feed>/<yyyy-MM-dd>/<file>`: what is there, and how to read it."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from lamina.contract import DAILY_FEEDS, DIAGNOSTICS_JSON, LAKE_COLUMNS, NESTED_COLUMNS
from lamina.functions.privacy import generalise_year, pseudonymise
from lamina.sources.mending import records

# feed, day and file at the end of a path; the day folder may be `name=<day>`.
_DROP = r"([^/]+)/(?:[^/=]+=)?([0-9]{4}-[0-9]{2}-[0-9]{2})/([^/]+)$"


def day_from_path(path: Column) -> Column:
    return F.to_date(F.regexp_extract(path, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))


def provenance(path: Column) -> Column:
    """`lake/<feed>/<day>/<file>`, whatever the storage the file was read from."""
    return F.concat_ws("/", F.lit("lake"), *[F.regexp_extract(path, _DROP, part) for part in (1, 2, 3)])


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row per dropped file. Lists names and sizes; no content is read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    )
    return files.where(F.col("path").rlike(_DROP)).select(
        F.regexp_extract("path", _DROP, 1).alias("feed"),
        F.to_date(F.regexp_extract("path", _DROP, 2)).alias("jour"),
        F.regexp_extract("path", _DROP, 3).alias("fichier"),
        F.col("path").alias("chemin"),
        F.col("length").alias("taille"),
    )


# ---- calendars -------------------------------------------------------------


def days_available(files: DataFrame) -> DataFrame:
    """Union of the days of all feeds: each feed has a calendar of its own."""
    return files.select("jour").distinct()


def days_pending(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """Days on which some dropped feed is not loaded. Both sides: (feed, jour).

    A day counts as done only when everything dropped that day is there.
    """
    return (
        expected.select("feed", "jour").distinct().join(loaded, ["feed", "jour"], "left_anti").select("jour").distinct()
    )


def latest_reference(files: DataFrame) -> DataFrame:
    """Most recent drop of each reference file, each on its own calendar."""
    return files.groupBy("fichier").agg(
        F.max("jour").alias("jour"), F.max_by("chemin", "jour").alias("chemin")
    )


def _declared() -> Column:
    return reduce(
        lambda a, b: a | b,
        [(F.col("feed") == feed) & (F.col("fichier") == name) for feed, name in LAKE_COLUMNS],
    )


def declared_files(files: DataFrame) -> DataFrame:
    """Files the whitelist knows. The others are never read."""
    return files.where(_declared())


def undeclared_files(files: DataFrame) -> DataFrame:
    return files.where(~_declared())


def daily_files(files: DataFrame) -> DataFrame:
    return declared_files(files).where(F.col("feed").isin(list(DAILY_FEEDS)))


# ---- readers ---------------------------------------------------------------


def _with_origin(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select("*", day_from_path(path).alias("_jour_depot"), provenance(path).alias("_fichier_source"))


# A quoted value may hold line breaks. Read like this a file is held in one task, as one of a single split is anyway.
CSV = {"header": True, "escape": '"', "multiLine": True}


def csv_headers(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, ...]]:
    """Header of each file: only first lines are read, several files at a time."""
    def header(path):
        return tuple(spark.read.options(**CSV).csv(path).columns)

    with ThreadPoolExecutor(8) as pool:
        return dict(zip(paths, pool.map(header, paths)))


def by_splits(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """Files that one task reads in any case, and those of several splits. Only their lengths are looked at."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    limit = int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    files = spark.read.format("binaryFile").load(paths).select("path", (F.col("length") > limit).alias("large")).collect()
    return [f.path for f in files if not f.large], [f.path for f in files if f.large]


def read_csv(spark: SparkSession, paths: list[str], headers: dict | None = None) -> DataFrame:
    """CSV files as text columns, matched by name; a file of more than one split is read by many tasks.

    Spark matches an explicit schema by position, so files are grouped by
    header: a column added or moved upstream cannot slide under another name. Lines end
    alike throughout a file, in a line feed or a carriage return and a line feed.
    Nothing is inferred from the data. Files without any line are left out.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in (headers or csv_headers(spark, paths)).items():
        if header:
            groups.setdefault(header, []).append(path)
    if not groups:
        raise FileNotFoundError("no CSV file with a header")
    frames = []
    for header, members in groups.items():
        schema = ", ".join(f"`{name}` string" for name in header)
        small, large = by_splits(spark, members)
        if small:
            frames.append(_with_origin(spark.read.schema(schema).options(**CSV).csv(small)))
        if large:
            rows = records(spark, large).where(~F.col("_premier"))
            row = F.from_csv("_texte", F.lit(schema), {"escape": '"', "multiLine": "true"})
            parsed = rows.select(row.alias("_ligne"), "_fichier").select("_ligne.*", "_fichier")
            path = F.col("_fichier")
            frames.append(parsed.select(
                *[F.col(f"`{name}`") for name in header], day_from_path(path).alias("_jour_depot"),
                provenance(path).alias("_fichier_source")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_json(spark: SparkSession, paths: list[str], schema: str, array_files: bool = True) -> DataFrame:
    """JSON under a declared schema: one pretty-printed array per file, or one object per line.

    A file that is one array is read by one task; line files split like text.
    """
    return _with_origin(spark.read.schema(schema).option("multiLine", array_files).json(paths))


def read_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files with the columns any of them has."""
    return _with_origin(spark.read.option("mergeSchema", True).parquet(*paths))


# ---- whitelist -------------------------------------------------------------


def project_whitelist(df: DataFrame, declared: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the declared columns, in declared order. A missing one is left out."""
    return df.select(*[c for c in declared if c in df.columns], *[c for c in keep if c in df.columns])


def project_nested(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """The same whitelist inside the elements of an array column."""
    present = df.schema[column].dataType.elementType.fieldNames()
    wanted = [f for f in fields if f in present]
    return df.withColumn(
        column, F.transform(column, lambda item: F.struct(*[item[f].alias(f) for f in wanted]))
    )


def key_paths(df: DataFrame, text: str, group: str) -> DataFrame:
    """(group, chemin, profondeur, type): every key path of the JSON texts of a column, by group.

    One job whatever the number of groups, files say: each gives the merged type of
    its texts, and only those types come to the driver, a line for each group.
    `[]` stands for the elements of an array. A text that is no JSON counts as `illisible`.
    """
    value = F.try_parse_json(F.col(text))
    merged = df.where(F.col(text).isNotNull() & (F.trim(text) != "")).groupBy(group).agg(
        F.schema_of_variant_agg(value).alias("type"), F.count_if(value.isNull()).alias("illisibles"))
    found = []
    for row in merged.collect():
        if row["illisibles"]:
            found.append((row[group], "", 0, "illisible"))
        found += [(row[group], *path) for path in paths_of(row["type"])]
    return df.sparkSession.createDataFrame(found, f"`{group}` string, chemin string, profondeur int, type string")


def paths_of(ddl: str) -> list[tuple[str, int, str]]:
    """(path, depth, type) of all keys of a merged JSON type."""
    out: list[tuple[str, int, str]] = []

    def walk(kind, path: str, depth: int) -> None:
        if isinstance(kind, ArrayType):
            walk(kind.elementType, f"{path}[]", depth)
        elif isinstance(kind, StructType):
            for field in kind.fields:
                name = f"{path}.{field.name}" if path else field.name
                shown = field.dataType.typeName()
                out.append((name, depth + 1, {"struct": "object"}.get(shown, shown)))
                walk(field.dataType, name, depth + 1)

    walk(StructType.fromDDL(f"v {ddl.replace('OBJECT<', 'STRUCT<')}")["v"].dataType, "", 0)
    return out


def nested_drift(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """One row per key that JSON files have and the declaration lacks, or the reverse, at any depth.

    A file holds one array, or an object a line. It is one text here, as it is for the scan that follows.
    """
    declared = set(columns) | {f"{c}[].{key}" for c in columns for key in NESTED_COLUMNS.get(c, [])}
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("fichier"))
    one_value = F.try_parse_json("value").isNotNull()
    # A file of objects, one a line, is read line by line.
    texts = files.select("fichier", F.explode(F.when(one_value, F.array("value")).otherwise(F.split("value", "\n"))).alias("texte"))
    found: dict[str, set[str]] = {}
    broken = []
    for row in key_paths(texts, "texte", "fichier").collect():  # a line for each key of each file
        if row.type == "illisible":
            broken.append((row.fichier, "", "illisible"))
        else:
            found.setdefault(row.fichier, set()).add(row.chemin.removeprefix("[]."))
    gaps = [(file, c, "retiree") for file, own in sorted(found.items()) for c in sorted(own - declared)]
    # A key below another is only missed where the other is there.
    gaps += [(file, c, "manquante") for file, own in sorted(found.items()) for c in sorted(declared - own)
             if "[]." not in c or c.split("[].")[0] in own]
    return spark.createDataFrame(gaps + broken, "fichier string, colonne string, ecart string")


def schema_drift(spark: SparkSession, found: dict[str, list[str]], declared: dict[str, list[str]]) -> DataFrame:
    """One row per column that appeared or went missing, per file."""
    gaps = [
        (name, column, verdict)
        for name, columns in found.items()
        for verdict, gap in (
            ("retiree", [c for c in columns if c not in declared[name]]),
            ("manquante", [c for c in declared[name] if c not in columns]),
        )
        for column in gap
    ]
    return spark.createDataFrame(gaps, "fichier string, colonne string, ecart string")


# ---- identity --------------------------------------------------------------


def hide_identity(feed: str, df: DataFrame, salt: bytes) -> DataFrame:
    """Replace the patient number by its pseudonym; a birth date by its year.

    Both feeds use the same salt, so their joins survive. Names and numbers
    go with the whitelist that follows.
    """
    if "patient_id" not in df.columns:
        return df
    hidden = df.withColumn("patient_pseudo", pseudonymise(F.col("patient_id"), salt)).drop("patient_id")
    if feed == "patients" and "birth_date" in df.columns:
        hidden = hidden.withColumn("birth_year", generalise_year(F.col("birth_date"))).drop("birth_date")
    return hidden


def lake_frame(spark: SparkSession, feed: str, file: str, paths: list[str], salt: bytes) -> DataFrame:
    """A feed as the lake may hold it: identity hidden, whitelisted, with its origin."""
    origin = ("_jour_depot", "_fichier_source")
    if file.endswith(".csv"):
        raw = read_csv(spark, paths)
    elif file.endswith(".json"):
        raw = read_json(spark, paths, DIAGNOSTICS_JSON)
    elif file.endswith(".parquet"):
        raw = read_parquet(spark, paths)
    else:
        raise ValueError(f"unsupported format: {file}")
    projected = project_whitelist(hide_identity(feed, raw, salt), LAKE_COLUMNS[(feed, file)], origin)
    for column, fields in NESTED_COLUMNS.items():
        if column in projected.columns:
            projected = project_nested(projected, column, fields)
    return projected


def lake_drift(spark: SparkSession, feed: str, file: str, paths: list[str]) -> DataFrame:
    """Columns the drop has and the whitelist does not, and the reverse.

    Identity columns that `hide_identity` replaces count under their new name.
    """
    if file.endswith(".csv"):
        found = csv_headers(spark, paths)
    elif file.endswith(".json"):
        return nested_drift(spark, paths, LAKE_COLUMNS[(feed, file)])
    else:
        found = {path: spark.read.parquet(path).columns for path in paths}
    renamed = {"patient_id": "patient_pseudo", "birth_date": "birth_year"} if feed in ("patients", "sejours") else {}
    shown = {path: [renamed.get(c, c) for c in columns] for path, columns in found.items() if columns}
    return schema_drift(spark, shown, {path: LAKE_COLUMNS[(feed, file)] for path in shown})
