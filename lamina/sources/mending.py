"""CSV records that span lines, put together again from files that are read in splits.

A quoted value may hold line breaks, so where a record ends depends on what
came before. Files are read as lines, by many tasks, and each line says what it
does to a reader that comes to it outside quotes, and to one that comes inside:
leave it as it is, turn it round, or bring it to one state whatever it was.
Those three add up in any grouping. Summed over the blocks of a file in their
order, they give the state at the start of each block; summed within a block,
the state at each line. Lines that begin outside quotes begin records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ORDER = ["_bloc", "_nr"]


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_fichier, _bloc, _nr, _ligne): the lines of files with their place, split like any text."""
    scan = spark.read.option("lineSep", "\n").text(paths)
    return scan.select(
        F.col("_metadata.file_path").alias("_fichier"), F.col("_metadata.file_block_start").alias("_bloc"),
        F.monotonically_increasing_id().alias("_nr"), F.col("value").alias("_ligne"))


def open_after(line: Column, inside: bool) -> Column:
    """Whether a quoted value is open after a line, for a reader that comes to it inside quotes or not.

    A quote opens at the start of a value only, is written twice within one, and closes else. States: 0 outside,
    1 inside, 2 after a quote inside, which the next character explains.
    """
    parts = F.split(line, '"')
    first = F.get(parts, 0)

    def state(number, fresh):
        return F.struct(number.cast("int").alias("at"), fresh.alias("fresh"))

    begun = state(F.lit(int(inside)), (first == "") | first.endswith(","))

    def step(now, text):
        quoted = (
            F.when(now["at"] == 1, 2).when(now["at"] == 2, 1).when(now["fresh"], 1).otherwise(0)
        )
        # What follows a quote: nothing, or text that tells a closing quote from one written twice.
        return F.when(text == "", state(quoted, F.lit(False))).otherwise(
            state(F.when(quoted == 2, 0).otherwise(quoted), text.endswith(",")))

    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    ended = F.aggregate(rest, begun, step)["at"] == 1
    return F.when(F.contains(line, F.lit('"')), ended).otherwise(F.lit(inside))


def effects(lines: DataFrame) -> DataFrame:
    """`_fixe`: the state a line brings any reader to (NULL: none); `_tourne`: 1 if it turns the state round."""
    outside, within = open_after(F.col("_ligne"), False).cast("int"), open_after(F.col("_ligne"), True).cast("int")
    told = lines.withColumn("_o", outside).withColumn("_i", within)
    return told.withColumn("_fixe", F.when(F.col("_o") == F.col("_i"), F.col("_o"))).withColumn(
        "_tourne", (F.col("_o") > F.col("_i")).cast("int")).drop("_o", "_i")


def so_far(df: DataFrame, window, into: str) -> DataFrame:
    """Add `<into>_fixe` and `<into>_tours`: the last state fixed in the window, and the turns since (or in all of it)."""
    turns = F.sum("_tourne").over(window)
    # Turns are counted from the start; those up to the fixing line are taken off again.
    fixed = F.last(F.when(F.col("_fixe").isNotNull(), F.struct("_fixe", F.col("_tours").alias("avant"))), True).over(window)
    return df.withColumn("_point", fixed).withColumn(f"{into}_fixe", F.col("_point._fixe")).withColumn(
        f"{into}_tours", F.coalesce(turns, F.lit(0)) - F.coalesce(F.col("_point.avant"), F.lit(0))).drop("_point")


def state_from(fixed: Column, turns: Column, start: Column) -> Column:
    return (F.coalesce(fixed, start) + turns) % 2


def block_starts(lines: DataFrame) -> DataFrame:
    """(_fichier, _bloc, _debut, _reste): the state at the start of each block, and the record open there."""
    inside = Window.partitionBy("_fichier", "_bloc").orderBy("_nr")
    told = effects(lines).drop("_ligne").withColumn("_tours", F.sum("_tourne").over(inside))
    whole = so_far(told, inside.rowsBetween(Window.unboundedPreceding, 0), "_ici")
    # One row for each block of a file.
    blocks = whole.groupBy("_fichier", "_bloc").agg(F.max_by(F.struct("_ici_fixe", "_ici_tours"), "_nr").alias("_fin")).select(
        "_fichier", "_bloc", F.when(F.col("_fin._ici_fixe").isNotNull(), (F.col("_fin._ici_fixe") + F.col("_fin._ici_tours")) % 2).alias("_fixe"),
        F.when(F.col("_fin._ici_fixe").isNull(), F.col("_fin._ici_tours") % 2).otherwise(0).cast("int").alias("_tourne"))
    along = Window.partitionBy("_fichier").orderBy("_bloc")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    seen = so_far(blocks.withColumn("_tours", F.sum("_tourne").over(along)), before, "_avant")
    return seen.select("_fichier", "_bloc", state_from(F.col("_avant_fixe"), F.col("_avant_tours"), F.lit(0)).alias("_debut"))


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_fichier, _premier, _texte): the records of CSV files, line breaks within quotes kept; blank lines are none.

    `_premier` marks the first record of a file, its header.
    """
    lines = lines_of(spark, paths)
    inside = Window.partitionBy("_fichier", "_bloc").orderBy("_nr")
    told = effects(lines).withColumn("_tours", F.sum("_tourne").over(inside)).join(
        block_starts(lines), ["_fichier", "_bloc"])
    placed = so_far(told, inside.rowsBetween(Window.unboundedPreceding, -1), "_avant")
    state = state_from(F.col("_avant_fixe"), F.col("_avant_tours"), F.col("_debut"))
    after = F.when(F.col("_fixe").isNotNull(), F.col("_fixe")).otherwise((state + F.col("_tourne")) % 2)
    known = placed.withColumn("_etat", state).withColumn("_apres", after).select(
        "_fichier", *ORDER, "_ligne", "_etat", "_apres")
    head = F.when(F.col("_etat") == 0, F.struct(*ORDER))
    written = F.min(F.when(F.trim("_ligne", F.lit(" \r")) != "", F.col("_nr"))).over(Window.partitionBy("_fichier", "_bloc"))
    known = known.withColumn("_premier", (F.col("_bloc") == 0) & F.col("_nr").eqNullSafe(written)).withColumn(
        "_tete", F.last(head, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    # How a file's first line ends is how its lines end: one row for each file.
    ending = lines.where("_bloc = 0").groupBy("_fichier").agg(
        F.min_by(F.col("_ligne").endswith("\r"), "_nr").alias("_retour"))
    alone = known.where("_etat = 0 AND _apres = 0").select("_fichier", "_premier", F.col("_ligne").alias("_texte"))
    # A record of several lines is named by its first, which for lines at the start of a block is the last
    # that began one in the blocks before: one row for each block tells.
    heads = known.groupBy("_fichier", "_bloc").agg(F.max(head).alias("_derniere"))
    along = Window.partitionBy("_fichier").orderBy("_bloc").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select("_fichier", "_bloc", F.last("_derniere", True).over(along).alias("_avant"))
    several = known.where("_etat = 1 OR _apres = 1").join(carried, ["_fichier", "_bloc"])
    named = several.withColumn("_nom", F.coalesce("_tete", "_avant"))
    joined = named.groupBy("_fichier", "_nom").agg(
        F.array_sort(F.collect_list(F.struct(*ORDER, "_ligne"))).alias("_lignes"), F.max("_premier").alias("_premier"))
    # A file that ends inside quotes ends its record.
    mended = joined.select("_fichier", "_premier", F.array_join("_lignes._ligne", "\n").alias("_texte"))
    plain = F.regexp_replace("_texte", "\r(\n|$)", "$1")
    every = alone.unionByName(mended).join(ending, "_fichier").withColumn(
        "_texte", F.when(F.col("_retour"), plain).otherwise(F.col("_texte")))
    return every.where(F.trim("_texte") != "").drop("_retour")
