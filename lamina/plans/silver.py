"""Bronze to silver: validity rules, one judgement per feed.

Each `judge_*` returns the whole feed with `_motif` and `_detail`, in silver
columns; `kept` and `rejects` split it. The stay a child row belongs to is
looked up once, so a feed costs one join whatever its number of motifs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamina.contract import CORRECTED, KEPT, PLAUSIBLE, SEX_DOMAIN, UNKNOWN
from lamina.functions.measures import clock_text, default_label, duration_days, normalise_sex, partition_month
from lamina.functions.parsing import is_blank
from lamina.operators.rules import Rule, judge, rejects
from lamina.operators.versions import latest_version, repeated_keys, superseded_versions, version_order
from lamina.operators.windows import after_window, before_window, outside_window
from lamina.sources.warehouse import LOT

DELIVERY_ORDER = ["_jour_depot", "_fichier_source"]

# Motif details, as the register words them (fixed values).
NO_PATIENT = "patient_pseudo vide (patient_id absent en source)"
BAD_ADMISSION = "date d'admission illisible dans la source"
BAD_DISCHARGE = "date de sortie non vide et illisible dans la source"
BAD_BIRTH = "date de naissance illisible en source -> birth_year NULL"
UNKNOWN_STAY = "stay_id absent de bronze.sejours"
STAY_WITHOUT_PATIENT = "séjour porteur sans patient identifié (patient_pseudo vide)"
REPLACED = "version remplacée par un dépôt plus récent"
MERGED = " ligne(s) bronze fusionnées sous un pseudonyme vide"


# ---- lots ------------------------------------------------------------------

# The moment whose month divides a judged feed: the one its fact is divided by.
LOT_MOMENT = {"sejours": "admission_ts", "diagnostics": "admission_ts", "monitoring": "ts", "actes": "acte_ts"}
PATIENT_LOT, VERSION_LOT = "patients", "versions"


def with_lot(feed: str, judged: DataFrame) -> DataFrame:
    return judged.withColumn(LOT, partition_month(F.to_date(LOT_MOMENT[feed])))


def register_lot(kind: str, lots: list[str]) -> list[str]:
    """Lots of the register that hold the rejects of some lots of a feed."""
    return [f"{kind}-{lot}" for lot in lots]


# ---- patients --------------------------------------------------------------


def retained_patients(bronze: DataFrame) -> DataFrame:
    """Latest delivery of each identified patient, as delivered."""
    known = bronze.where(~is_blank(F.col("patient_pseudo")))
    return latest_version(
        known, ["patient_pseudo"], version_order(known, ["patient_pseudo"], DELIVERY_ORDER)
    )


def silver_patients(retained: DataFrame) -> DataFrame:
    return retained.select(
        "patient_pseudo",
        "birth_year",
        normalise_sex(F.col("sex")).alias("sex"),
        "region_code",
        F.col("_jour_depot").alias("_jour_depot_retenu"),
        F.col("_fichier_source").alias("_fichier_source_retenu"),
    )


def corrected_patients(retained: DataFrame) -> DataFrame:
    """One register row per value corrected on a patient who stays in."""
    bad_sex = ~F.coalesce(F.upper(F.trim("sex")).isin(SEX_DOMAIN), F.lit(False))
    shown = F.concat(F.lit("sexe source ["), F.coalesce("sex", F.lit("")), F.lit(f"] -> {UNKNOWN}"))

    def correction(wrong, motif, detail):
        return F.when(wrong, F.struct(F.lit(motif).alias("motif"), detail.alias("detail")))

    corrections = F.array_compact(
        F.array(
            correction(bad_sex, "sexe_non_normalise", shown),
            correction(F.col("birth_year").isNull(), "date_naissance_illisible", F.lit(BAD_BIRTH)),
        )
    )
    return retained.select(
        F.lit("patients").alias("source"),
        F.col("patient_pseudo").alias("cle"),
        F.inline(corrections),
        "_jour_depot",
        "_fichier_source",
    ).select(
        "source", "cle", "motif", F.lit(CORRECTED).alias("action"), "detail",
        F.lit(1).cast("bigint").alias("nb_lignes"), "_jour_depot", "_fichier_source",
    )


def unidentified_patients(bronze: DataFrame) -> DataFrame:
    """All rows without a pseudonym, as one summary row; no row when there are none."""
    last = F.max(F.struct("_jour_depot", "_fichier_source"))
    return (
        bronze.where(is_blank(F.col("patient_pseudo")))
        .agg(F.count(F.lit(1)).alias("nb_lignes"), last.alias("_last"))
        .where(F.col("nb_lignes") > 0)
        .select(
            F.lit("patients").alias("source"),
            F.lit("(vide)").alias("cle"),
            F.lit("patient_manquant").alias("motif"),
            F.lit("ecarte").alias("action"),
            F.concat(F.col("nb_lignes").cast("string"), F.lit(MERGED)).alias("detail"),
            "nb_lignes",
            F.col("_last._jour_depot").alias("_jour_depot"),
            F.col("_last._fichier_source").alias("_fichier_source"),
        )
    )


# ---- stays -----------------------------------------------------------------


def retained_stays(bronze: DataFrame) -> DataFrame:
    """Latest delivery of each stay."""
    return latest_version(bronze, ["stay_id"], version_order(bronze, ["stay_id"], DELIVERY_ORDER))


def repeated_stays(bronze: DataFrame) -> DataFrame:
    """Ids of the stays delivered more than once."""
    return repeated_keys(bronze, ["stay_id"])


def replaced_stays(bronze: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Earlier deliveries of a stay, for the register."""
    older = superseded_versions(bronze, ["stay_id"], version_order(bronze, ["stay_id"], DELIVERY_ORDER), repeated)
    judged = older.withColumn("_motif", F.lit("version_remplacee")).withColumn("_detail", F.lit(REPLACED))
    return rejects(judged, "sejours", F.col("stay_id"))


def stay_rules() -> list[Rule]:
    admission, discharge = F.col("admission_ts"), F.col("discharge_ts")
    return [
        Rule("patient_manquant", is_blank(F.col("patient_pseudo")), F.lit(NO_PATIENT)),
        Rule(
            "date_illisible",
            admission.isNull() | (F.col("_discharge_illisible") == 1),
            F.when(admission.isNull(), F.lit(BAD_ADMISSION)).otherwise(F.lit(BAD_DISCHARGE)),
        ),
        Rule(
            "incoherence_temporelle",
            discharge < admission,
            F.concat(F.lit("admission="), clock_text(admission), F.lit(" sortie="), clock_text(discharge)),
        ),
    ]


def ruled_stays(retained: DataFrame) -> DataFrame:
    return judge(retained, stay_rules())


def judge_stays(retained: DataFrame, ref_services: DataFrame) -> DataFrame:
    labels = ref_services.select("service_code", "service_label")
    ongoing = F.col("discharge_ts").isNull()
    return ruled_stays(retained).join(labels, "service_code", "left").select(
        "stay_id",
        "patient_pseudo",
        "service_code",
        F.coalesce("service_label", F.lit(UNKNOWN)).alias("service_label"),
        "admission_ts",
        "discharge_ts",
        "admission_mode",
        default_label(F.col("discharge_mode")).alias("discharge_mode"),
        duration_days(F.col("admission_ts"), F.col("discharge_ts")).alias("duree_jours"),
        ongoing.cast("int").alias("est_en_cours"),
        "_jour_depot",
        "_fichier_source",
        "_motif",
        "_detail",
    )


def stay_lookup(judged_stays: DataFrame) -> DataFrame:
    """What a child row needs from its stay: who, where, when, and is the stay coherent."""
    return judged_stays.select(
        "stay_id",
        "patient_pseudo",
        "service_code",
        "admission_ts",
        F.col("discharge_ts").alias("_discharge_ts"),
        (F.col("_motif") == "retenu").cast("int").alias("_coherent"),
    )


# ---- rows carried by a stay ------------------------------------------------


def with_stay(child: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join to the retained stay: unique on the key, so no row multiplies.

    `sejour_coherent` is NULL for a stay that does not exist at all.
    """
    return child.join(lookup, "stay_id", "left").withColumnRenamed("_coherent", "sejour_coherent")


def carrier_rules() -> list[Rule]:
    missing = F.col("sejour_coherent").isNull()
    return [
        Rule("sejour_inconnu", missing, F.lit(UNKNOWN_STAY)),
        Rule("sejour_ecarte", is_blank(F.col("patient_pseudo")), F.lit(STAY_WITHOUT_PATIENT)),
    ]


def window_rule(motif: str, moment: str) -> Rule:
    """Outside the window of a coherent stay. An incoherent stay has no window to be outside of."""
    when, start, end = F.col(moment), F.col("admission_ts"), F.col("_discharge_ts")
    label = F.concat(F.lit(f"{moment}="), clock_text(when))
    detail = F.when(
        before_window(when, start), F.concat(label, F.lit(" antérieur à l'admission="), clock_text(start))
    ).when(after_window(when, end), F.concat(label, F.lit(" postérieur à la sortie="), clock_text(end)))
    return Rule(motif, (F.col("sejour_coherent") == 1) & outside_window(when, start, end), detail)


def sensor_rule() -> Rule:
    """Any measure outside its range, or missing, discards the whole reading."""
    sound = None
    for measure, (low, high) in PLAUSIBLE.items():
        inside = F.coalesce(F.col(measure).between(low, high), F.lit(False))
        sound = inside if sound is None else sound & inside
    shown = F.concat_ws(
        "",
        F.lit("fc="), F.col("heart_rate").cast("string"),
        F.lit(" spo2="), F.col("spo2").cast("string"),
        F.lit(" temp="), F.col("temp_c").cast("string"),
    )
    return Rule("capteur_hors_plage", ~sound, shown)


CARRIED = [
    "patient_pseudo", "service_code", "admission_ts", "sejour_coherent", "_jour_depot", "_fichier_source",
    "_motif", "_detail",
]


def labelled(df: DataFrame, reference: DataFrame, code: str) -> DataFrame:
    """Label of a code; a code the reference lacks keeps its row."""
    named = df.join(reference.select(code, "libelle"), code, "left")
    return named.withColumn("libelle", F.coalesce("libelle", F.lit(UNKNOWN)))


# Labels are joined before the stays: where the codes are too many to be sent to all tasks, the rows are still narrow.


def carry_diagnostics(bronze: DataFrame, lookup: DataFrame, *labels: str) -> DataFrame:
    return judge(with_stay(bronze, lookup), carrier_rules()).select("stay_id", "code_cim10", "type_diag", *labels, *CARRIED)


def judge_diagnostics(bronze: DataFrame, lookup: DataFrame, ref_cim10: DataFrame) -> DataFrame:
    return carry_diagnostics(labelled(bronze, ref_cim10, "code_cim10"), lookup, "libelle")


def judge_readings(bronze: DataFrame, lookup: DataFrame) -> DataFrame:
    rules = [sensor_rule(), *carrier_rules(), window_rule("releve_hors_sejour", "ts")]
    return judge(with_stay(bronze, lookup), rules).select(
        "stay_id", "ts", "heart_rate", "spo2", "temp_c", *CARRIED
    )


def carry_acts(bronze: DataFrame, lookup: DataFrame, *labels: str) -> DataFrame:
    rules = [*carrier_rules(), window_rule("acte_hors_sejour", "acte_ts")]
    return judge(with_stay(bronze, lookup), rules).select("stay_id", "code_ccam", "acte_ts", *labels, *CARRIED)


def judge_acts(bronze: DataFrame, lookup: DataFrame, ref_ccam: DataFrame) -> DataFrame:
    return carry_acts(labelled(bronze, ref_ccam, "code_ccam"), lookup, "libelle")


# ---- register keys ---------------------------------------------------------


def reject_key(feed: str) -> Column:
    """How the register names a rejected row of each feed."""
    stay = F.col("stay_id")
    return {
        "sejours": stay,
        "diagnostics": F.concat(stay, F.lit("/"), F.col("code_cim10")),
        "monitoring": F.concat(stay, F.lit("@"), clock_text(F.col("ts"))),
        "actes": F.concat(stay, F.lit("/"), F.col("code_ccam"), F.lit("@"), clock_text(F.col("acte_ts"))),
    }[feed]


def feed_rejects(feed: str, judged: DataFrame) -> DataFrame:
    return rejects(judged, feed, reject_key(feed))


# ---- the register in lots --------------------------------------------------


def register_of_feed(feed: str, judged: DataFrame) -> DataFrame:
    """Rejects of a judged feed, in lots named after the feed's."""
    lot = F.concat(F.lit(f"{feed}-"), F.col(LOT))
    return rejects(with_lot(feed, judged).withColumn(LOT, lot), feed, reject_key(feed), carry=[LOT])


def register_of_versions(bronze: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Earlier deliveries of stays, by the month they were delivered in."""
    lot = F.concat(F.lit(f"{VERSION_LOT}-"), partition_month(F.col("_jour_depot")))
    return replaced_stays(bronze, repeated).withColumn(LOT, lot)


def register_of_patients(bronze: DataFrame, retained: DataFrame) -> DataFrame:
    return unidentified_patients(bronze).unionByName(corrected_patients(retained)).withColumn(LOT, F.lit(PATIENT_LOT))
