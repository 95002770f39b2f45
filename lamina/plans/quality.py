"""Checks on a built warehouse. Each gives rows (controle, observe, attendu, ok)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamina.contract import (
    DEATH, DIMENSIONS, DIRECT_IDENTIFIERS, DISCARDED, CORRECTED, FOREIGN_KEYS, GOLD_ONLY, MOTIFS, PERSONAL_DATA,
    PLAUSIBLE, RESEARCH_FORBIDDEN, SEX_DOMAIN, SMALL_CELL, UNDESCRIBED, UNKNOWN, URGENT_MODE,
)
from lamina.functions.measures import month_start
from lamina.functions.parsing import is_blank
from lamina.operators.windows import outside_window

Tables = dict[str, DataFrame]

# Half a unit of the second digit, and room for the last bits of a double.
SHARE_ROUNDING = 0.005 + 1e-9


def stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _rows(df: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    lines = [
        F.struct(
            F.lit(name).alias("controle"),
            observed.cast("bigint").alias("observe"),
            expected.cast("bigint").alias("attendu"),
        )
        for name, observed, expected in checks
    ]
    return df.select(F.inline(F.array(*lines))).withColumn(
        "ok", F.col("observe").eqNullSafe(F.col("attendu")).cast("int")
    )


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows breaking each condition, all counted in one pass; none is expected."""
    names = list(checks)
    counted = df.agg(*[F.count_if(F.coalesce(checks[n], F.lit(False))).alias(f"c{i}") for i, n in enumerate(names)])
    return _rows(counted, [(name, F.col(f"c{i}"), F.lit(0)) for i, name in enumerate(names)])


def equalities(spark: SparkSession, pairs: dict[str, tuple]) -> DataFrame:
    """Observed against expected, each a one-value frame or a constant."""
    def value(side):
        return side.scalar() if isinstance(side, DataFrame) else F.lit(side)

    return _rows(spark.range(1), [(name, value(a), value(b)) for name, (a, b) in pairs.items()])


def total(df: DataFrame, column: Column | str | None = None, where: Column | None = None) -> DataFrame:
    """One value: rows, or a sum, possibly filtered."""
    rows = df if where is None else df.where(where)
    return rows.agg(F.count(F.lit(1)) if column is None else F.coalesce(F.sum(column), F.lit(0)))


# ---- conservation ----------------------------------------------------------


def conservation(bronze: Tables, kept: Tables, register: DataFrame) -> DataFrame:
    """Per feed: bronze rows = silver rows + discarded rows. Corrections do not count."""
    def side(frame, source, column):
        return frame.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(source).alias("source"), F.lit(column).alias("part"), "n"
        )

    parts = [side(bronze[s], s, "bronze") for s in kept] + [side(kept[s], s, "silver") for s in kept]
    discarded = (
        register.where((F.col("action") == DISCARDED) & F.col("source").isin(list(kept)))
        .groupBy("source")
        .agg(F.sum("nb_lignes").alias("n"))
        .select("source", F.lit("ecartes").alias("part"), "n")
    )

    def of(part):
        return F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0))

    return (
        stacked([*parts, discarded])
        .groupBy("source")
        .agg(of("bronze").alias("bronze"), of("silver").alias("silver"), of("ecartes").alias("ecartes"))
        .withColumn("ok", (F.col("bronze") == F.col("silver") + F.col("ecartes")).cast("int"))
    )


def snapshot_conservation(bronze_patients: DataFrame, silver_patients: DataFrame) -> DataFrame:
    """A cumulative snapshot keeps one row per identified patient."""
    identified = bronze_patients.where(~is_blank(F.col("patient_pseudo"))).select("patient_pseudo").distinct()
    return equalities(
        silver_patients.sparkSession,
        {
            "patients identifiés = silver.patients": (total(silver_patients), total(identified)),
            "aucun doublon en silver.patients": (
                total(silver_patients), total(silver_patients.select("patient_pseudo").distinct()),
            ),
        },
    )


# ---- rules left standing ---------------------------------------------------


def rule_residuals(bronze_stays: DataFrame, silver: Tables, register: DataFrame) -> DataFrame:
    """Nothing a rule should have stopped is left in silver."""
    stays, readings = silver["sejours"], silver["monitoring"]
    out_of_range = reduce(
        lambda a, b: a | b, [~F.col(m).between(low, high) for m, (low, high) in PLAUSIBLE.items()]
    )
    windows = stays.select("stay_id", F.col("admission_ts").alias("_in"), F.col("discharge_ts").alias("_out"))
    placed = readings.select("stay_id", "ts").join(windows, "stay_id")
    unreadable = F.col("admission_ts").isNull() | (F.col("_discharge_illisible") == 1)
    unreadable_kept = bronze_stays.where(unreadable).join(stays, "stay_id", "left_semi")
    return stacked(
        [
            violations(
                stays,
                {
                    "silver.sejours : durée négative": F.col("duree_jours") < 0,
                    "silver.sejours : durée absente sans séjour en cours": F.col("duree_jours").isNull()
                    != (F.col("est_en_cours") == 1),
                    "silver.sejours : mode de sortie vide": is_blank(F.col("discharge_mode")),
                    "silver.sejours : pseudonyme vide": is_blank(F.col("patient_pseudo")),
                    "silver.sejours : service non résolu": F.col("service_label") == UNKNOWN,
                },
            ),
            violations(
                silver["patients"],
                {
                    "silver.patients : pseudonyme vide": is_blank(F.col("patient_pseudo")),
                    "silver.patients : sexe hors domaine": ~F.col("sex").isin(*SEX_DOMAIN, UNKNOWN),
                    "silver.patients : casse ou espace résiduel": (F.col("sex") != UNKNOWN)
                    & (F.col("sex") != F.upper(F.trim("sex"))),
                },
            ),
            violations(readings, {"silver.monitoring : mesure hors plage": out_of_range}),
            violations(
                placed, {"silver.monitoring : hors fenêtre": outside_window(F.col("ts"), F.col("_in"), F.col("_out"))}
            ),
            violations(silver["diagnostics"], {"silver.diagnostics : code non résolu": F.col("libelle") == UNKNOWN}),
            violations(silver["actes"], {"silver.actes : code non résolu": F.col("libelle") == UNKNOWN}),
            violations(register, {"registre : action inconnue": ~F.col("action").isin(DISCARDED, CORRECTED)}),
            equalities(
                stays.sparkSession, {"silver.sejours : date illisible conservée": (total(unreadable_kept), 0)}
            ),
        ]
    )


def anomaly_counters(bronze_stays: DataFrame) -> DataFrame:
    """Open, incoherent, closed without a mode: one pass over bronze."""
    open_stay = F.col("discharge_ts").isNull()
    return bronze_stays.agg(
        F.count_if(open_stay).alias("sejours_en_cours"),
        F.count_if(F.col("discharge_ts") < F.col("admission_ts")).alias("incoherence_temporelle"),
        F.count_if(is_blank(F.col("discharge_mode")) & ~open_stay).alias("mode_sortie_absent"),
    )


def unknown_motifs(register: DataFrame, known: dict[str, list[str]] = MOTIFS) -> DataFrame:
    """Motifs in the register that no source is known to use."""
    declared = register.sparkSession.createDataFrame(
        [(source, motif) for source, motifs in known.items() for motif in motifs], "source string, motif string"
    )
    seen = register.groupBy("source", "motif").agg(F.sum("nb_lignes").alias("nb_lignes"))
    return seen.join(declared, ["source", "motif"], "left_anti")


# ---- integrity -------------------------------------------------------------


def orphans(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Rows of `child` whose key the parent lacks. Keys are counted first, then looked up."""
    keys = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return total(keys.join(parent.select(key).distinct(), key, "left_anti"), "n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)))


def integrity_report(gold: Tables) -> DataFrame:
    """Every foreign key of a fact names a member; every dimension key is unique."""
    pairs = {
        f"{fact}.{key} -> {dim}": (orphans(gold[fact], key, gold[dim]), 0) for fact, key, dim in FOREIGN_KEYS
    }
    pairs |= {f"{dim}.{key} unique": (duplicates(gold[dim], [key]), 0) for dim, key in DIMENSIONS.items()}
    return equalities(gold["dim_service"].sparkSession, pairs)


def grain_check(gold: Tables) -> DataFrame:
    """Rows and distinct keys of each fact at its declared grain."""
    grains = {
        "fact_sejour": ["stay_id"],
        "fact_diagnostic": ["stay_id", "code_cim10", "type_diag"],
        "fact_releve": ["stay_id", "ts"],
    }
    frames = [
        gold[fact]
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lignes"), F.count(F.lit(1)).alias("cles"))
        .select(F.lit(fact).alias("fait"), "lignes", "cles")
        for fact, keys in grains.items()
    ]
    return stacked(frames)


def parent_fidelity(child: DataFrame, retained: DataFrame, name: str) -> DataFrame:
    """What a child row copied from its stay is what the retained version says."""
    source = retained.select(
        "stay_id",
        F.col("patient_pseudo").alias("_who"),
        F.col("service_code").alias("_where"),
        F.col("admission_ts").alias("_when"),
    )
    joined = child.select("stay_id", "patient_pseudo", "service_code", "admission_ts").join(source, "stay_id")
    differs = (
        ~F.col("patient_pseudo").eqNullSafe(F.col("_who"))
        | ~F.col("service_code").eqNullSafe(F.col("_where"))
        | ~F.col("admission_ts").eqNullSafe(F.col("_when"))
    )
    return violations(joined, {f"silver.{name} : attributs du séjour porteur": differs})


def coherence_fidelity(child: DataFrame, silver_stays: DataFrame, name: str) -> DataFrame:
    """`sejour_coherent` says exactly whether the stay is in silver."""
    present = silver_stays.select("stay_id").distinct().withColumn("_present", F.lit(1))
    joined = child.select("stay_id", "sejour_coherent").join(present, "stay_id", "left")
    wrong = F.col("sejour_coherent") != F.coalesce("_present", F.lit(0))
    return violations(joined, {f"silver.{name} : sejour_coherent": wrong})


def null_iff(gold: Tables) -> DataFrame:
    """An age is missing exactly when the birth year (or the admission date) is."""
    born = gold["dim_patient"].select("patient_pseudo", "birth_year")
    stays = gold["fact_sejour"].select("patient_pseudo", "age_au_sejour", "tranche_age").join(born, "patient_pseudo")
    diagnoses = (
        gold["fact_diagnostic"]
        .select("patient_pseudo", "age_au_sejour", "tranche_age", "date_admission")
        .join(born, "patient_pseudo")
    )
    no_year = F.col("birth_year").isNull()
    no_age, no_band = F.col("age_au_sejour").isNull(), F.col("tranche_age") == UNKNOWN
    either = no_year | F.col("date_admission").isNull()
    return stacked(
        [
            violations(
                stays, {"fact_sejour : âge NULL": no_age != no_year, "fact_sejour : tranche inconnue": no_band != no_year}
            ),
            violations(
                diagnoses,
                {
                    "fact_diagnostic : âge NULL": no_age != either,
                    "fact_diagnostic : tranche inconnue": no_band != either,
                },
            ),
        ]
    )


# ---- indicators against facts ----------------------------------------------


def kpi_consistency(kpi: DataFrame, recomputed: DataFrame, keys: list[str], name: str, tolerance: float = 0.005):
    """A stored indicator against its recomputation: rows on each side, and values that differ.

    Both frames hold the keys, `mesure` and `effectif`.
    """
    a = kpi.select(*keys, F.col("mesure").cast("double").alias("_m1"), F.col("effectif").alias("_e1"), F.lit(1).alias("_in1"))
    b = recomputed.select(
        *keys, F.col("mesure").cast("double").alias("_m2"), F.col("effectif").alias("_e2"), F.lit(1).alias("_in2")
    )
    both = F.col("_in1").isNotNull() & F.col("_in2").isNotNull()
    apart = (F.abs(F.col("_m1") - F.col("_m2")) > tolerance) | ~F.col("_e1").eqNullSafe(F.col("_e2"))
    return a.join(b, keys, "full").agg(
        F.count("_in1").alias("lignes_kpi"),
        F.count("_in2").alias("lignes_faits"),
        F.count_if(both & F.coalesce(apart, F.lit(True))).alias("divergences"),
    ).select(F.lit(name).alias("table"), "lignes_kpi", "lignes_faits", "divergences")


def kpi_recomputations(gold: Tables) -> dict[str, tuple]:
    """Per indicator: its keys, the two columns to confront, and the plain recomputation."""
    stays, diagnoses, acts = gold["fact_sejour"], gold["fact_diagnostic"], gold["fact_acte"]
    closed = F.col("est_en_cours") == 0
    n = F.count(F.lit(1))
    services, codes = gold["dim_service"], gold["dim_ccam"]

    def by(df, keys, measure, size):
        return df.groupBy(*keys).agg(measure.alias("mesure"), size.alias("effectif"))

    month = stays.withColumn("mois", month_start(F.col("date_admission")))
    day = stays.withColumnRenamed("date_admission", "jour")
    homes = gold["dim_patient"].select("patient_pseudo", F.col("region").alias("region_code"))
    acts_count, stays_count = acts.groupBy("service_code").agg(n.alias("a")), stays.groupBy("service_code").agg(n.alias("s"))
    per_service = (
        services.select("service_code")
        .join(acts_count, "service_code", "left")
        .join(stays_count, "service_code", "left")
        .select("service_code", F.coalesce("a", F.lit(0)).alias("mesure"), F.coalesce("s", F.lit(0)).alias("effectif"))
    )
    equipped = acts.join(services.where(F.col("capacite_lits").isNotNull()), "service_code")
    priced = acts.join(codes, "code_ccam", "left")
    return {
        "kpi_dms_service": (
            ["service_code", "mois"], "dms_jours", "nb_sejours_clos",
            by(month.where(closed), ["service_code", "mois"], F.round(F.avg("duree_jours"), 2), n),
        ),
        "kpi_urgences_jour": (
            ["jour"], "nb_passages_urgences", "nb_sejours",
            by(day, ["jour"], F.count_if(F.col("service_code") == "URGENCES"), n),
        ),
        "kpi_readmission_service": (
            ["service_code"], "nb_readmis_30j_brut", "nb_sejours",
            by(stays, ["service_code"], F.sum("readmission_30j_brute"), n),
        ),
        "kpi_alertes_jour": (
            ["jour", "service_code"], "nb_en_alerte", "nb_releves",
            by(
                gold["fact_releve"].withColumnRenamed("date_mesure", "jour"), ["jour", "service_code"],
                F.count_if(F.col("en_alerte") == 1), n,
            ),
        ),
        "kpi_mortalite_service": (
            ["service_code"], "nb_deces", "nb_sejours_clos",
            by(stays.where(closed), ["service_code"], F.count_if(F.col("discharge_mode") == DEATH), n),
        ),
        "kpi_casemix_service": (
            ["service_code", "code_cim10"], "nb_sejours", "nb_sejours",
            by(diagnoses.where(F.col("est_principal") == 1), ["service_code", "code_cim10"], n, n),
        ),
        "kpi_origine_service": (
            ["service_code", "region_code"], "nb_patients", "nb_sejours",
            by(stays.join(homes, "patient_pseudo"), ["service_code", "region_code"], F.countDistinct("patient_pseudo"), n),
        ),
        "kpi_activite_categorie": (
            ["categorie"], "nb_sejours", "nb_sejours_clos",
            by(stays.join(services, "service_code"), ["categorie"], n, F.count_if(closed)),
        ),
        "kpi_actes_service": (["service_code"], "nb_actes", "nb_sejours", per_service),
        "kpi_actes_type": (
            ["code_ccam"], "nb_actes", "nb_sejours_concernes", by(acts, ["code_ccam"], n, F.countDistinct("stay_id")),
        ),
        "kpi_densite_actes_lit": (
            ["service_code"], "nb_actes", "capacite_lits", by(equipped, ["service_code"], n, F.max("capacite_lits")),
        ),
        "kpi_facturation_service": (
            ["service_code"], "nb_actes", "nb_actes_sans_tarif",
            by(priced, ["service_code"], n, F.count_if(F.col("tarif_euros").isNull())),
        ),
    }


def kpi_report(kpis: Tables, gold: Tables) -> DataFrame:
    frames = []
    for name, (keys, measure, size, recomputed) in kpi_recomputations(gold).items():
        stored = kpis[name].select(*keys, F.col(measure).alias("mesure"), F.col(size).alias("effectif"))
        frames.append(kpi_consistency(stored, recomputed, keys, name))
    return stacked(frames)


def kpi_invariants(kpis: Tables, gold: Tables, cohorts: Tables) -> DataFrame:
    """What must hold between indicators and facts, whatever the data."""
    stays, diagnoses, readings, acts = (
        gold[t] for t in ("fact_sejour", "fact_diagnostic", "fact_releve", "fact_acte")
    )
    closed = F.col("est_en_cours") == 0
    heart, oxygen, heat = (F.col(c) == 1 for c in ("alerte_fc", "alerte_spo2", "alerte_temp"))
    prevalence, cells = cohorts["coh_prevalence"], cohorts["coh_description"]
    horizon = stays.agg(F.max("date_admission")).scalar()
    undescribed = gold["dim_service"].where(F.col("categorie") == UNDESCRIBED).select("service_code")
    no_beds = gold["dim_service"].where(F.col("capacite_lits").isNull()).select("service_code")

    def shares(table, of, group=None):
        """Each share against its own quotient: rounded shares need not add up to 100."""
        whole = kpis[table].groupBy(*([group] if group else [])).agg(F.sum(of).alias("whole"))
        both = kpis[table].join(whole, group) if group else kpis[table].withColumn("whole", whole.scalar())
        off = F.abs(F.col("part_pct") - F.lit(100.0) * F.col(of) / F.col("whole")) > SHARE_ROUNDING
        return violations(both, {f"{table} : part = son quotient": F.coalesce(off, F.lit(True))})

    described = (
        cells.groupBy("code_cim10").agg(F.sum("nb_patients").alias("decrits"))
        .join(prevalence.select("code_cim10", "nb_patients"), "code_cim10", "left")
    )
    k = {name: kpis[name] for name in kpis}
    totals = {
        "kpi_dms_service : tous les séjours clos": (total(k["kpi_dms_service"], "nb_sejours_clos"), total(stays, where=closed)),
        "kpi_urgences_jour : somme des passages": (
            total(k["kpi_urgences_jour"], "nb_passages_urgences"), total(stays, where=F.col("service_code") == "URGENCES"),
        ),
        "kpi_urgences_jour : admissions en urgence": (
            total(k["kpi_urgences_jour"], "nb_admissions_en_urgence"), total(stays, "est_urgence"),
        ),
        "kpi_readmission_service : dénominateur ajusté": (
            total(k["kpi_readmission_service"], "nb_sejours_index"), total(stays, "est_sejour_index"),
        ),
        "kpi_readmission_service : numérateur ajusté": (
            total(k["kpi_readmission_service"], "nb_readmis_30j"), total(stays, "suivi_readmission_30j"),
        ),
        "kpi_occupation_jour : une admission par séjour": (total(k["kpi_occupation_jour"], "nb_admissions"), total(stays)),
        "kpi_occupation_jour : sorties dans la fenêtre": (
            total(k["kpi_occupation_jour"], "nb_sorties"), total(stays, where=closed & (F.col("date_sortie") <= horizon)),
        ),
        "kpi_mortalite_service : tous les séjours clos": (
            total(k["kpi_mortalite_service"], "nb_sejours_clos"), total(stays, where=closed),
        ),
        "kpi_casemix_service : tous les diagnostics principaux": (
            total(k["kpi_casemix_service"], "nb_sejours"), total(diagnoses, "est_principal"),
        ),
        "kpi_activite_categorie : tous les séjours": (total(k["kpi_activite_categorie"], "nb_sejours"), total(stays)),
        "kpi_activite_categorie : services non décrits": (
            total(k["kpi_activite_categorie"], "nb_sejours", F.col("categorie") == UNDESCRIBED),
            total(stays.join(undescribed, "service_code", "left_semi")),
        ),
        "kpi_actes_service : tous les actes": (total(k["kpi_actes_service"], "nb_actes"), total(acts)),
        "kpi_actes_service : séjours non gonflés": (total(k["kpi_actes_service"], "nb_sejours"), total(stays)),
        "kpi_actes_type : tous les actes": (total(k["kpi_actes_type"], "nb_actes"), total(acts)),
        "kpi_densite_actes_lit : écart = services sans capacité": (
            total(k["kpi_actes_service"].join(no_beds, "service_code", "left_semi"), "nb_actes"),
            total(acts.join(no_beds, "service_code", "left_semi")),
        ),
        "kpi_densite_actes_lit : sans capacité, sans ligne": (
            total(k["kpi_densite_actes_lit"].join(no_beds, "service_code", "left_semi")), 0,
        ),
        "kpi_facturation_service : tous les services": (
            total(k["kpi_facturation_service"]), total(acts.select("service_code").distinct()),
        ),
        "kpi_facturation_service : tous les actes": (total(k["kpi_facturation_service"], "nb_actes"), total(acts)),
        "kpi_facturation_service : montant": (
            total(k["kpi_facturation_service"], "montant_euros"),
            total(acts.groupBy("code_ccam").agg(F.count(F.lit(1)).alias("n")).join(gold["dim_ccam"], "code_ccam"),
                  F.col("tarif_euros") * F.col("n").cast("decimal(18,0)")),
        ),
        "coh_prevalence : codes au-dessus du seuil": (
            total(prevalence),
            total(
                diagnoses.groupBy("code_cim10", "patient_pseudo").agg(F.lit(1)).groupBy("code_cim10")
                .agg(F.count(F.lit(1)).alias("n")), where=F.col("n") >= SMALL_CELL,
            ),
        ),
    }
    return stacked(
        [
            equalities(stays.sparkSession, totals),
            violations(
                k["kpi_dms_service"],
                {
                    "kpi_dms_service : médiane <= P90 <= max": ~(
                        (F.col("mediane_jours") <= F.col("p90_jours")) & (F.col("p90_jours") <= F.col("max_jours"))
                    ),
                    "kpi_dms_service : heures = 24 x jours": F.abs(F.col("dms_heures") - F.col("dms_jours") * 24) > 0.2,
                },
            ),
            violations(
                stays,
                {
                    "fact_sejour : urgence = mode d'admission": (F.col("est_urgence") == 1)
                    != (F.col("admission_mode") == URGENT_MODE),
                    "fact_sejour : réadmission ajustée hors index": (F.col("suivi_readmission_30j") == 1)
                    & (F.col("est_sejour_index") == 0),
                    "fact_sejour : décès dans l'index": (F.col("est_sejour_index") == 1) & (F.col("discharge_mode") == DEATH),
                    "fact_sejour : en cours dans l'index": (F.col("est_sejour_index") == 1) & (F.col("est_en_cours") == 1),
                    "fact_sejour : clos sans durée": closed & F.col("duree_jours").isNull(),
                },
            ),
            violations(
                readings, {"fact_releve : alerte = réunion des motifs": (F.col("en_alerte") == 1) != (heart | oxygen | heat)}
            ),
            violations(
                k["kpi_occupation_jour"],
                {
                    "kpi_occupation_jour : présents >= admis": F.col("nb_presents") < F.col("nb_admissions"),
                    "kpi_occupation_jour : fenêtre": F.col("jour") > horizon,
                },
            ),
            shares("kpi_casemix_service", "nb_sejours", "service_code"),
            shares("kpi_origine_service", "nb_sejours", "service_code"),
            shares("kpi_actes_type", "nb_actes"),
            violations(
                k["kpi_origine_service"],
                {
                    "kpi_origine_service : patients <= séjours": F.col("nb_patients") > F.col("nb_sejours"),
                    "kpi_origine_service : région renseignée": is_blank(F.col("region_code")),
                },
            ),
            violations(
                k["kpi_actes_service"],
                {"kpi_actes_service : séjours avec acte <= séjours": F.col("nb_sejours_avec_acte") > F.col("nb_sejours")},
            ),
            violations(k["kpi_densite_actes_lit"], {"kpi_densite_actes_lit : aucune densité nulle": F.col("actes_par_lit") == 0}),
            violations(
                prevalence,
                {
                    "coh_prevalence : séjours >= patients": F.col("nb_sejours") < F.col("nb_patients"),
                    "coh_prevalence : principal <= tous": F.col("nb_patients_principal") > F.col("nb_patients"),
                },
            ),
            violations(
                cells,
                {
                    "coh_description : tranche résolue": F.col("tranche_age") == UNKNOWN,
                    "coh_description : sexe dans le domaine": ~F.col("sexe").isin(*SEX_DOMAIN, UNKNOWN),
                },
            ),
            violations(described, {"coh_description : hors prévalence": F.col("nb_patients").isNull()}),
        ]
    )


def conformity(observed: DataFrame, expected: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Published values, one by one. Both frames: indicateur, cle, valeur; nothing expected, nothing to say.

    A key that is expected and absent fails; `valeur` NULL in `expected` means the key must be absent.
    """
    seen = observed.select("indicateur", "cle", F.col("valeur").cast("double").alias("obtenu"))
    wanted = expected.select("indicateur", "cle", F.col("valeur").cast("double").alias("attendu"))
    near = F.abs(F.col("obtenu") - F.col("attendu")) <= tolerance
    absent = F.col("attendu").isNull() & F.col("obtenu").isNull()
    return wanted.join(seen, ["indicateur", "cle"], "left").withColumn(
        "ok", (F.coalesce(near, F.lit(False)) | absent).cast("int")
    )


# ---- privacy ---------------------------------------------------------------

# A word keeps the marks names, dates and numbers are written with.
_NOT_IN_A_WORD = r"[^\p{L}\p{N}_#/@.+-]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _NOT_IN_A_WORD), lambda word: word != "")


def phrases_of(text: Column, longest: int) -> Column:
    """All runs of 1 to `longest` words, each once."""
    words = words_of(text)

    def runs(n):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array())
        return F.transform(starts.cast("array<int>"), lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.concat(*[words if n == 1 else runs(n) for n in range(1, longest + 1)]))


def identity_leak(texts: DataFrame, identifiers: DataFrame, longest: int = 1) -> DataFrame:
    """Texts (origine, ligne, texte) in which a source identifier stands as a word or run of words.

    Whole texts are cut into words once and met with the identifiers in one
    equi-join, whatever the number of either.
    """
    wanted = identifiers.select(F.col("identifiant").alias("mot")).where(~is_blank(F.col("mot"))).distinct()
    found = texts.select("origine", "ligne", F.explode(phrases_of(F.col("texte"), longest)).alias("mot"))
    return (
        found.join(wanted, "mot", "left_semi")
        .groupBy("origine", "ligne")
        .agg(F.count(F.lit(1)).alias("nb_identifiants"))
    )


def grams_of(text: Column, q: int) -> Column:
    """All stretches of `q` characters of a text, each once. The pattern takes none and looks ahead, so it meets every place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


# Identifiers or stretches that a task holds at once: some 50 MB in memory.
_SENT = 500_000


def identity_inside(texts: DataFrame, identifiers: DataFrame, q: int = 5, sent: int = _SENT) -> DataFrame:
    """Texts (origine, ligne, texte) in which a source identifier stands anywhere, also inside a longer word.

    Each identifier is known by one stretch of `q` characters, the one that fewest
    texts hold. Texts with that stretch are candidates, and only those are searched
    for the identifier itself: no text meets all identifiers. An identifier of fewer than
    `q` characters, which would stand in any text, counts where it is a word.

    The stretches and then the identifiers are sent to the texts, at most about `sent` at a time, so that a
    candidate is searched where its text lies: neither texts nor candidates are shuffled, only what is found.
    """
    wanted = identifiers.select("identifiant").where(~is_blank(F.col("identifiant"))).distinct()
    long = wanted.where(F.length("identifiant") >= q)
    stretches = long.select("identifiant", F.explode(grams_of(F.col("identifiant"), q)).alias("bout"))
    most = max(long.count(), stretches.select("bout").distinct().count())
    parts = max(1, -(-most // sent))
    own = texts.where(F.col("texte").isNotNull()).select("origine", "ligne", "texte")
    # A text of fewer than `q` characters has no stretch, and holds no identifier that has one.
    roomy = own.where((F.length("texte") >= q) & F.col("origine").isNotNull() & F.col("ligne").isNotNull())
    cut = roomy.select("origine", "ligne", "texte", F.explode(grams_of(F.col("texte"), q)).alias("bout"))

    def inside(looked_for: DataFrame) -> DataFrame:
        counted = cut.select("bout").join(F.broadcast(looked_for.select("bout").distinct()), "bout", "left_semi").groupBy(
            "bout").agg(F.count(F.lit(1)).alias("nb"))
        # A stretch that no text holds is the rarest: its identifier stands nowhere.
        anchors = looked_for.join(counted, "bout", "left").groupBy("identifiant").agg(
            F.min(F.struct(F.coalesce("nb", F.lit(0)).alias("nb"), "bout")).alias("ancre")
        ).where(F.col("ancre.nb") > 0).select("identifiant", F.col("ancre.bout").alias("bout"))
        return cut.join(F.broadcast(anchors), "bout").where(F.contains("texte", "identifiant")).select(
            "origine", "ligne", "identifiant")

    part = F.pmod(F.xxhash64("identifiant"), F.lit(parts))
    found = [inside(stretches if parts == 1 else stretches.where(part == n)) for n in range(parts)]
    short = F.filter(words_of(F.col("texte")), lambda word: F.length(word) < q)
    words = own.select("origine", "ligne", F.explode(F.array_distinct(short)).alias("identifiant")).join(
        wanted.where(F.length("identifiant") < q), "identifiant", "left_semi").select("origine", "ligne", "identifiant")
    # Copies of a row hold the same identifiers, and what is found is told apart at the end.
    return stacked([*found, words]).distinct().groupBy("origine", "ligne").agg(F.count(F.lit(1)).alias("nb_identifiants"))


def table_texts(tables: Tables, origin: str = "_fichier_source") -> DataFrame:
    """All text columns of some tables, told by the file a row came from; provenance itself is left out."""
    parts = [
        string_cells(df.select(origin, *[c for c in df.columns if not c.startswith("_")]), name, origin)
        for name, df in tables.items()
    ]
    return stacked(parts)


def string_cells(df: DataFrame, origin: str, row_id: str) -> DataFrame:
    """Every text column of a table as (origine, ligne, texte), columnar files included."""
    texts = [c for c, kind in df.dtypes if kind == "string" and c != row_id]
    cells = [F.struct(F.lit(f"{origin}.{c}").alias("origine"), F.col(c).alias("texte")) for c in texts]
    return df.select(F.col(row_id).cast("string").alias("ligne"), F.inline(F.array(*cells))).where(
        F.col("texte").isNotNull()
    ).select("origine", "ligne", "texte")


def pseudo_collisions(pairs: DataFrame) -> DataFrame:
    """Pseudonyms shared by several identifiers. Input: identifiant, pseudo."""
    each = pairs.where(~is_blank(F.col("pseudo"))).groupBy("pseudo", "identifiant").agg(F.lit(1).alias("_one"))
    return each.groupBy("pseudo").agg(F.count(F.lit(1)).alias("nb_identifiants")).where(F.col("nb_identifiants") > 1)


def personal_data(texts: DataFrame, text: str = "texte") -> DataFrame:
    """Lines that carry a pseudonym, a patient number or a social-security number."""
    return texts.where(F.col(text).rlike(PERSONAL_DATA))


def column_audit(spark: SparkSession, schemas: dict[str, list[str]]) -> DataFrame:
    """Forbidden columns by table name `<layer>.<table>`; only offenders give rows."""
    found = []
    for table, columns in schemas.items():
        layer = table.split(".")[0]
        rules = [("identifiant direct", DIRECT_IDENTIFIERS)]
        if layer == "gold_recherche":
            rules.append(("minimisation recherche", RESEARCH_FORBIDDEN))
        if layer == "silver":
            rules.append(("réservé à gold", GOLD_ONLY))
        found += [(table, c, rule) for rule, names in rules for c in columns if c in names]
    return spark.createDataFrame(found, "table string, colonne string, regle string")


def cohort_min(cohorts: Tables) -> DataFrame:
    """Smallest cell of each cohort table."""
    frames = [
        df.agg(F.min("nb_patients").alias("plus_petite")).select(
            F.lit(name).alias("table"), "plus_petite",
            F.coalesce((F.col("plus_petite") >= SMALL_CELL).cast("int"), F.lit(1)).alias("ok"),
        )
        for name, df in cohorts.items()
    ]
    return stacked(frames)


def provenance_audit(df: DataFrame, table: str, required: list[str]) -> DataFrame:
    """Each provenance column: is it there, and on how many rows is it empty?"""
    present = [c for c in required if c in df.columns]
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(is_blank(F.col(c).cast("string"))).alias(f"v_{c}") for c in present],
    )
    lines = [
        F.struct(
            F.lit(table).alias("table"),
            F.lit(c).alias("colonne"),
            F.lit(int(c in present)).alias("presente"),
            (F.col(f"v_{c}") if c in present else F.col("n")).alias("vides"),
        )
        for c in required
    ]
    return counted.select(F.inline(F.array(*lines)))
