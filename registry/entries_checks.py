"""Checks on the built warehouse."""

from pyspark.sql import functions as F

from lamina.contract import BRONZE, PROVENANCE, REFERENCES
from lamina.operators import reconcile, suppression
from lamina.plans import publish, quality
from lamina.session import new_folder
from lamina.sources.warehouse import Warehouse
from registry import built
from registry.book import entry, shown
from registry.oracle_parts import rounded

entry(
    "conservation",
    """SELECT source, bronze, silver, ecartes, CAST(bronze = silver + ecartes AS INTEGER) AS ok
       FROM (SELECT 'sejours' AS source, (SELECT count(*) FROM bronze_sejours) AS bronze,
                    (SELECT count(*) FROM silver_sejours) AS silver
             UNION ALL SELECT 'diagnostics', (SELECT count(*) FROM bronze_diagnostics), (SELECT count(*) FROM silver_diagnostics)
             UNION ALL SELECT 'monitoring', (SELECT count(*) FROM bronze_monitoring), (SELECT count(*) FROM silver_monitoring)
             UNION ALL SELECT 'actes', (SELECT count(*) FROM bronze_actes), (SELECT count(*) FROM silver_actes))
       JOIN (SELECT source, sum(nb_lignes)::BIGINT AS ecartes FROM rejets WHERE action = 'ecarte' GROUP BY source)
       USING (source)""",
)(
    lambda f: quality.conservation(
        f.bronze, {s: t for s, t in built.silver(f).items() if s != "patients"}, built.register(f)
    )
)

entry(
    "snapshot_conservation",
    """SELECT 'patients identifiés = silver.patients' AS controle, (SELECT count(*) FROM silver_patients) AS observe,
              count(DISTINCT patient_pseudo) AS attendu,
              CAST((SELECT count(*) FROM silver_patients) = count(DISTINCT patient_pseudo) AS INTEGER) AS ok
       FROM bronze_patients WHERE patient_pseudo <> ''
       UNION ALL
       SELECT 'aucun doublon en silver.patients', count(*), count(DISTINCT patient_pseudo),
              CAST(count(*) = count(DISTINCT patient_pseudo) AS INTEGER) FROM silver_patients""",
)(lambda f: quality.snapshot_conservation(f.bronze_patients, built.silver(f)["patients"]))


def none_expected(*checks: tuple[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS controle, n AS observe, 0::BIGINT AS attendu, CAST(n = 0 AS INTEGER) AS ok"
        f" FROM (SELECT ({count})::BIGINT AS n)"
        for name, count in checks
    )


def both(*checks: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS controle, a AS observe, b AS attendu, CAST(a = b AS INTEGER) AS ok"
        f" FROM (SELECT ({observed})::BIGINT AS a, ({expected})::BIGINT AS b)"
        for name, observed, expected in checks
    )


entry(
    "rule_residuals",
    none_expected(
        ("silver.sejours : durée négative", "SELECT count(*) FROM silver_sejours WHERE duree_jours < 0"),
        (
            "silver.sejours : durée absente sans séjour en cours",
            "SELECT count(*) FROM silver_sejours WHERE (duree_jours IS NULL) <> (est_en_cours = 1)",
        ),
        ("silver.sejours : mode de sortie vide", "SELECT count(*) FROM silver_sejours WHERE discharge_mode = ''"),
        ("silver.sejours : pseudonyme vide", "SELECT count(*) FROM silver_sejours WHERE patient_pseudo = ''"),
        ("silver.sejours : service non résolu", "SELECT count(*) FROM silver_sejours WHERE service_label = 'inconnu'"),
        ("silver.patients : pseudonyme vide", "SELECT count(*) FROM silver_patients WHERE patient_pseudo = ''"),
        ("silver.patients : sexe hors domaine", "SELECT count(*) FROM silver_patients WHERE sex NOT IN ('M', 'F', 'inconnu')"),
        (
            "silver.patients : casse ou espace résiduel",
            "SELECT count(*) FROM silver_patients WHERE sex <> 'inconnu' AND sex <> upper(trim(sex))",
        ),
        (
            "silver.monitoring : mesure hors plage",
            "SELECT count(*) FROM silver_monitoring WHERE heart_rate NOT BETWEEN 20 AND 250 OR spo2 NOT BETWEEN 50 AND 100"
            " OR temp_c NOT BETWEEN 30 AND 45",
        ),
        (
            "silver.monitoring : hors fenêtre",
            "SELECT count(*) FROM silver_monitoring AS m JOIN silver_sejours AS s ON s.stay_id = m.stay_id"
            " WHERE m.ts < s.admission_ts OR m.ts > s.discharge_ts",
        ),
        ("silver.diagnostics : code non résolu", "SELECT count(*) FROM silver_diagnostics WHERE libelle = 'inconnu'"),
        ("silver.actes : code non résolu", "SELECT count(*) FROM silver_actes WHERE libelle = 'inconnu'"),
        ("registre : action inconnue", "SELECT count(*) FROM rejets WHERE action NOT IN ('ecarte', 'corrige')"),
        (
            "silver.sejours : date illisible conservée",
            "SELECT count(*) FROM bronze_sejours WHERE (admission_ts IS NULL OR _discharge_illisible = 1)"
            " AND stay_id IN (SELECT stay_id FROM silver_sejours)",
        ),
    ),
)(lambda f: quality.rule_residuals(f.bronze_sejours, built.silver(f), built.register(f)))

entry(
    "anomaly_counters",
    """SELECT count(*) FILTER (discharge_ts IS NULL) AS sejours_en_cours,
              count(*) FILTER (discharge_ts < admission_ts) AS incoherence_temporelle,
              count(*) FILTER (discharge_mode = '' AND discharge_ts IS NOT NULL) AS mode_sortie_absent
       FROM bronze_sejours""",
)(lambda f: quality.anomaly_counters(f.bronze_sejours))

# The register is read against a list that leaves out two motifs, so that some rows come back.
_PARTIAL = {
    "patients": ["patient_manquant", "sexe_non_normalise", "date_naissance_illisible"],
    "sejours": ["patient_manquant", "date_illisible", "incoherence_temporelle"],
    "diagnostics": ["sejour_ecarte", "sejour_inconnu"],
    "monitoring": ["capteur_hors_plage", "sejour_ecarte", "sejour_inconnu"],
    "actes": ["sejour_ecarte", "sejour_inconnu", "acte_hors_sejour"],
}
entry(
    "unknown_motifs",
    """SELECT source, motif, sum(nb_lignes)::BIGINT AS nb_lignes FROM rejets
       WHERE (source, motif) IN (('sejours', 'version_remplacee'), ('monitoring', 'releve_hors_sejour'))
       GROUP BY source, motif""",
)(lambda f: quality.unknown_motifs(built.register(f), _PARTIAL))


def orphans(fact: str, key: str, dim: str) -> tuple[str, str]:
    return (f"{fact}.{key} -> {dim}", f"SELECT count(*) FROM {fact} WHERE {key} NOT IN (SELECT {key} FROM {dim})")


entry(
    "integrity_report",
    none_expected(
        orphans("fact_sejour", "patient_pseudo", "dim_patient"),
        orphans("fact_sejour", "service_code", "dim_service"),
        orphans("fact_diagnostic", "patient_pseudo", "dim_patient"),
        orphans("fact_diagnostic", "code_cim10", "dim_cim10"),
        orphans("fact_diagnostic", "service_code", "dim_service"),
        orphans("fact_releve", "patient_pseudo", "dim_patient"),
        orphans("fact_releve", "service_code", "dim_service"),
        orphans("fact_acte", "code_ccam", "dim_ccam"),
        orphans("fact_acte", "service_code", "dim_service"),
        *[
            (f"{dim}.{key} unique", f"SELECT count(*) - count(DISTINCT {key}) FROM {dim}")
            for dim, key in (
                ("dim_patient", "patient_pseudo"), ("dim_service", "service_code"), ("dim_cim10", "code_cim10"),
                ("dim_ccam", "code_ccam"),
            )
        ],
    ),
)(lambda f: quality.integrity_report(built.gold(f)))

entry(
    "grain_check",
    """SELECT 'fact_sejour' AS fait, count(*) AS lignes, count(DISTINCT stay_id) AS cles FROM fact_sejour
       UNION ALL SELECT 'fact_diagnostic', count(*), count(DISTINCT (stay_id, code_cim10, type_diag)) FROM fact_diagnostic
       UNION ALL SELECT 'fact_releve', count(*), count(DISTINCT (stay_id, ts)) FROM fact_releve""",
)(lambda f: quality.grain_check(built.gold(f)))


def fidelity(feed: str) -> tuple[str, str]:
    return (
        f"silver.{feed} : attributs du séjour porteur",
        f"SELECT count(*) FROM silver_{feed} AS x JOIN retained_stays AS s ON s.stay_id = x.stay_id"
        " WHERE x.patient_pseudo <> s.patient_pseudo OR x.service_code <> s.service_code"
        " OR x.admission_ts IS DISTINCT FROM s.admission_ts",
    )


def flag_fidelity(feed: str) -> tuple[str, str]:
    return (
        f"silver.{feed} : sejour_coherent",
        f"SELECT count(*) FROM silver_{feed} AS x LEFT JOIN silver_sejours AS s ON s.stay_id = x.stay_id"
        " WHERE x.sejour_coherent <> CAST(s.stay_id IS NOT NULL AS INTEGER)",
    )


@entry("parent_fidelity", none_expected(*[c(t) for t in ("diagnostics", "monitoring", "actes") for c in (fidelity, flag_fidelity)]))
def parent_fidelity(f):
    tables, children = built.silver(f), ("diagnostics", "monitoring", "actes")
    retained = f.retained_stays
    frames = [quality.parent_fidelity(tables[c], retained, c) for c in children]
    return quality.stacked(frames + [quality.coherence_fidelity(tables[c], tables["sejours"], c) for c in children])


entry(
    "null_iff",
    none_expected(
        *[
            (
                f"{fact} : {label}",
                f"SELECT count(*) FROM {fact} JOIN dim_patient USING (patient_pseudo) WHERE ({side}) <> ({cause})",
            )
            for fact, cause in (
                ("fact_sejour", "birth_year IS NULL"),
                ("fact_diagnostic", "birth_year IS NULL OR date_admission IS NULL"),
            )
            for label, side in (("âge NULL", "age_au_sejour IS NULL"), ("tranche inconnue", "tranche_age = 'inconnu'"))
        ]
    ),
)(lambda f: quality.null_iff(built.gold(f)))


def confront(name: str, keys: str, measure: str, size: str, recomputed: str) -> str:
    return f"""SELECT '{name}' AS "table", (SELECT count(*) FROM {name}) AS lignes_kpi,
                      (SELECT count(*) FROM ({recomputed})) AS lignes_faits,
                      (SELECT count(*) FROM (SELECT {keys}, {measure} AS m1, {size} AS e1 FROM {name}) AS k
                       JOIN ({recomputed}) AS r USING ({keys}) WHERE abs(m1 - m2) > 0.005 OR e1 <> e2) AS divergences"""


entry(
    "kpi_consistency",
    " UNION ALL ".join(
        confront(*case)
        for case in (
            (
                "kpi_dms_service", "service_code, mois", "dms_jours", "nb_sejours_clos",
                "SELECT service_code, CAST(date_trunc('month', date_admission) AS DATE) AS mois,"
                " round(avg(duree_jours), 2) AS m2, count(*) AS e2 FROM fact_sejour WHERE est_en_cours = 0 GROUP BY ALL",
            ),
            (
                "kpi_urgences_jour", "jour", "nb_passages_urgences", "nb_sejours",
                "SELECT date_admission AS jour, count(*) FILTER (service_code = 'URGENCES') AS m2, count(*) AS e2"
                " FROM fact_sejour GROUP BY ALL",
            ),
            (
                "kpi_readmission_service", "service_code", "nb_readmis_30j_brut", "nb_sejours",
                "SELECT service_code, sum(readmission_30j_brute) AS m2, count(*) AS e2 FROM fact_sejour GROUP BY ALL",
            ),
            (
                "kpi_alertes_jour", "jour, service_code", "nb_en_alerte", "nb_releves",
                "SELECT date_mesure AS jour, service_code, sum(en_alerte) AS m2, count(*) AS e2 FROM fact_releve GROUP BY ALL",
            ),
            (
                "kpi_mortalite_service", "service_code", "nb_deces", "nb_sejours_clos",
                "SELECT service_code, count(*) FILTER (discharge_mode = 'deces') AS m2, count(*) AS e2"
                " FROM fact_sejour WHERE est_en_cours = 0 GROUP BY ALL",
            ),
            (
                "kpi_casemix_service", "service_code, code_cim10", "nb_sejours", "nb_sejours",
                "SELECT service_code, code_cim10, count(*) AS m2, count(*) AS e2 FROM fact_diagnostic"
                " WHERE est_principal = 1 GROUP BY ALL",
            ),
            (
                "kpi_origine_service", "service_code, region_code", "nb_patients", "nb_sejours",
                "SELECT service_code, region AS region_code, count(DISTINCT patient_pseudo) AS m2, count(*) AS e2"
                " FROM fact_sejour JOIN dim_patient USING (patient_pseudo) GROUP BY ALL",
            ),
            (
                "kpi_activite_categorie", "categorie", "nb_sejours", "nb_sejours_clos",
                "SELECT categorie, count(*) AS m2, count(*) FILTER (est_en_cours = 0) AS e2"
                " FROM fact_sejour JOIN dim_service USING (service_code) GROUP BY ALL",
            ),
            (
                "kpi_actes_service", "service_code", "nb_actes", "nb_sejours",
                "SELECT service_code, (SELECT count(*) FROM fact_acte AS a WHERE a.service_code = d.service_code) AS m2,"
                " (SELECT count(*) FROM fact_sejour AS s WHERE s.service_code = d.service_code) AS e2 FROM dim_service AS d",
            ),
            (
                "kpi_actes_type", "code_ccam", "nb_actes", "nb_sejours_concernes",
                "SELECT code_ccam, count(*) AS m2, count(DISTINCT stay_id) AS e2 FROM fact_acte GROUP BY ALL",
            ),
            (
                "kpi_densite_actes_lit", "service_code", "nb_actes", "capacite_lits",
                "SELECT service_code, count(*) AS m2, max(capacite_lits) AS e2 FROM fact_acte"
                " JOIN dim_service USING (service_code) WHERE capacite_lits IS NOT NULL GROUP BY ALL",
            ),
            (
                "kpi_facturation_service", "service_code", "nb_actes", "nb_actes_sans_tarif",
                "SELECT service_code, count(*) AS m2, count(*) FILTER (tarif_euros IS NULL) AS e2 FROM fact_acte"
                " LEFT JOIN dim_ccam USING (code_ccam) GROUP BY ALL",
            ),
        )
    ),
)(lambda f: quality.kpi_report(built.kpis(f), built.gold(f)))

_HORIZON = "(SELECT max(date_admission) FROM fact_sejour)"
_NO_BEDS = "(SELECT service_code FROM dim_service WHERE capacite_lits IS NULL)"


def share_terms(table: str, of: str, group: str = "") -> tuple[str, str]:
    over = f"PARTITION BY {group}" if group else ""
    return (
        f"{table} : part = son quotient",
        f"SELECT count(*) FROM (SELECT abs(part_pct - 100.0::DOUBLE * {of} / sum({of}) OVER ({over})) AS ecart FROM {table}) "
        "WHERE ecart > 0.005 + 1e-9 OR ecart IS NULL",
    )


entry(
    "kpi_invariants",
    both(
        ("kpi_dms_service : tous les séjours clos", "SELECT sum(nb_sejours_clos) FROM kpi_dms_service", "SELECT count(*) FROM fact_sejour WHERE est_en_cours = 0"),
        ("kpi_urgences_jour : somme des passages", "SELECT sum(nb_passages_urgences) FROM kpi_urgences_jour", "SELECT count(*) FROM fact_sejour WHERE service_code = 'URGENCES'"),
        ("kpi_urgences_jour : admissions en urgence", "SELECT sum(nb_admissions_en_urgence) FROM kpi_urgences_jour", "SELECT sum(est_urgence) FROM fact_sejour"),
        ("kpi_readmission_service : dénominateur ajusté", "SELECT sum(nb_sejours_index) FROM kpi_readmission_service", "SELECT sum(est_sejour_index) FROM fact_sejour"),
        ("kpi_readmission_service : numérateur ajusté", "SELECT sum(nb_readmis_30j) FROM kpi_readmission_service", "SELECT sum(suivi_readmission_30j) FROM fact_sejour"),
        ("kpi_occupation_jour : une admission par séjour", "SELECT sum(nb_admissions) FROM kpi_occupation_jour", "SELECT count(*) FROM fact_sejour"),
        ("kpi_occupation_jour : sorties dans la fenêtre", "SELECT sum(nb_sorties) FROM kpi_occupation_jour", f"SELECT count(*) FROM fact_sejour WHERE est_en_cours = 0 AND date_sortie <= {_HORIZON}"),
        ("kpi_mortalite_service : tous les séjours clos", "SELECT sum(nb_sejours_clos) FROM kpi_mortalite_service", "SELECT count(*) FROM fact_sejour WHERE est_en_cours = 0"),
        ("kpi_casemix_service : tous les diagnostics principaux", "SELECT sum(nb_sejours) FROM kpi_casemix_service", "SELECT sum(est_principal) FROM fact_diagnostic"),
        ("kpi_activite_categorie : tous les séjours", "SELECT sum(nb_sejours) FROM kpi_activite_categorie", "SELECT count(*) FROM fact_sejour"),
        ("kpi_activite_categorie : services non décrits", "SELECT sum(nb_sejours) FROM kpi_activite_categorie WHERE categorie = 'non renseigné'", "SELECT count(*) FROM fact_sejour WHERE service_code IN (SELECT service_code FROM dim_service WHERE categorie = 'non renseigné')"),
        ("kpi_actes_service : tous les actes", "SELECT sum(nb_actes) FROM kpi_actes_service", "SELECT count(*) FROM fact_acte"),
        ("kpi_actes_service : séjours non gonflés", "SELECT sum(nb_sejours) FROM kpi_actes_service", "SELECT count(*) FROM fact_sejour"),
        ("kpi_actes_type : tous les actes", "SELECT sum(nb_actes) FROM kpi_actes_type", "SELECT count(*) FROM fact_acte"),
        ("kpi_densite_actes_lit : écart = services sans capacité", f"SELECT sum(nb_actes) FROM kpi_actes_service WHERE service_code IN {_NO_BEDS}", f"SELECT count(*) FROM fact_acte WHERE service_code IN {_NO_BEDS}"),
        ("kpi_densite_actes_lit : sans capacité, sans ligne", f"SELECT count(*) FROM kpi_densite_actes_lit WHERE service_code IN {_NO_BEDS}", "0"),
        ("kpi_facturation_service : tous les services", "SELECT count(*) FROM kpi_facturation_service", "SELECT count(DISTINCT service_code) FROM fact_acte"),
        ("kpi_facturation_service : tous les actes", "SELECT sum(nb_actes) FROM kpi_facturation_service", "SELECT count(*) FROM fact_acte"),
        ("kpi_facturation_service : montant", "SELECT trunc(sum(montant_euros)) FROM kpi_facturation_service", "SELECT trunc(sum(tarif_euros)) FROM fact_acte JOIN dim_ccam USING (code_ccam)"),
        ("coh_prevalence : codes au-dessus du seuil", "SELECT count(*) FROM coh_prevalence", "SELECT count(*) FROM (SELECT code_cim10 FROM fact_diagnostic GROUP BY 1 HAVING count(DISTINCT patient_pseudo) >= 5)"),
    )
    + " UNION ALL "
    + none_expected(
        ("kpi_dms_service : médiane <= P90 <= max", "SELECT count(*) FROM kpi_dms_service WHERE mediane_jours > p90_jours OR p90_jours > max_jours"),
        ("kpi_dms_service : heures = 24 x jours", "SELECT count(*) FROM kpi_dms_service WHERE abs(dms_heures - dms_jours * 24) > 0.2"),
        ("fact_sejour : urgence = mode d''admission", "SELECT count(*) FROM fact_sejour WHERE (est_urgence = 1) <> (admission_mode = 'urgence')"),
        ("fact_sejour : réadmission ajustée hors index", "SELECT count(*) FROM fact_sejour WHERE suivi_readmission_30j > est_sejour_index"),
        ("fact_sejour : décès dans l''index", "SELECT count(*) FROM fact_sejour WHERE est_sejour_index = 1 AND discharge_mode = 'deces'"),
        ("fact_sejour : en cours dans l''index", "SELECT count(*) FROM fact_sejour WHERE est_sejour_index = 1 AND est_en_cours = 1"),
        ("fact_sejour : clos sans durée", "SELECT count(*) FROM fact_sejour WHERE est_en_cours = 0 AND duree_jours IS NULL"),
        ("fact_releve : alerte = réunion des motifs", "SELECT count(*) FROM fact_releve WHERE en_alerte <> greatest(alerte_fc, alerte_spo2, alerte_temp)"),
        ("kpi_occupation_jour : présents >= admis", "SELECT count(*) FROM kpi_occupation_jour WHERE nb_presents < nb_admissions"),
        ("kpi_occupation_jour : fenêtre", f"SELECT count(*) FROM kpi_occupation_jour WHERE jour > {_HORIZON}"),
        share_terms("kpi_casemix_service", "nb_sejours", "service_code"),
        share_terms("kpi_origine_service", "nb_sejours", "service_code"),
        share_terms("kpi_actes_type", "nb_actes"),
        ("kpi_origine_service : patients <= séjours", "SELECT count(*) FROM kpi_origine_service WHERE nb_patients > nb_sejours"),
        ("kpi_origine_service : région renseignée", "SELECT count(*) FROM kpi_origine_service WHERE region_code = ''"),
        ("kpi_actes_service : séjours avec acte <= séjours", "SELECT count(*) FROM kpi_actes_service WHERE nb_sejours_avec_acte > nb_sejours"),
        ("kpi_densite_actes_lit : aucune densité nulle", "SELECT count(*) FROM kpi_densite_actes_lit WHERE actes_par_lit = 0"),
        ("coh_prevalence : séjours >= patients", "SELECT count(*) FROM coh_prevalence WHERE nb_sejours < nb_patients"),
        ("coh_prevalence : principal <= tous", "SELECT count(*) FROM coh_prevalence WHERE nb_patients_principal > nb_patients"),
        ("coh_description : tranche résolue", "SELECT count(*) FROM coh_description WHERE tranche_age = 'inconnu'"),
        ("coh_description : sexe dans le domaine", "SELECT count(*) FROM coh_description WHERE sexe NOT IN ('M', 'F', 'inconnu')"),
        ("coh_description : hors prévalence", "SELECT count(DISTINCT code_cim10) FROM coh_description WHERE code_cim10 NOT IN (SELECT code_cim10 FROM coh_prevalence)"),
    ),
)(lambda f: quality.kpi_invariants(built.kpis(f), built.gold(f), built.cohorts(f)))


@entry(
    "conformity",
    f"""SELECT 'dms_jours' AS indicateur, cle, attendu, obtenu, CAST(coalesce(abs(obtenu - attendu) <= 0.1, FALSE) AS INTEGER) AS ok
        FROM (SELECT service_code AS cle, {rounded("avg(duree_jours)", 1)} AS attendu FROM fact_sejour
              WHERE est_en_cours = 0 GROUP BY ALL)
        LEFT JOIN (SELECT service_code AS cle, {rounded("sum(dms_jours * nb_sejours_clos) / sum(nb_sejours_clos)")} AS obtenu
                   FROM kpi_dms_service GROUP BY ALL) USING (cle)""",
)
def conformity(f):
    """Stored means against values worked out from the facts; a missing service fails."""
    expected = (
        built.gold(f)["fact_sejour"].where("est_en_cours = 0").groupBy(F.col("service_code").alias("cle"))
        .agg(F.round(F.avg("duree_jours"), 1).alias("valeur")).withColumn("indicateur", F.lit("dms_jours"))
    )
    weighted = F.sum(F.col("dms_jours") * F.col("nb_sejours_clos")) / F.sum("nb_sejours_clos")
    observed = (
        built.kpis(f)["kpi_dms_service"].groupBy(F.col("service_code").alias("cle"))
        .agg(F.round(weighted, 2).alias("valeur")).withColumn("indicateur", F.lit("dms_jours"))
    )
    return quality.conformity(observed, expected)


entry(
    "cohort_min",
    """SELECT 'coh_prevalence' AS "table", min(nb_patients) AS plus_petite, CAST(min(nb_patients) >= 5 AS INTEGER) AS ok FROM coh_prevalence
       UNION ALL SELECT 'coh_description', min(nb_patients), CAST(min(nb_patients) >= 5 AS INTEGER) FROM coh_description""",
)(lambda f: quality.cohort_min(built.cohorts(f)))


@entry(
    "provenance_audit",
    " UNION ALL ".join(
        f"""SELECT '{label}' AS "table", colonne, 1 AS presente, 0::BIGINT AS vides
            FROM (SELECT unnest({columns}) AS colonne), (SELECT count(*) AS n FROM {part}) WHERE n > 0"""
        for label, part, columns in (
            *[(f"bronze.{feed}", f"bronze_{feed}", PROVENANCE["bronze"]) for feed in BRONZE],
            *[(f"bronze.{ref}", ref, PROVENANCE["references"]) for ref in REFERENCES],
            ("silver.sejours", "silver_sejours", PROVENANCE["silver"]),
            ("silver.diagnostics", "silver_diagnostics", PROVENANCE["silver"]),
            ("silver.monitoring", "silver_monitoring", PROVENANCE["silver"]),
            ("silver.actes", "silver_actes", PROVENANCE["silver"]),
            ("silver.patients", "silver_patients", PROVENANCE["silver.patients"]),
            ("quarantaine.rejets", "rejets", PROVENANCE["quarantaine"]),
        )
    ),
)
def provenance_audit(f):
    """Every written table of the layers that carry provenance."""
    tables, home = built.silver(f), built.warehouse(f)
    frames = [quality.provenance_audit(home.read("bronze", feed), f"bronze.{feed}", PROVENANCE["bronze"]) for feed in BRONZE]
    frames += [
        quality.provenance_audit(home.read("bronze", ref), f"bronze.{ref}", PROVENANCE["references"]) for ref in REFERENCES
    ]
    for feed in ("sejours", "diagnostics", "monitoring", "actes"):
        frames.append(quality.provenance_audit(tables[feed], f"silver.{feed}", PROVENANCE["silver"]))
    frames.append(quality.provenance_audit(tables["patients"], "silver.patients", PROVENANCE["silver.patients"]))
    frames.append(quality.provenance_audit(built.register(f), "quarantaine.rejets", PROVENANCE["quarantaine"]))
    return quality.stacked(frames)


_PERSONAL = r"(^|[^0-9A-Za-z_])([0-9a-f]{16}|[0-9]{15})($|[^0-9A-Za-z_])|IPP[0-9]{7}"


@entry(
    "pii_scan",
    f"""SELECT 'documents' AS origine, CAST(doc_id AS VARCHAR) AS ligne FROM documents WHERE regexp_matches(text, '{_PERSONAL}')
        UNION ALL
        SELECT 'conversations', conv_id || '/' || turn FROM conversations WHERE regexp_matches(text, '{_PERSONAL}')
        UNION ALL
        SELECT 'ops.executions', 'r' || o_orderkey || '/silver' FROM (
          SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'IPP' || lpad(o_custkey::VARCHAR, 7, '0')
                                  WHEN 1 THEN 'x' || lpad(o_custkey::VARCHAR, 15, '1') || 'y'
                                  WHEN 2 THEN '(' || lpad(o_custkey::VARCHAR, 15, '1') || ')' ELSE o_orderpriority END AS message FROM orders)
        WHERE regexp_matches('échec : ' || message, '{_PERSONAL}')""",
)
def pii_scan(f):
    """Documents, conversations and the messages of a ledger of failed steps, one for each order."""
    home = Warehouse(f.spark, new_folder(f.spark, "ledger"))
    home.append("ops", "executions", f.table("orders").selectExpr(
        "concat('r', o_orderkey) AS run_id", "'silver' AS etape", "to_date(o_orderdate) AS jour", "'echec' AS statut",
        "0L AS lignes", "0D AS duree_s", """concat('échec : ', CASE o_orderkey % 4
            WHEN 0 THEN concat('IPP', lpad(o_custkey, 7, '0')) WHEN 1 THEN concat('x', lpad(o_custkey, 15, '1'), 'y')
            WHEN 2 THEN concat('(', lpad(o_custkey, 15, '1'), ')') ELSE o_orderpriority END) AS message""",
        "cast(o_orderdate AS timestamp) AS demarre_a", "cast(o_orderdate AS timestamp) AS termine_a"))
    texts = (
        f.table("documents").selectExpr("'documents' AS origine", "cast(doc_id AS string) AS ligne", "text AS texte")
        .unionByName(
            f.table("conversations").selectExpr("'conversations' AS origine", "concat(conv_id, '/', turn) AS ligne", "text AS texte")
        )
        .unionByName(publish.ledger_texts(home))
    )
    return quality.personal_data(texts).select("origine", "ligne")


_WORD = r"[^\p{L}\p{N}_#/@.+-]+"


@entry(
    "identity_leak",
    f"""SELECT origine, ligne, count(*) AS nb_identifiants
        FROM (SELECT DISTINCT 'documents' AS origine, CAST(doc_id AS VARCHAR) AS ligne,
                     unnest(string_split_regex(text, '{_WORD}')) AS mot FROM documents
              UNION ALL
              SELECT DISTINCT 'customer.c_name', CAST(c_custkey AS VARCHAR), c_name FROM customer)
        WHERE mot <> '' AND mot IN (
            SELECT unnest(string_split_regex(text, '{_WORD}')) FROM benchmark
            UNION ALL SELECT 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier)
        GROUP BY ALL""",
)
def identity_leak(f):
    """Words of the benchmark texts and some customer names, looked for in text columns."""
    identifiers = f.table("benchmark").select(F.explode(quality.words_of(F.col("text"))).alias("identifiant")).unionByName(
        f.table("supplier").selectExpr("concat('Customer#', lpad(s_suppkey, 9, '0')) AS identifiant")
    )
    documents = f.table("documents").selectExpr("'documents' AS origine", "cast(doc_id AS string) AS ligne", "text AS texte")
    customers = quality.string_cells(f.table("customer").select("c_custkey", "c_name"), "customer", "c_custkey")
    return quality.identity_leak(documents.unionByName(customers), identifiers)


# Every text column of the tables, and what names a row.
_CELLS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "supplier": ("s_suppkey", "s_name"),
    "customer": ("c_custkey", "c_name", "c_mktsegment"), "part": ("p_partkey", "p_name", "p_brand", "p_type"),
    "orders": ("o_orderkey", "o_orderstatus", "o_orderpriority"), "events": ("event_id", "event_type", "props"),
    "documents": ("doc_id", "text", "lang", "source"), "pages": ("page_id", "url", "html"),
    "conversations": ("conv_id || '/' || turn", "role", "text"),
    "lineitem": ("l_orderkey || '/' || l_linenumber", "l_returnflag", "l_linestatus"),
}


@entry(
    "identity_inside",
    "WITH cells AS (" + " UNION ALL ".join(
        f"SELECT '{table}.{c}' AS origine, CAST({row} AS VARCHAR) AS ligne, {c} AS texte FROM {table}"
        for table, (row, *columns) in _CELLS.items() for c in columns
    ) + f"""), names AS (
      SELECT DISTINCT identifiant FROM (
        SELECT unnest(string_split_regex(text, '{_WORD}')) AS identifiant FROM benchmark
        UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier)
      WHERE length(identifiant) >= 5
    ), texts AS (SELECT DISTINCT * FROM cells)
    SELECT origine, ligne, count(DISTINCT identifiant) AS nb_identifiants
    FROM texts JOIN names ON contains(texte, identifiant) GROUP BY ALL""",
)
def identity_inside(f):
    """Words of the benchmark texts and numbers of suppliers, wherever they stand in any text column of any table."""
    identifiers = f.table("benchmark").select(F.explode(quality.words_of(F.col("text"))).alias("identifiant")).unionByName(
        f.table("supplier").selectExpr("lpad(s_suppkey, 9, '0') AS identifiant")
    ).where(F.length("identifiant") >= 5)
    texts = quality.stacked([
        quality.string_cells(f.table(table).selectExpr(f"cast({row} AS string) AS _ligne", *columns), table, "_ligne")
        for table, (row, *columns) in _CELLS.items()
    ])
    return quality.identity_inside(texts, identifiers)


_SIDES = """
    WITH gauche AS (SELECT o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS centimes FROM orders),
    droite AS (
      SELECT o_orderkey, o_orderstatus, centimes + CASE WHEN o_orderkey % 1009 = 5 THEN 1 ELSE 0 END AS centimes
      FROM gauche WHERE o_orderkey % 2003 <> 9
      UNION ALL SELECT * FROM gauche WHERE o_orderkey % 3001 = 11)"""


@entry(
    "reconcile_rows",
    _SIDES + """
    SELECT o_orderkey, o_orderstatus, centimes, CAST(sum(n) AS BIGINT) AS _n
    FROM (SELECT *, -1 AS n FROM gauche UNION ALL SELECT *, 1 FROM droite) GROUP BY ALL HAVING sum(n) <> 0""",
)
def reconcile_rows(f):
    """Orders against a copy in which some are altered, lost or there twice: which rows differ."""
    left = f.table("orders").selectExpr("o_orderkey", "o_orderstatus", "cast(round(o_totalprice * 100) AS bigint) AS centimes")
    altered = left.where("o_orderkey % 2003 <> 9").withColumn(
        "centimes", F.col("centimes") + F.expr("if(o_orderkey % 1009 = 5, 1, 0)"))
    right = altered.unionByName(left.where("o_orderkey % 3001 = 11"))
    return reconcile.differences(left, right, ["o_orderkey"], ["o_orderstatus", "centimes"])


_CELL = ["code_cim10", "tranche_age", "sexe"]
_MARGINS = [["code_cim10", "tranche_age"], ["code_cim10", "sexe"], ["code_cim10"], ["tranche_age", "sexe"]]
_K = 25


def _telling(margin):
    """SQL of the held-back cells whose line in one margin tells."""
    keys = ", ".join(margin)
    return f"""SELECT c.* FROM cells c JOIN (
        SELECT {keys} FROM cells WHERE nb < {_K} GROUP BY {keys} HAVING count(*) = 1 OR sum(nb) < {_K}) m USING ({keys})
      WHERE nb < {_K}"""


@entry(
    "cohort_recoverable",
    """SELECT * FROM (WITH cells AS (
      SELECT code_cim10, tranche_age, sexe, count(DISTINCT patient_pseudo) AS nb FROM fact_diagnostic
      WHERE est_principal = 1 AND tranche_age <> 'inconnu' GROUP BY ALL)
    SELECT code_cim10, tranche_age, sexe, nb, count(*) AS nb_lignes FROM ("""
    + " UNION ALL ".join(f"SELECT code_cim10, tranche_age, sexe, nb FROM ({_telling(m)})" for m in _MARGINS)
    + ") GROUP BY ALL)",
)
def cohort_recoverable(f):
    """Cells of fewer than 25 patients that follow by subtraction from totals by pathology, by age and by sex."""
    persons = f.fact_diagnostic.where((F.col("est_principal") == 1) & (F.col("tranche_age") != "inconnu"))
    cells = persons.groupBy(*_CELL, "patient_pseudo").agg(F.lit(1).alias("_un")).groupBy(*_CELL).agg(
        F.count(F.lit(1)).alias("nb"))
    return suppression.recoverable(suppression.small_cells(cells, "nb", _K), _CELL, _MARGINS, "nb", _K)


@entry(
    "pseudo_collisions",
    """SELECT substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 2) AS pseudo, count(*) AS nb_identifiants
       FROM (SELECT DISTINCT c_custkey FROM customer) GROUP BY pseudo HAVING count(*) > 1""",
)
def pseudo_collisions(f):
    """Pseudonyms cut to two digits, so that collisions exist."""
    pairs = f.table("customer").select(
        F.col("c_custkey").alias("identifiant"), F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 2).alias("pseudo")
    )
    return quality.pseudo_collisions(pairs)


entry("reject_register", shown("rejets", dates=("_jour_depot",)))(
    lambda f: built.register(f).drop("_run_id", "_rejected_at")
)
