"""Fixed values of the data contract: feeds, table schemas, domains, motifs, thresholds.

Everything here is a declaration. Table and column names are the public
vocabulary of the warehouse, so queries written against it keep working.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- Feeds and whitelists (fixed values) ----------------------------------

# Columns allowed into the lake, per feed and file, after pseudonymisation.
LAKE_COLUMNS = {
    ("patients", "patients.csv"): ["patient_pseudo", "birth_year", "sex", "region_code"],
    ("sejours", "sejours.csv"): [
        "stay_id", "patient_pseudo", "service_code", "admission_ts",
        "discharge_ts", "admission_mode", "discharge_mode",
    ],
    ("diagnostics", "diagnostics.json"): ["stay_id", "diagnostics"],
    ("monitoring", "monitoring.parquet"): ["stay_id", "ts", "heart_rate", "spo2", "temp_c"],
    ("actes", "actes.parquet"): ["stay_id", "code_ccam", "acte_ts"],
    ("referentiels", "services.csv"): ["service_code", "service_label"],
    ("referentiels", "cim10.csv"): ["code_cim10", "libelle"],
    ("referentiels", "ccam.csv"): ["code_ccam", "libelle", "tarif_euros"],
    ("referentiels", "description_service.csv"): [
        "service_code", "categorie", "capacite_lits", "pole",
    ],
}

# Keys allowed inside the elements of a nested column.
NESTED_COLUMNS = {"diagnostics": ["code_cim10", "type"]}

# Schema of the nested feed as read: declared, never inferred.
DIAGNOSTICS_JSON = "stay_id string, diagnostics array<struct<code_cim10:string,type:string>>"

DAILY_FEEDS = {
    "patients": "patients.csv",
    "sejours": "sejours.csv",
    "diagnostics": "diagnostics.json",
    "monitoring": "monitoring.parquet",
    "actes": "actes.parquet",
}

REFERENCE_FILES = {
    "ref_services": "services.csv",
    "ref_cim10": "cim10.csv",
    "ref_ccam": "ccam.csv",
    "ref_description_service": "description_service.csv",
}

# ---- Table schemas ---------------------------------------------------------

TECHNICAL = "_jour_depot date, _fichier_source string, _ingested_at timestamp, _run_id string"

BRONZE = {
    "patients": "patient_pseudo string, birth_year int, sex string, region_code string, " + TECHNICAL,
    "sejours": (
        "stay_id string, patient_pseudo string, service_code string, admission_ts timestamp_ntz, "
        "discharge_ts timestamp_ntz, _discharge_illisible int, admission_mode string, "
        "discharge_mode string, " + TECHNICAL
    ),
    "diagnostics": "stay_id string, code_cim10 string, type_diag string, " + TECHNICAL,
    "monitoring": (
        "stay_id string, ts timestamp_ntz, heart_rate int, spo2 int, temp_c decimal(4,1), " + TECHNICAL
    ),
    "actes": "stay_id string, code_ccam string, acte_ts timestamp_ntz, " + TECHNICAL,
}

REFERENCE_TECHNICAL = "_fichier_source string, _ingested_at timestamp, _run_id string"

REFERENCES = {
    "ref_services": "service_code string, service_label string, " + REFERENCE_TECHNICAL,
    "ref_cim10": "code_cim10 string, libelle string, " + REFERENCE_TECHNICAL,
    "ref_ccam": "code_ccam string, libelle string, tarif_euros decimal(10,2), " + REFERENCE_TECHNICAL,
    "ref_description_service": (
        "service_code string, categorie string, capacite_lits int, pole string, " + REFERENCE_TECHNICAL
    ),
}

REJECTS = (
    "source string, cle string, motif string, action string, detail string, nb_lignes bigint, "
    "_jour_depot date, _fichier_source string"
)

LEDGER = (
    "run_id string, etape string, jour date, statut string, lignes bigint, duree_s double, "
    "message string, demarre_a timestamp, termine_a timestamp"
)

# ---- Domains and rules (fixed values) --------------------------------------

SEX_DOMAIN = ["M", "F"]
UNKNOWN = "inconnu"
UNDESCRIBED = "non renseigné"
DEATH = "deces"
URGENT_MODE = "urgence"
EMERGENCY_SERVICE = "URGENCES"
PRINCIPAL = "principal"
NO_DATE_SENTINEL = "1970-01-01"

# Physiological validity: a reading outside any of these is a sensor fault.
PLAUSIBLE = {"heart_rate": (20, 250), "spo2": (50, 100), "temp_c": (30, 45)}

READMISSION_DAYS = 30
SMALL_CELL = 5
PSEUDONYM_LENGTH = 16

DISCARDED, CORRECTED = "ecarte", "corrige"
KEPT = "retenu"

# Motifs each source may record. `version_remplacee` is ours: an older delivery
# of a stay that a later one replaces.
MOTIFS = {
    "patients": ["patient_manquant", "sexe_non_normalise", "date_naissance_illisible"],
    "sejours": ["patient_manquant", "date_illisible", "incoherence_temporelle", "version_remplacee"],
    "diagnostics": ["sejour_ecarte", "sejour_inconnu"],
    "monitoring": ["capteur_hors_plage", "sejour_ecarte", "sejour_inconnu", "releve_hors_sejour"],
    "actes": ["sejour_ecarte", "sejour_inconnu", "acte_hors_sejour"],
}

# Pseudonyms, patient numbers and social-security numbers, as they would show
# up in a log line. Word borders are spelled out (ASCII) so that every regex
# engine reads them the same way.
PERSONAL_DATA = (
    r"(^|[^0-9A-Za-z_])([0-9a-f]{16}|[0-9]{15})($|[^0-9A-Za-z_])|IPP[0-9]{7}"
)

DIRECT_IDENTIFIERS = ["nir", "nom", "prenom", "birth_date", "patient_id"]
RESEARCH_FORBIDDEN = ["birth_year", "patient_pseudo", "region"]
STEERING_FORBIDDEN = ["patient_pseudo", "stay_id", "age_au_sejour"]
GOLD_ONLY = ["age_au_sejour", "alerte_fc", "alerte_spo2", "alerte_temp", "en_alerte"]

PROVENANCE = {
    "bronze": ["_jour_depot", "_fichier_source", "_ingested_at", "_run_id"],
    "references": ["_fichier_source", "_ingested_at", "_run_id"],
    "silver": ["_jour_depot", "_fichier_source", "_built_at", "_run_id"],
    "silver.patients": ["_jour_depot_retenu", "_fichier_source_retenu", "_built_at", "_run_id"],
    "quarantaine": ["_jour_depot", "_fichier_source", "_rejected_at", "_run_id"],
}


@dataclass(frozen=True)
class AlertThresholds:
    """Clinical alert limits. Operating parameters, unlike the validity ranges above."""

    fc_basse: float = 50.0
    fc_haute: float = 100.0
    spo2_basse: float = 92.0
    temp_haute: float = 38.5

    def __post_init__(self):
        for name, value in vars(self).items():
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
                raise ValueError(f"alert threshold {name} must be a number, got {value!r}")


# ---- Gold tables (fixed values) --------------------------------------------

DIMENSIONS = {
    "dim_patient": "patient_pseudo",
    "dim_service": "service_code",
    "dim_cim10": "code_cim10",
    "dim_ccam": "code_ccam",
}

FOREIGN_KEYS = [
    ("fact_sejour", "patient_pseudo", "dim_patient"),
    ("fact_sejour", "service_code", "dim_service"),
    ("fact_diagnostic", "patient_pseudo", "dim_patient"),
    ("fact_diagnostic", "code_cim10", "dim_cim10"),
    ("fact_diagnostic", "service_code", "dim_service"),
    ("fact_releve", "patient_pseudo", "dim_patient"),
    ("fact_releve", "service_code", "dim_service"),
    ("fact_acte", "code_ccam", "dim_ccam"),
    ("fact_acte", "service_code", "dim_service"),
]

KPI_TABLES = [
    "kpi_dms_service", "kpi_urgences_jour", "kpi_readmission_service", "kpi_alertes_jour",
    "kpi_occupation_jour", "kpi_mortalite_service", "kpi_casemix_service", "kpi_origine_service",
    "kpi_activite_categorie", "kpi_actes_service", "kpi_actes_type", "kpi_densite_actes_lit",
    "kpi_facturation_service",
]

# ---- Audiences: which table and columns each may see (fixed values) --------

ALL_COLUMNS = None

AUDIENCES = {
    "pilotage": {
        "fact_sejour": [
            "service_code", "date_admission", "tranche_age", "duree_jours", "est_en_cours",
            "est_urgence", "est_sejour_index", "suivi_readmission_30j", "readmission_30j_brute",
        ],
        "fact_releve": [
            "service_code", "date_mesure", "alerte_fc", "alerte_spo2", "alerte_temp", "en_alerte",
        ],
        "fact_acte": ["code_ccam", "service_code", "date_acte", "date_admission", "sejour_coherent"],
        "dim_service": ["service_code", "service", "categorie", "capacite_lits", "pole"],
        "dim_ccam": ALL_COLUMNS,
        **{name: ALL_COLUMNS for name in KPI_TABLES},
    },
    "recherche": {
        "coh_prevalence": [
            "code_cim10", "pathologie", "nb_patients", "nb_patients_principal", "nb_sejours",
        ],
        "coh_description": ["code_cim10", "pathologie", "tranche_age", "sexe", "nb_patients"],
    },
    # Operations sees the whole of these layers, no gold.
    "exploitation": {"bronze": ALL_COLUMNS, "silver": ALL_COLUMNS, "quarantaine": ALL_COLUMNS, "ops": ALL_COLUMNS},
}
