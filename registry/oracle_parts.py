"""DuckDB SQL for the tables the oracle queries start from, one CTE per table.

Written on its own, against the driver's tables: nothing here is generated
from the Spark plans. `with_parts` prepends the CTEs a query mentions.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}

PARTS["ref_services"] = """
SELECT CASE n_nationkey WHEN 0 THEN 'URGENCES' ELSE 'N' || n_nationkey END AS service_code,
       n_name AS service_label
FROM nation WHERE n_nationkey <> 24"""

PARTS["ref_description_service"] = """
SELECT CASE n_nationkey WHEN 0 THEN 'URGENCES' ELSE 'N' || n_nationkey END AS service_code,
       r_name AS categorie,
       (SELECT nullif(count(*), 0) FROM supplier WHERE s_nationkey = n_nationkey)::INTEGER AS capacite_lits,
       'P' || r_regionkey AS pole
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 4"""

PARTS["ref_cim10"] = """
SELECT DISTINCT p_brand AS code_cim10, 'Pathologie ' || p_brand AS libelle
FROM part WHERE p_brand <> 'Brand#13'"""

PARTS["ref_ccam"] = """
SELECT 'C' || p_partkey AS code_ccam, p_type AS libelle,
       CASE WHEN p_size <> 45 THEN CAST(p_retailprice AS DECIMAL(10,2)) END AS tarif_euros
FROM part WHERE p_size <= 45"""

PARTS["bronze_patients"] = """
SELECT CASE WHEN c_custkey % 97 = 0 AND i = 1 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS patient_pseudo,
       CASE WHEN c_custkey % 50 <> 0 THEN 1930 + c_custkey % 70 END::INTEGER AS birth_year,
       ['M', 'F', ' f ', 'X'][1 + (c_custkey + CASE WHEN c_custkey % 59 = 0 THEN i ELSE 0 END) % 4] AS sex,
       CASE WHEN c_custkey % 53 = 0 AND i < 2 THEN 'AUTRE' ELSE c_mktsegment END AS region_code,
       DATE '2001-08-01' + i AS _jour_depot,
       'lake/patients/' || (DATE '2001-08-01' + i) || '/patients.csv' AS _fichier_source
FROM customer, (VALUES (0), (1), (2)) AS drops(i)
WHERE i >= c_custkey % 3"""

PARTS["bronze_sejours"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS stay_id,
       CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS patient_pseudo,
       CASE WHEN (c_nationkey + v) % 25 = 0 THEN 'URGENCES' ELSE 'N' || ((c_nationkey + v) % 25) END AS service_code,
       CASE WHEN o_orderkey % 89 <> 0 THEN o_orderdate END AS admission_ts,
       out_ts AS discharge_ts,
       CAST(o_orderkey % 83 = 0 AS INTEGER) AS _discharge_illisible,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgence' ELSE lower(substr(o_orderpriority, 3)) END AS admission_mode,
       CASE WHEN out_ts IS NULL OR o_orderkey % 71 = 0 THEN ''
            WHEN o_orderstatus <> 'F' THEN 'transfert'
            WHEN o_orderkey % 3 = 0 THEN 'deces' ELSE 'domicile' END AS discharge_mode,
       CAST(o_orderdate AS DATE) + v AS _jour_depot,
       'lake/sejours/' || (CAST(o_orderdate AS DATE) + v) || '/sejours.csv' AS _fichier_source
FROM (
    SELECT orders.*, c_nationkey,
           CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 83 <> 0 THEN closing.last_ship END AS out_ts
    FROM orders
    LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem
               WHERE l_linestatus = 'F' GROUP BY l_orderkey) AS closing ON l_orderkey = o_orderkey
) AS base JOIN (VALUES (0), (1)) AS versions(v) ON v = 0 OR o_orderkey % 61 = 0
UNION ALL
SELECT 'U' || user_id,
       CASE WHEN user_id % 97 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END,
       CASE WHEN user_id % 25 = 0 THEN 'URGENCES' ELSE 'N' || (user_id % 25) END,
       min(ts) FILTER (event_type = 'signup'), max(ts) FILTER (event_type = 'purchase'),
       0, 'programme',
       CASE WHEN max(ts) FILTER (event_type = 'purchase') IS NULL THEN '' ELSE 'domicile' END,
       CAST(min(ts) AS DATE), 'lake/sejours/' || CAST(min(ts) AS DATE) || '/sejours.csv'
FROM events GROUP BY user_id"""

PARTS["bronze_diagnostics"] = """
SELECT CASE WHEN l_orderkey % 101 = 0 THEN 'X' ELSE '' END || l_orderkey AS stay_id,
       p_brand AS code_cim10,
       CASE WHEN brand_rank = 1 THEN 'principal' ELSE 'associe' END AS type_diag,
       CAST(l_shipdate AS DATE) AS _jour_depot,
       'lake/diagnostics/' || CAST(l_shipdate AS DATE) || '/diagnostics.json' AS _fichier_source
FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey
                                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS brand_rank
    FROM (
        SELECT l_orderkey, p_brand, l_linenumber, l_partkey, l_suppkey, l_shipdate
        FROM lineitem JOIN part ON p_partkey = l_partkey
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, p_brand
                                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) = 1
    )
)"""

PARTS["bronze_monitoring"] = """
SELECT CASE WHEN user_id % 101 = 0 THEN 'X' ELSE 'U' END || user_id AS stay_id, ts,
       CAST(CASE WHEN value < 1 THEN (event_id % 2) * 500 ELSE 60 + floor(value / 2) END AS INTEGER) AS heart_rate,
       CAST(CASE WHEN value < 1 THEN (event_id % 2) * 120 ELSE 88 + event_id % 13 END AS INTEGER) AS spo2,
       CAST((360 + event_id % 40) / 10.0 AS DECIMAL(4,1)) AS temp_c,
       CAST(ts AS DATE) AS _jour_depot,
       'lake/monitoring/' || CAST(ts AS DATE) || '/monitoring.parquet' AS _fichier_source
FROM events"""

PARTS["bronze_actes"] = """
SELECT CASE WHEN l_orderkey % 101 = 0 THEN 'X' ELSE '' END || l_orderkey AS stay_id,
       'C' || l_partkey AS code_ccam, l_shipdate AS acte_ts,
       CAST(l_shipdate AS DATE) AS _jour_depot,
       'lake/actes/' || CAST(l_shipdate AS DATE) || '/actes.parquet' AS _fichier_source
FROM lineitem"""

# ---- silver

PARTS["retained_patients"] = """
SELECT * FROM bronze_patients WHERE patient_pseudo <> ''
QUALIFY row_number() OVER (PARTITION BY patient_pseudo ORDER BY _jour_depot DESC) = 1"""

PARTS["silver_patients"] = """
SELECT patient_pseudo, birth_year,
       CASE upper(trim(sex)) WHEN 'M' THEN 'M' WHEN 'F' THEN 'F' ELSE 'inconnu' END AS sex,
       region_code, _jour_depot AS _jour_depot_retenu, _fichier_source AS _fichier_source_retenu
FROM retained_patients"""

PARTS["retained_stays"] = """
SELECT * FROM bronze_sejours
QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY _jour_depot DESC) = 1"""

PARTS["judged_stays"] = """
SELECT b.stay_id, patient_pseudo, b.service_code, coalesce(r.service_label, 'inconnu') AS service_label,
       admission_ts, discharge_ts, admission_mode,
       coalesce(nullif(discharge_mode, ''), 'inconnu') AS discharge_mode,
       date_diff('minute', admission_ts, discharge_ts) / 1440.0 AS duree_jours,
       CAST(discharge_ts IS NULL AS INTEGER) AS est_en_cours, _jour_depot, _fichier_source,
       CASE WHEN patient_pseudo = '' THEN 'patient_manquant'
            WHEN admission_ts IS NULL OR _discharge_illisible = 1 THEN 'date_illisible'
            WHEN discharge_ts < admission_ts THEN 'incoherence_temporelle'
            ELSE 'retenu' END AS motif
FROM retained_stays AS b LEFT JOIN ref_services AS r ON r.service_code = b.service_code"""

PARTS["silver_sejours"] = "SELECT * EXCLUDE (motif) FROM judged_stays WHERE motif = 'retenu'"

PARTS["carried_diagnostics"] = """
SELECT d.*, s.patient_pseudo, s.service_code, s.admission_ts,
       CAST(s.motif = 'retenu' AS INTEGER) AS sejour_coherent,
       CASE WHEN s.stay_id IS NULL THEN 'sejour_inconnu'
            WHEN s.patient_pseudo = '' THEN 'sejour_ecarte' ELSE 'retenu' END AS motif
FROM bronze_diagnostics AS d LEFT JOIN judged_stays AS s ON s.stay_id = d.stay_id"""

PARTS["silver_diagnostics"] = """
SELECT c.stay_id, c.code_cim10, type_diag, coalesce(libelle, 'inconnu') AS libelle, patient_pseudo, service_code,
       admission_ts, sejour_coherent, _jour_depot, _fichier_source
FROM carried_diagnostics AS c LEFT JOIN ref_cim10 AS r ON r.code_cim10 = c.code_cim10 WHERE motif = 'retenu'"""

PARTS["carried_monitoring"] = """
SELECT m.*, s.patient_pseudo, s.service_code, s.admission_ts, s.discharge_ts,
       CAST(s.motif = 'retenu' AS INTEGER) AS sejour_coherent,
       CASE WHEN heart_rate < 20 OR heart_rate > 250 OR spo2 < 50 OR spo2 > 100 OR temp_c < 30 OR temp_c > 45
                THEN 'capteur_hors_plage'
            WHEN s.stay_id IS NULL THEN 'sejour_inconnu'
            WHEN s.patient_pseudo = '' THEN 'sejour_ecarte'
            WHEN s.motif = 'retenu' AND (ts < s.admission_ts OR ts > s.discharge_ts) THEN 'releve_hors_sejour'
            ELSE 'retenu' END AS motif
FROM bronze_monitoring AS m LEFT JOIN judged_stays AS s ON s.stay_id = m.stay_id"""

PARTS["silver_monitoring"] = """
SELECT stay_id, ts, heart_rate, spo2, temp_c, patient_pseudo, service_code, admission_ts, sejour_coherent,
       _jour_depot, _fichier_source
FROM carried_monitoring WHERE motif = 'retenu'"""

PARTS["carried_actes"] = """
SELECT a.*, s.patient_pseudo, s.service_code, s.admission_ts, s.discharge_ts,
       CAST(s.motif = 'retenu' AS INTEGER) AS sejour_coherent,
       CASE WHEN s.stay_id IS NULL THEN 'sejour_inconnu'
            WHEN s.patient_pseudo = '' THEN 'sejour_ecarte'
            WHEN s.motif = 'retenu' AND (acte_ts < s.admission_ts OR acte_ts > s.discharge_ts) THEN 'acte_hors_sejour'
            ELSE 'retenu' END AS motif
FROM bronze_actes AS a LEFT JOIN judged_stays AS s ON s.stay_id = a.stay_id"""

PARTS["silver_actes"] = """
SELECT c.stay_id, c.code_ccam, acte_ts, coalesce(libelle, 'inconnu') AS libelle, patient_pseudo, service_code,
       admission_ts, sejour_coherent, _jour_depot, _fichier_source
FROM carried_actes AS c LEFT JOIN ref_ccam AS r ON r.code_ccam = c.code_ccam WHERE motif = 'retenu'"""

PARTS["rejets"] = """
SELECT 'patients' AS source, '(vide)' AS cle, 'patient_manquant' AS motif, 'ecarte' AS action,
       count(*) || ' ligne(s) bronze fusionnées sous un pseudonyme vide' AS detail, count(*) AS nb_lignes,
       max(_jour_depot) AS _jour_depot, arg_max(_fichier_source, _jour_depot) AS _fichier_source
FROM bronze_patients WHERE patient_pseudo = '' HAVING count(*) > 0
UNION ALL
SELECT 'patients', patient_pseudo, 'sexe_non_normalise', 'corrige', 'sexe source [' || sex || '] -> inconnu', 1,
       _jour_depot, _fichier_source
FROM retained_patients WHERE upper(trim(sex)) NOT IN ('M', 'F')
UNION ALL
SELECT 'patients', patient_pseudo, 'date_naissance_illisible', 'corrige',
       'date de naissance illisible en source -> birth_year NULL', 1, _jour_depot, _fichier_source
FROM retained_patients WHERE birth_year IS NULL
UNION ALL
SELECT 'sejours', stay_id, motif, 'ecarte',
       CASE motif
           WHEN 'patient_manquant' THEN 'patient_pseudo vide (patient_id absent en source)'
           WHEN 'incoherence_temporelle' THEN 'admission=' || strftime(admission_ts, '%Y-%m-%d %H:%M:%S')
                                           || ' sortie=' || strftime(discharge_ts, '%Y-%m-%d %H:%M:%S')
           ELSE CASE WHEN admission_ts IS NULL THEN 'date d''admission illisible dans la source'
                     ELSE 'date de sortie non vide et illisible dans la source' END END,
       1, _jour_depot, _fichier_source
FROM judged_stays WHERE motif <> 'retenu'
UNION ALL
SELECT 'sejours', stay_id, 'version_remplacee', 'ecarte', 'version remplacée par un dépôt plus récent', 1,
       _jour_depot, _fichier_source
FROM (SELECT * FROM bronze_sejours QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY _jour_depot DESC) > 1)
UNION ALL
SELECT 'diagnostics', stay_id || '/' || code_cim10, motif, 'ecarte',
       CASE motif WHEN 'sejour_inconnu' THEN 'stay_id absent de bronze.sejours'
                  ELSE 'séjour porteur sans patient identifié (patient_pseudo vide)' END,
       1, _jour_depot, _fichier_source
FROM carried_diagnostics WHERE motif <> 'retenu'
UNION ALL
SELECT 'monitoring', stay_id || '@' || strftime(ts, '%Y-%m-%d %H:%M:%S'), motif, 'ecarte',
       CASE motif
           WHEN 'capteur_hors_plage' THEN 'fc=' || heart_rate || ' spo2=' || spo2 || ' temp=' || temp_c
           WHEN 'sejour_inconnu' THEN 'stay_id absent de bronze.sejours'
           WHEN 'sejour_ecarte' THEN 'séjour porteur sans patient identifié (patient_pseudo vide)'
           ELSE 'ts=' || strftime(ts, '%Y-%m-%d %H:%M:%S')
                || CASE WHEN ts < admission_ts
                        THEN ' antérieur à l''admission=' || strftime(admission_ts, '%Y-%m-%d %H:%M:%S')
                        ELSE ' postérieur à la sortie=' || strftime(discharge_ts, '%Y-%m-%d %H:%M:%S') END END,
       1, _jour_depot, _fichier_source
FROM carried_monitoring WHERE motif <> 'retenu'
UNION ALL
SELECT 'actes', stay_id || '/' || code_ccam || '@' || strftime(acte_ts, '%Y-%m-%d %H:%M:%S'), motif, 'ecarte',
       CASE motif
           WHEN 'sejour_inconnu' THEN 'stay_id absent de bronze.sejours'
           WHEN 'sejour_ecarte' THEN 'séjour porteur sans patient identifié (patient_pseudo vide)'
           ELSE 'acte_ts=' || strftime(acte_ts, '%Y-%m-%d %H:%M:%S')
                || CASE WHEN acte_ts < admission_ts
                        THEN ' antérieur à l''admission=' || strftime(admission_ts, '%Y-%m-%d %H:%M:%S')
                        ELSE ' postérieur à la sortie=' || strftime(discharge_ts, '%Y-%m-%d %H:%M:%S') END END,
       1, _jour_depot, _fichier_source
FROM carried_actes WHERE motif <> 'retenu'"""

# ---- star

PARTS["dim_patient"] = "SELECT patient_pseudo, birth_year, sex AS sexe, region_code AS region FROM silver_patients"

PARTS["dim_service"] = """
SELECT r.service_code, r.service_label AS service, coalesce(d.categorie, 'non renseigné') AS categorie,
       d.capacite_lits, coalesce(d.pole, 'non renseigné') AS pole
FROM ref_services AS r LEFT JOIN ref_description_service AS d ON d.service_code = r.service_code"""

PARTS["dim_cim10"] = "SELECT code_cim10, libelle AS pathologie FROM ref_cim10"
PARTS["dim_ccam"] = "SELECT code_ccam, libelle AS acte, tarif_euros FROM ref_ccam"

PARTS["fact_sejour"] = """
SELECT s.stay_id, s.patient_pseudo, s.service_code, CAST(admission_ts AS DATE) AS date_admission,
       CAST(discharge_ts AS DATE) AS date_sortie, admission_ts, discharge_ts, admission_mode, discharge_mode,
       CAST(year(admission_ts) - birth_year AS INTEGER) AS age_au_sejour,
       coalesce((year(admission_ts) - birth_year) // 10 * 10 || '-' || (year(admission_ts) - birth_year) // 10 * 10 + 9,
                'inconnu') AS tranche_age,
       duree_jours, est_en_cours, CAST(admission_mode = 'urgence' AS INTEGER) AS est_urgence,
       CAST(est_en_cours = 0 AND discharge_mode <> 'deces' AS INTEGER) AS est_sejour_index,
       CAST(back AND est_en_cours = 0 AND discharge_mode <> 'deces' AS INTEGER) AS suivi_readmission_30j,
       CAST(back AS INTEGER) AS readmission_30j_brute
FROM (
    SELECT i.*, EXISTS (SELECT 1 FROM silver_sejours AS later
                        WHERE later.patient_pseudo = i.patient_pseudo AND later.stay_id <> i.stay_id
                          AND later.admission_ts > i.discharge_ts
                          AND later.admission_ts <= i.discharge_ts + INTERVAL 30 DAY) AS back
    FROM silver_sejours AS i
) AS s LEFT JOIN dim_patient AS p ON p.patient_pseudo = s.patient_pseudo"""

PARTS["fact_diagnostic"] = """
SELECT d.stay_id, d.patient_pseudo, code_cim10, service_code, CAST(admission_ts AS DATE) AS date_admission, type_diag,
       CAST(type_diag = 'principal' AS INTEGER) AS est_principal, sejour_coherent,
       CAST(year(admission_ts) - birth_year AS INTEGER) AS age_au_sejour,
       coalesce((year(admission_ts) - birth_year) // 10 * 10 || '-' || (year(admission_ts) - birth_year) // 10 * 10 + 9,
                'inconnu') AS tranche_age,
       coalesce(sexe, 'inconnu') AS sexe
FROM silver_diagnostics AS d LEFT JOIN dim_patient AS p ON p.patient_pseudo = d.patient_pseudo"""

PARTS["fact_releve"] = """
SELECT *, CAST(alerte_fc + alerte_spo2 + alerte_temp > 0 AS INTEGER) AS en_alerte
FROM (
    SELECT stay_id, patient_pseudo, service_code, ts, CAST(ts AS DATE) AS date_mesure, heart_rate, spo2, temp_c,
           CAST(heart_rate NOT BETWEEN 50 AND 100 AS INTEGER) AS alerte_fc, CAST(spo2 < 92 AS INTEGER) AS alerte_spo2,
           CAST(temp_c > 38.5 AS INTEGER) AS alerte_temp, sejour_coherent
    FROM silver_monitoring
)"""

PARTS["fact_acte"] = """
SELECT stay_id, code_ccam, service_code, CAST(acte_ts AS DATE) AS date_acte,
       CAST(admission_ts AS DATE) AS date_admission, sejour_coherent
FROM silver_actes"""


def rounded(expression: str, digits: int = 2) -> str:
    """Decimal rounding, half away from zero, on the printed value of a double."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def pct(numerator: str, denominator: str) -> str:
    return f"coalesce({rounded(f'100.0::DOUBLE * {numerator} / nullif({denominator}, 0)')}, 0.0)"


# ---- indicators

_SUMMARY = f"""
       {rounded("sum(duree_jours) FILTER (est_en_cours = 0) / count(*) FILTER (est_en_cours = 0)")} AS dms_jours,
       {rounded("sum(duree_jours * 24) FILTER (est_en_cours = 0) / count(*) FILTER (est_en_cours = 0)", 1)} AS dms_heures,
       {rounded("quantile_cont(duree_jours, 0.5) FILTER (est_en_cours = 0)")} AS mediane_jours,
       {rounded("quantile_cont(duree_jours, 0.9) FILTER (est_en_cours = 0)")} AS p90_jours"""

PARTS["kpi_dms_service"] = f"""
SELECT service_code, service, CAST(date_trunc('month', date_admission) AS DATE) AS mois, {_SUMMARY},
       {rounded("max(duree_jours)")} AS max_jours, count(*) AS nb_sejours_clos
FROM fact_sejour JOIN dim_service USING (service_code) WHERE est_en_cours = 0 GROUP BY ALL"""

PARTS["kpi_activite_categorie"] = f"""
SELECT categorie, count(*) AS nb_sejours, count(*) FILTER (est_en_cours = 0) AS nb_sejours_clos, {_SUMMARY}
FROM fact_sejour JOIN dim_service USING (service_code) GROUP BY ALL"""

PARTS["kpi_urgences_jour"] = f"""
SELECT date_admission AS jour, count(*) FILTER (service_code = 'URGENCES') AS nb_passages_urgences,
       count(*) FILTER (service_code = 'URGENCES' AND est_en_cours = 1) AS nb_encore_presents,
       {rounded("coalesce(avg(duree_jours * 24) FILTER (service_code = 'URGENCES'), 0)", 1)} AS duree_moy_heures,
       count(*) FILTER (admission_mode = 'urgence') AS nb_admissions_en_urgence, count(*) AS nb_sejours
FROM fact_sejour GROUP BY ALL"""

PARTS["kpi_readmission_service"] = f"""
SELECT service_code, service, n AS nb_sejours, brut AS nb_readmis_30j_brut, {pct("brut", "n")} AS taux_brut_pct,
       idx AS nb_sejours_index, adj AS nb_readmis_30j, {pct("adj", "idx")} AS taux_pct
FROM (SELECT service_code, service, count(*) AS n, sum(readmission_30j_brute)::BIGINT AS brut,
             sum(est_sejour_index)::BIGINT AS idx, sum(suivi_readmission_30j)::BIGINT AS adj
      FROM fact_sejour JOIN dim_service USING (service_code) GROUP BY ALL)"""

PARTS["kpi_alertes_jour"] = f"""
SELECT jour, service_code, service, n AS nb_releves, a AS nb_en_alerte, {pct("a", "n")} AS taux_pct
FROM (SELECT date_mesure AS jour, service_code, service, count(*) AS n, sum(en_alerte)::BIGINT AS a
      FROM fact_releve JOIN dim_service USING (service_code) GROUP BY ALL)"""

# Every stay laid out day by day, the plain way.
PARTS["kpi_occupation_jour"] = """
SELECT jour, service_code, service, count(*) AS nb_presents,
       count(*) FILTER (jour = date_admission) AS nb_admissions, count(*) FILTER (jour = date_sortie) AS nb_sorties
FROM (
    SELECT service_code, date_admission, date_sortie,
           unnest(generate_series(date_admission,
                                  least(coalesce(date_sortie, horizon), horizon), INTERVAL 1 DAY))::DATE AS jour
    FROM fact_sejour, (SELECT max(date_admission) AS horizon FROM fact_sejour)
) JOIN dim_service USING (service_code) GROUP BY jour, service_code, service"""

PARTS["kpi_mortalite_service"] = f"""
SELECT service_code, service, n AS nb_sejours_clos, d AS nb_deces, {pct("d", "n")} AS taux_pct
FROM (SELECT service_code, service, count(*) AS n, count(*) FILTER (discharge_mode = 'deces') AS d
      FROM fact_sejour JOIN dim_service USING (service_code) WHERE est_en_cours = 0 GROUP BY ALL)"""

PARTS["kpi_casemix_service"] = f"""
SELECT *, {pct("nb_sejours", "sum(nb_sejours) OVER (PARTITION BY service_code)")} AS part_pct
FROM (SELECT service_code, service, code_cim10, pathologie, count(*) AS nb_sejours
      FROM fact_diagnostic JOIN dim_service USING (service_code) JOIN dim_cim10 USING (code_cim10)
      WHERE est_principal = 1 GROUP BY ALL)"""

PARTS["kpi_origine_service"] = f"""
SELECT *, {pct("nb_sejours", "sum(nb_sejours) OVER (PARTITION BY service_code)")} AS part_pct
FROM (SELECT service_code, service, region AS region_code, count(*) AS nb_sejours,
             count(DISTINCT patient_pseudo) AS nb_patients
      FROM fact_sejour JOIN dim_service USING (service_code) JOIN dim_patient USING (patient_pseudo) GROUP BY ALL)"""

PARTS["kpi_actes_service"] = f"""
SELECT service_code, service, categorie, n AS nb_actes, s AS nb_sejours, w AS nb_sejours_avec_acte,
       coalesce({rounded("n::DOUBLE / nullif(s, 0)")}, 0) AS actes_par_sejour,
       coalesce({rounded("n::DOUBLE / nullif(w, 0)")}, 0) AS actes_par_sejour_avec_acte
FROM (SELECT service_code, service, categorie,
             (SELECT count(*) FROM fact_acte AS f WHERE f.service_code = d.service_code) AS n,
             (SELECT count(*) FROM fact_sejour AS f WHERE f.service_code = d.service_code) AS s,
             (SELECT count(DISTINCT stay_id) FROM fact_acte AS f WHERE f.service_code = d.service_code) AS w
      FROM dim_service AS d)"""

PARTS["kpi_actes_type"] = f"""
SELECT f.code_ccam, coalesce(acte, 'inconnu') AS acte, count(*) AS nb_actes,
       {rounded("100.0::DOUBLE * count(*) / (SELECT count(*) FROM fact_acte)")} AS part_pct,
       count(DISTINCT stay_id) AS nb_sejours_concernes, tarif_euros
FROM fact_acte AS f LEFT JOIN dim_ccam AS c ON c.code_ccam = f.code_ccam GROUP BY f.code_ccam, acte, tarif_euros"""

PARTS["kpi_densite_actes_lit"] = f"""
SELECT service_code, service, categorie, capacite_lits, count(*) AS nb_actes,
       {rounded("count(*)::DOUBLE / capacite_lits")} AS actes_par_lit
FROM fact_acte JOIN dim_service USING (service_code) WHERE capacite_lits IS NOT NULL
GROUP BY service_code, service, categorie, capacite_lits"""

PARTS["kpi_facturation_service"] = f"""
SELECT service_code, service, categorie, count(*) AS nb_actes,
       count(*) FILTER (tarif_euros IS NULL) AS nb_actes_sans_tarif,
       coalesce(sum(tarif_euros), 0) AS montant_euros,
       coalesce({rounded("sum(tarif_euros)::DOUBLE / nullif(count(tarif_euros), 0)")}, 0) AS montant_moyen_euros
FROM fact_acte JOIN dim_service USING (service_code) LEFT JOIN dim_ccam USING (code_ccam) GROUP BY ALL"""

PARTS["coh_prevalence"] = """
SELECT code_cim10, pathologie, count(DISTINCT patient_pseudo) AS nb_patients,
       count(DISTINCT patient_pseudo) FILTER (est_principal = 1) AS nb_patients_principal, count(*) AS nb_sejours
FROM fact_diagnostic JOIN dim_cim10 USING (code_cim10) GROUP BY ALL HAVING count(DISTINCT patient_pseudo) >= 5"""

PARTS["coh_description"] = """
SELECT code_cim10, pathologie, tranche_age, sexe, count(DISTINCT patient_pseudo) AS nb_patients
FROM fact_diagnostic JOIN dim_cim10 USING (code_cim10) WHERE est_principal = 1 AND tranche_age <> 'inconnu'
GROUP BY ALL HAVING count(DISTINCT patient_pseudo) >= 5"""


def with_parts(query: str, extra: dict[str, str] | None = None) -> str:
    """The query behind the CTEs it needs, in dependency order."""
    parts = {**PARTS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in parts:
            if name not in ordered and re.search(rf"(?<![\w.]){name}(?![\w.])", text):
                visit(parts[name])
                if name not in ordered:
                    ordered.append(name)

    visit(query)
    if not ordered:
        return query
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({parts[name]})" for name in ordered)
    return f"WITH {ctes}\n{query}"
