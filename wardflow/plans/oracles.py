"""ANSI SQL for the registered queries, written independently of the Spark code.

Single windows and plain aggregates throughout: these state what the result is.
"""

from wardflow import schema as S

VALUES = ["HR", "Temp", "MAP", "BUN", "WBC", "Hct", "AST"]
NUMERIC = [*VALUES, "ICULOS", "Age", "Gender", "Unit1", "Unit2", "HospAdmTime"]
SCALED = ["HR", "Temp", "MAP", "BUN", "Hct", "WBC"]
TYPES = {
    "Patient_ID": "object", "ICULOS": "int64", "HR": "float64", "Temp": "float64", "MAP": "float64",
    "BUN": "float64", "WBC": "float64", "Hct": "float64", "AST": "float64", "Age": "float64",
    "Gender": "int64", "Unit1": "float64", "Unit2": "float64", "HospAdmTime": "float64",
    "SepsisLabel": "int64",
}
ALL = list(TYPES) + ["ts", "event_id"]


def each(names, form, sep=", "):
    return sep.join(form.format(c=c) for c in names)


def union(names, form):
    return each(names, form, " UNION ALL ")


OBS = """obs AS (
SELECT concat('p', lpad(cast(user_id AS varchar), cast(greatest(length(cast(user_id AS varchar)), 6) AS integer), '0')) AS Patient_ID,
  cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS ICULOS,
  CASE WHEN event_type = 'view' THEN value END AS HR,
  CASE WHEN event_type = 'click' THEN value END AS Temp,
  CASE WHEN event_type = 'purchase' THEN value END AS MAP,
  CASE WHEN event_type = 'signup' THEN value END AS BUN,
  CASE WHEN event_id % 3 = 0 THEN value END AS WBC,
  CASE WHEN event_type = 'signup' AND value > 100 THEN value END AS Hct,
  CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN value END AS AST,
  cast(20 + user_id % 70 AS double) AS Age,
  cast(user_id % 3 AS bigint) AS Gender,
  cast(user_id % 2 AS double) AS Unit1,
  cast(1 - user_id % 2 AS double) AS Unit2,
  cast(0 - user_id % 100 AS double) AS HospAdmTime,
  cast(CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END AS bigint) AS SepsisLabel,
  ts, event_id
FROM events)"""
WITH = "WITH " + OBS

BACK = "PARTITION BY Patient_ID ORDER BY ICULOS ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
AHEAD = "PARTITION BY Patient_ID ORDER BY ICULOS ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
FILL = (
    "coalesce(first_value({c} IGNORE NULLS) OVER (" + BACK + "), last_value({c} IGNORE NULLS) OVER (" + AHEAD + ")) AS {c}"
)
PREP = (
    WITH
    + ", filled AS (SELECT Patient_ID, ICULOS, event_id, Age, Gender, HospAdmTime, SepsisLabel, "
    + each(["HR", "Temp", "MAP", "BUN", "WBC", "Hct"], FILL)
    + " FROM obs), prep AS (SELECT * FROM (SELECT Patient_ID, event_id, SepsisLabel, HR, Temp, "
    + each(["MAP", "BUN"], "CASE WHEN {c} > -1 THEN ln(1 + {c}) END AS {c}")
    + ", Hct, CASE WHEN WBC > -1 THEN ln(1 + WBC) END AS WBC, Age, HospAdmTime, ICULOS, "
    "cast(CASE WHEN Gender = 0 THEN 1 ELSE 0 END AS integer) AS F, cast(CASE WHEN Gender = 1 THEN 1 ELSE 0 END AS integer) AS M "
    "FROM filled) WHERE " + each(SCALED, "{c} IS NOT NULL", " AND ") + ")"
)
SCALE = "({c} - (SELECT avg({c}) FROM prep)) / (SELECT stddev_pop({c}) FROM prep)"


def sides(source, key, seed, share, name="sides"):
    """Every row of `source` with its side of a hashed split of the distinct keys."""
    return (
        f"{name}_keys AS (SELECT k, row_number() OVER (ORDER BY md5(concat('{seed}|', k))) AS r, count(*) OVER () AS n "
        f"FROM (SELECT DISTINCT cast({key} AS varchar) AS k FROM {source})), "
        f"{name} AS (SELECT t.*, CASE WHEN r <= ceil(n * cast({share} AS double)) THEN 'test' ELSE 'train' END AS side "
        f"FROM {source} t JOIN {name}_keys ON k = cast(t.{key} AS varchar))"
    )


HALVES = WITH + ", " + sides("obs", "Patient_ID", "split", 0.5)

SCORED = (
    "scored AS (SELECT *, cast(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS integer) AS prediction FROM (SELECT *, "
    "round(1 / (1 + exp(-(0.02 * coalesce(HR, 0) + 0.01 * coalesce(WBC, 0) - 1))), 6) AS score FROM obs))"
)


def profile(columns, source, extra=""):
    """Numeric profile rows of `columns`; min to n_rows as in the tall profile table."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{TYPES.get(c, 'float64')}' AS dtype, cast(min({c}) AS double) AS min, cast(max({c}) AS double) AS max, "
        f"avg({c}) AS mean, cast(median({c}) AS double) AS median, stddev_samp({c}) AS std, "
        f"count(*) - count({c}) AS null_count, count(*) AS n_rows FROM {source} {extra}"
        for c in columns
    )


def stat_checks(nulls="null_count"):
    o, r = ("o.null_count", "r.null_count") if nulls == "null_count" else (
        "o.null_count / cast(o.n_rows AS double)", "r.null_count / cast(r.n_rows AS double)")
    rules = [
        ("min", "o.min < r.min", "r.min", "o.min"),
        ("max", "o.max > r.max", "r.max", "o.max"),
        ("mean", "abs(o.mean - r.mean) > 3 * r.std", "r.mean", "o.mean"),
        ("median", "abs(o.median - r.median) > 3 * r.std", "r.median", "o.median"),
        (nulls, f"{o} > {r}", r, o),
    ]
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, column_name, 'warning' AS severity, round(cast({e} AS double), 6) AS expected, "
        f"round(cast({f} AS double), 6) AS observed FROM recorded r JOIN observed o USING (column_name) WHERE {test}"
        for rule, test, e, f in rules
    )


def confusion(source, truth, guess):
    return (
        f"cells AS (SELECT cast(a.c AS integer) AS y_true, cast(b.c AS integer) AS y_pred, "
        f"(SELECT count(*) FROM {source} WHERE {truth} = a.c AND {guess} = b.c) AS n "
        "FROM (VALUES (0), (1)) a(c), (VALUES (0), (1)) b(c)), "
        "sizes AS (SELECT c AS label, (SELECT sum(n) FROM cells WHERE y_true = c) AS support, "
        "(SELECT sum(n) FROM cells WHERE y_pred = c) AS predicted, "
        "(SELECT sum(n) FROM cells WHERE y_true = c AND y_pred = c) AS hits FROM (VALUES (0), (1)) a(c)), "
        "per_class AS (SELECT label, support, hits, CASE WHEN predicted = 0 THEN 0 ELSE hits / cast(predicted AS double) END AS prec, "
        "CASE WHEN support = 0 THEN 0 ELSE hits / cast(support AS double) END AS rec, "
        "CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / cast(support + predicted AS double) END AS f1 FROM sizes)"
    )


RUNNING = (
    WITH
    + ", counts AS (SELECT Patient_ID, count(*) FILTER (WHERE SepsisLabel = 0) AS count_of_0, "
    "count(*) FILTER (WHERE SepsisLabel = 1) AS count_of_1 FROM obs GROUP BY Patient_ID), "
    "ordered AS (SELECT *, row_number() OVER w AS position, cast(sum(count_of_1) OVER (w ROWS UNBOUNDED PRECEDING) AS bigint) "
    "AS cumulative_count_of_1 FROM counts WINDOW w AS (ORDER BY count_of_1 DESC, md5(concat('order|', Patient_ID)))), "
    "total AS (SELECT cast(sum(count_of_1) AS double) AS t FROM counts), "
    "first AS (SELECT min(position) AS b, min(cumulative_count_of_1) AS c FROM ordered, total WHERE cumulative_count_of_1 >= cast(0.7 AS double) * t), "
    "second AS (SELECT min(position) AS b FROM ordered, total, first WHERE position > first.b "
    "AND cumulative_count_of_1 - first.c >= cast(0.2 AS double) * t), "
    "cohorts AS (SELECT ordered.*, cast(CASE WHEN position <= first.b THEN 1 WHEN second.b IS NULL OR position <= second.b THEN 2 ELSE 3 END "
    "AS integer) AS cohort FROM ordered, first, second)"
)

PATHS = (
    "paths AS (SELECT event_id, concat('/data/batch-', cast(user_id % 3 + 1 AS varchar), '/p', lpad(cast(event_id AS varchar), 9, '0'), "
    "CASE WHEN event_type = 'error' THEN '.txt' ELSE '.psv' END) AS path FROM events)"
)
LOG = (
    "rows AS (SELECT *, concat_ws('-', user_id, event_type) AS request FROM events), "
    "sizes AS (SELECT request, count(*) AS n_input_rows, min(ts) AS timestamp, max(value) AS total_latency FROM rows GROUP BY request), "
    "log AS (SELECT *, total_latency / n_input_rows AS average_latency_per_row FROM sizes)"
)
GRID = (
    "grid AS (SELECT concat('model-', event_type) AS model, "
    "cast(CASE event_id % 3 WHEN 0 THEN 50 WHEN 1 THEN 100 ELSE 200 END AS integer) AS n_estimators, "
    "cast(CASE event_id // 3 % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 9 END AS integer) AS max_depth, "
    "CASE event_id // 9 % 3 WHEN 0 THEN '0.01' WHEN 1 THEN '0.1' ELSE '0.2' END AS learning_rate, value / 1000 AS score FROM events)"
)
COEFFICIENTS = {"HR": 0.5, "Temp": -0.25, "MAP": 1.5, "WBC": 2.0}

ORACLES = {
    "id_from_path": f"""WITH {PATHS} SELECT event_id, nullif(regexp_extract(path, '([^/]+)[.]psv$', 1), '') AS id_file,
        substr(name, 3, length(name) - 6) AS id_trimmed, split_part(split_part(name, 'p', 2), '.', 1) AS id_after_p,
        substr(name, 1, length(name) - 4) AS id_stem
        FROM (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM paths)""",
    "row_position": """SELECT event_id, user_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bigint) AS "Hour" FROM events""",
    "first_rows": f"{WITH} SELECT Patient_ID, ICULOS, HR, SepsisLabel FROM obs ORDER BY Patient_ID, ICULOS LIMIT 1000",
    "content_dedup_count": "SELECT count(*) AS n_files, count(DISTINCT text) AS n_contents FROM documents",
    "other_files": f"""WITH {PATHS} SELECT regexp_extract(path, '^(.*)/', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS file
        FROM paths WHERE path NOT LIKE '%.psv'""",
    "latest_run": """SELECT max(cast(strftime(ts, '%Y%m%d%H%M%S') AS bigint)) AS stamp,
        concat('model-run-', max(strftime(ts, '%Y%m%d-%H%M%S'))) AS run FROM events WHERE event_type = 'signup'""",
    "next_version": """SELECT p_brand AS prefix, cast(coalesce(max(CASE WHEN p_size % 5 > 0 THEN p_size END), 0) + 1 AS bigint) AS next_version
        FROM part GROUP BY p_brand""",
    "unit_column": f'{WITH} SELECT event_id, Unit1 + Unit2 AS "Unit" FROM obs',
    "pruned_columns": f"{WITH} SELECT Patient_ID, ICULOS, HR, Temp, MAP, BUN, WBC, Hct, Age, Gender, HospAdmTime, SepsisLabel, event_id FROM obs",
    "unnamed_dropped": f"{WITH} SELECT event_id, HR, SepsisLabel FROM obs",
    "cast_types": """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS HR,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id % 2 END AS Gender,
        CASE WHEN event_id % 7 > 0 THEN cast(user_id AS varchar) ELSE '' END AS Patient_ID FROM events""",
    "inf_nan_to_null": "SELECT event_id, CASE WHEN event_id % 5 > 2 THEN value END AS HR FROM events",
    "log_columns": f"{WITH} SELECT event_id, "
    + each(["MAP", "BUN", "WBC"], "round(CASE WHEN {c} - 20 > -1 THEN ln(1 + ({c} - 20)) END, 6) AS {c}") + " FROM obs",
    "log_clipped": f"""{WITH} SELECT event_id, round(ln(1 + greatest(Age - 40, 0)), 6) AS "Age_log",
        round(ln(1 + cast(greatest(ICULOS, 0) AS double)), 6) AS "ICULOS_log",
        round(ln(1 + (1 - least(HospAdmTime, 0))), 6) AS "HospAdmTime_log" FROM obs""",
    "one_hot_gender": f"""{WITH} SELECT event_id, CASE Gender WHEN 1 THEN 'M' WHEN 0 THEN 'F' END AS letter,
        cast(CASE WHEN Gender = 0 THEN 1 ELSE 0 END AS integer) AS "F", cast(CASE WHEN Gender = 1 THEN 1 ELSE 0 END AS integer) AS "M" FROM obs""",
    "fill_constant": f'{WITH} SELECT event_id, coalesce(AST, 0) AS "TroponinI", coalesce(Hct, 0) AS "Fibrinogen" FROM obs',
    "null_rendering": """SELECT event_id, coalesce(t, 'null') AS shown,
        concat('[', coalesce('"' || t || '"', 'null'), ',', coalesce('"' || u || '"', 'null'), ']') AS row
        FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS t, CASE WHEN event_id % 4 > 0 THEN cast(user_id AS varchar) END AS u FROM events)""",
    "label_encode": "SELECT event_id, event_type, cast(dense_rank() OVER (ORDER BY event_type) - 1 AS bigint) AS code FROM events",
    "renamed_results": 'SELECT event_id, event_type AS model, value AS "Recall" FROM events',
    "null_rows_dropped": f"{WITH} SELECT Patient_ID, ICULOS, HR, WBC FROM obs WHERE HR IS NOT NULL AND WBC IS NOT NULL",
    "fill_bidirectional": f"{WITH} SELECT Patient_ID, ICULOS, {each(VALUES, FILL)} FROM obs",
    "fill_forward": f"{WITH} SELECT Patient_ID, ICULOS, " + each(VALUES, "last_value({c} IGNORE NULLS) OVER (" + AHEAD + ") AS {c}") + " FROM obs",
    "prepare_features": f"""{PREP} SELECT Patient_ID, event_id, SepsisLabel, HR, Temp, round(MAP, 6) AS MAP, round(BUN, 6) AS BUN, Hct,
        round(WBC, 6) AS WBC, Age, HospAdmTime, ICULOS, F, M FROM prep""",
    "scaler_fit": f"{PREP} " + union(SCALED, "SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM prep"),
    "scale_apply": f"{PREP} SELECT event_id, " + each(SCALED, "round(" + SCALE + ", 6) AS {c}") + " FROM prep",
    "scaled_by_label": f"{PREP} SELECT SepsisLabel, count(*) AS n, " + each(SCALED, "round(avg(" + SCALE + "), 6) AS {c}")
    + ", " + each(["Age", "HospAdmTime", "ICULOS", "F", "M"], "round(avg({c}), 6) AS {c}") + " FROM prep GROUP BY SepsisLabel",
    "impute_mean": f"{HALVES} SELECT event_id, "
    + each(VALUES, "round(coalesce({c}, (SELECT avg({c}) FROM sides WHERE side = 'train')), 6) AS {c}") + " FROM sides WHERE side = 'test'",
    "profile_numeric": f"{WITH} SELECT column_name, dtype, min, max, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, null_count, n_rows FROM ("
    + profile([c for c, t in TYPES.items() if t != "object"], "obs") + ")",
    "profile_text": union(["lang", "source"], """SELECT '{c}' AS column_name, 'object' AS dtype, count(*) - count({c}) AS null_count,
        count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows FROM documents"""),
    "profile_values": union(["lang", "source"], "SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY {c}"),
    "recorded_schema": f"{WITH} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS known FROM obs" for c, t in TYPES.items()),
    "table_shape": f"{WITH} SELECT count(*) AS n_rows, cast({len(TYPES)} AS integer) AS n_columns FROM obs",
    "missing_counts": f"{WITH} SELECT * FROM (" + union(ALL, "SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM obs") + ") WHERE missing > 0",
    "describe_exact": union(
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        """SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem""",
    ),
    "value_counts": f"{WITH} SELECT Gender, count(*) AS n FROM obs GROUP BY Gender",
    "prevalence": f"""{WITH} SELECT count(*) FILTER (WHERE SepsisLabel = 1) AS positives, count(*) FILTER (WHERE SepsisLabel = 0) AS negatives,
        round(avg(SepsisLabel), 6) AS prevalence FROM obs""",
    "pearson_corr": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem",
    "outer_count_join": f"""{WITH}, a AS (SELECT Patient_ID, count(*) AS n FROM obs WHERE SepsisLabel = 0 GROUP BY 1),
        b AS (SELECT Patient_ID, count(*) AS n FROM obs WHERE SepsisLabel = 1 GROUP BY 1)
        SELECT Patient_ID, coalesce(a.n, 0) AS count_of_0, coalesce(b.n, 0) AS count_of_1 FROM a FULL JOIN b USING (Patient_ID)""",
    "label_counts": f"""{WITH} SELECT Patient_ID, count(*) FILTER (WHERE SepsisLabel = 0) AS count_of_0,
        count(*) FILTER (WHERE SepsisLabel = 1) AS count_of_1 FROM obs GROUP BY Patient_ID""",
    "semi_join_cohort": f"{WITH} SELECT event_id, Patient_ID, ICULOS FROM obs WHERE Patient_ID IN (SELECT Patient_ID FROM obs WHERE SepsisLabel = 1)",
    "leakage_check": f"""{WITH}, {sides("obs", "event_id", "42", 0.2)}, shared AS (SELECT Patient_ID FROM sides WHERE side = 'train'
        INTERSECT SELECT Patient_ID FROM sides WHERE side = 'test')
        SELECT count(*) > 0 AS left_in_right, count(*) > 0 AS right_in_left, count(*) AS shared_keys FROM shared""",
    "feature_label_join": f"{WITH} SELECT Patient_ID, ICULOS, HR, SepsisLabel FROM obs",
    "anti_join_missing": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)",
    "distinct_patients": f"{WITH} SELECT DISTINCT Patient_ID FROM obs",
    "union_batches": f"""{HALVES} SELECT event_id, Patient_ID, ICULOS, HR, CASE WHEN side = 'test' THEN Temp END AS "Temp" FROM sides""",
    "column_symmetric_diff": """SELECT event_id, array_to_string(list_sort(d), ',') AS unexpected FROM (SELECT event_id, list_concat(
        list_filter(['HR', 'Temp', 'MAP', 'view'], lambda x: NOT list_contains(given, x)),
        list_filter(list_distinct(given), lambda x: NOT list_contains(['HR', 'Temp', 'MAP', 'view'], x))) AS d
        FROM (SELECT event_id, list_filter(['HR', CASE WHEN event_id % 2 = 0 THEN 'Temp' END, CASE WHEN event_id % 3 = 0 THEN 'MAP' END, event_type],
        lambda x: x IS NOT NULL) AS given FROM events)) WHERE len(d) > 0""",
    "distinct_set_diff": """SELECT user_id, coalesce(list_sort(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0)), []) <>
        coalesce(list_sort(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 1)), []) AS differ FROM events GROUP BY user_id""",
    "group_split": f"{WITH}, {sides('obs', 'Patient_ID', 'split', 0.25)} SELECT Patient_ID, ICULOS, side FROM sides",
    "row_split": f"{WITH}, {sides('obs', 'event_id', '42', 0.2)} SELECT event_id, SepsisLabel, side FROM sides",
    "undersample_2to1": f"""{WITH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY SepsisLabel ORDER BY md5(concat('undersample|', event_id))) AS r FROM obs)
        SELECT event_id, Patient_ID, ICULOS, SepsisLabel FROM ranked
        WHERE SepsisLabel = 1 OR r <= 2 * (SELECT count(*) FROM obs WHERE SepsisLabel = 1)""",
    "stratified_sample": f"""{WITH}, classes AS (SELECT SepsisLabel, count(*) AS n, floor(sum(count(*)) OVER () * cast(0.25 AS double)) AS draws,
        sum(count(*)) OVER () AS total FROM obs GROUP BY SepsisLabel),
        exact AS (SELECT *, n * draws / cast(total AS double) AS e FROM classes),
        quotas AS (SELECT SepsisLabel, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, SepsisLabel) <= draws - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS q FROM exact),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY SepsisLabel ORDER BY md5(concat('strata|', event_id))) AS r FROM obs)
        SELECT event_id, SepsisLabel FROM ranked JOIN quotas USING (SepsisLabel) WHERE r <= q""",
    "kfold_assignment": f"""{WITH} SELECT event_id, SepsisLabel, cast((row_number() OVER (PARTITION BY SepsisLabel ORDER BY md5(concat('folds|', event_id))) - 1) % 5 AS integer) AS fold FROM obs""",
    "kfold_sizes": f"""{WITH} SELECT SepsisLabel, fold, count(*) AS n FROM (SELECT SepsisLabel,
        cast((row_number() OVER (PARTITION BY SepsisLabel ORDER BY md5(concat('folds|', event_id))) - 1) % 5 AS integer) AS fold FROM obs) GROUP BY 1, 2""",
    "running_positives": f"{RUNNING} SELECT Patient_ID, count_of_0, count_of_1, position, cumulative_count_of_1 FROM ordered",
    "cohort_by_threshold": f"{RUNNING} SELECT Patient_ID, count_of_1, cohort FROM cohorts",
    "cohort_batches": f"""{RUNNING} SELECT event_id, Patient_ID, cast(ntile(3) OVER (ORDER BY md5(concat('parts|', event_id))) AS integer) AS part
        FROM obs WHERE Patient_ID IN (SELECT Patient_ID FROM cohorts WHERE cohort = 2)""",
    "ntile_batches": "SELECT event_id, cast(ntile(3) OVER (ORDER BY md5(concat('parts|', event_id))) AS integer) AS part FROM events",
    "chunk_500": "SELECT event_id, cast(floor((row_number() OVER (ORDER BY event_id) - 1) / 500) AS bigint) AS chunk FROM events",
    "ordered_quota": f"""{WITH}, ranked AS (SELECT Patient_ID, row_number() OVER (ORDER BY Patient_ID) AS r FROM (SELECT DISTINCT Patient_ID FROM obs))
        SELECT Patient_ID, CASE WHEN r <= 18 THEN 'train' ELSE 'test' END AS destination FROM ranked WHERE r <= 24""",
    "quota_distribution": f"""{WITH}, ranked AS (SELECT Patient_ID, row_number() OVER (ORDER BY Patient_ID) AS r FROM (SELECT DISTINCT Patient_ID FROM obs))
        SELECT Patient_ID, CASE WHEN r <= 60 THEN 'initial' WHEN r <= 72 THEN 'batch-1' WHEN r <= 84 THEN 'batch-2' WHEN r <= 96 THEN 'batch-3' ELSE 'client' END AS destination FROM ranked""",
    "schema_findings": f"""{WITH}, want AS (SELECT * FROM (VALUES {", ".join(f"('{c}', 'float64')" for c in [
        "O2Sat", "SBP", "DBP", "Resp", "EtCO2", "BaseExcess", "HCO3", "FiO2", "pH", "PaCO2", "SaO2", "Alkalinephos", "Calcium", "Chloride",
        "Creatinine", "Bilirubin_direct", "Glucose", "Lactate", "Magnesium", "Phosphate", "Potassium", "Bilirubin_total", "TroponinI", "Hgb",
        "PTT", "Fibrinogen", "Platelets"])}) v(column_name, expected))
        SELECT 'missing_column' AS rule, column_name, 'error' AS severity, expected, cast(NULL AS varchar) AS observed, (SELECT count(*) FROM obs) AS n_rows FROM want
        UNION ALL SELECT 'wrong_type', 'Gender', 'error', 'int64', 'float64', (SELECT count(*) FROM obs)
        UNION ALL SELECT 'wrong_type', 'Age', 'error', 'float64 or int64', 'object', (SELECT count(*) FROM obs)""",
    "stat_findings": f"""{HALVES}, new AS (SELECT * REPLACE (Temp + 200 AS Temp, BUN - 5 AS BUN) FROM sides WHERE side = 'test'),
        recorded AS ({profile([*VALUES, "Age", "HospAdmTime"], "sides", "WHERE side = 'train'")}),
        observed AS ({profile([*VALUES, "Age", "HospAdmTime"], "new")}) {stat_checks()}""",
    "null_rate_findings": f"""{HALVES}, recorded AS ({profile(VALUES, "sides", "WHERE side = 'train'")}),
        observed AS ({profile(VALUES, "sides", "WHERE side = 'test'")}) SELECT * FROM ({stat_checks("null_rate")}) WHERE rule = 'null_rate'""",
    "value_findings": f"""WITH {sides("documents", "doc_id", "42", 0.5)},
        old AS ({union(["lang", "source"], "SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM sides WHERE side = 'train' AND {c} IS NOT NULL")}),
        new AS (SELECT DISTINCT 'lang' AS column_name, CASE WHEN lang = 'en' THEN 'xx' ELSE lang END AS value FROM sides WHERE side = 'test' AND lang IS NOT NULL
        UNION ALL SELECT DISTINCT 'source', source FROM sides WHERE side = 'test' AND source IS NOT NULL),
        diff AS ((SELECT * FROM old EXCEPT SELECT * FROM new) UNION ALL (SELECT * FROM new EXCEPT SELECT * FROM old))
        SELECT 'unique_values' AS rule, column_name, 'warning' AS severity, cast((SELECT count(*) FROM old o WHERE o.column_name = d.column_name) AS double) AS expected,
        cast((SELECT count(*) FROM new n WHERE n.column_name = d.column_name) AS double) AS observed FROM (SELECT DISTINCT column_name FROM diff) d""",
    "null_key_findings": """SELECT 'null_key' AS rule, 'Patient_ID' AS column_name, 'error' AS severity, cast(0 AS double) AS expected,
        cast(count(*) AS double) AS observed FROM events WHERE event_id % 100 = 0 HAVING count(*) > 0""",
    "request_anomaly": """WITH r AS (SELECT avg(value) AS m, stddev_samp(value) AS s, avg(value - 25) AS tm, stddev_samp(value - 25) AS ts FROM events WHERE event_type <> 'signup'),
        o AS (SELECT avg(value) AS m, stddev_samp(value) AS s, avg(value - 25) AS tm, stddev_samp(value - 25) AS ts FROM events WHERE event_type = 'signup'),
        p AS (SELECT 'HR' AS column_name, abs(100 * (r.m - 9 * o.m)) / r.m AS a, abs(100 * (r.s - 9 * o.s)) / r.s AS b FROM r, o
        UNION ALL SELECT 'Temp', abs(100 * (r.tm - o.tm)) / abs(r.tm), abs(100 * (r.ts - o.ts)) / r.ts FROM r, o
        UNION ALL SELECT 'HospAdmTime', abs(100 * (o.m - r.m)) / r.m, abs(100 * (r.s - o.s)) / r.s FROM r, o)
        SELECT column_name, round(a, 6) AS mean_percent, round(b, 6) AS std_percent FROM p WHERE a > 300 OR b > 300""",
    "request_anomaly_by_request": """WITH r AS (SELECT avg(value) AS m, stddev_samp(value) AS s, avg(value - 25) AS tm FROM events),
        o AS (SELECT cast(user_id AS varchar) AS request, CASE WHEN user_id % 3 = 0 THEN 9 ELSE 1 END AS unit, avg(value) AS m, stddev_samp(value) AS s, avg(value - 25) AS tm FROM events GROUP BY user_id),
        p AS (SELECT request, 'HR' AS column_name, abs(100 * (r.m - unit * o.m)) / abs(r.m) AS a, abs(100 * (r.s - unit * o.s)) / r.s AS b FROM r, o
        UNION ALL SELECT request, 'Temp', abs(100 * (r.tm - o.tm)) / abs(r.tm), abs(100 * (r.s - o.s)) / r.s FROM r, o
        UNION ALL SELECT request, 'HospAdmTime', abs(100 * (r.m - o.m)) / abs(r.m), abs(100 * (r.s - o.s)) / r.s FROM r, o)
        SELECT request, column_name, round(a, 6) AS mean_percent, round(b, 6) AS std_percent FROM p WHERE a > 300 OR b > 300""",
    "model_drift_decision": f"""{HALVES}, {SCORED.replace("FROM obs", "FROM sides")}, recalls AS (SELECT Gender,
        round(avg(CASE WHEN side = 'train' THEN cast(SepsisLabel = prediction AS integer) END), 6) AS old_recall,
        round(avg(CASE WHEN side = 'test' THEN cast(SepsisLabel = prediction AS integer) END), 6) AS new_recall FROM scored GROUP BY Gender)
        SELECT Gender, old_recall, new_recall, round(100 * (old_recall - new_recall) / old_recall, 6) AS recall_change,
        CASE WHEN 100 * (old_recall - new_recall) / old_recall > 5 THEN 'retrain' WHEN 100 * (old_recall - new_recall) / old_recall > 3 THEN 'warn' ELSE 'keep' END AS decision FROM recalls""",
    "next_step": f"""{HALVES}, recorded AS ({profile(NUMERIC, "sides", "WHERE side = 'train'")}),
        observed AS ({profile(NUMERIC, "sides", "WHERE side = 'test'")}), findings AS (SELECT severity FROM ({stat_checks()})
        UNION ALL SELECT 'error' FROM sides WHERE side = 'test' AND event_id % 100 = 0 HAVING count(*) > 0)
        SELECT count(*) AS findings, count(*) FILTER (WHERE severity = 'error') AS blocking,
        CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'alert' ELSE 'score_batch' END AS action FROM findings""",
    "next_batch": """SELECT concat('batch-', n) AS batch, n AS number, concat('batch-', n + 1) AS next_batch,
        CASE WHEN n > 3 THEN 'stop' ELSE 'run' END AS state FROM (SELECT DISTINCT user_id % 5 + 1 AS n FROM events)""",
    "confusion_matrix": f"WITH {confusion('labels', 'quality', 'toxic')} SELECT y_true, y_pred, n FROM cells",
    "accuracy": f"{WITH}, {SCORED} SELECT round(avg(CASE WHEN SepsisLabel = prediction THEN 1 ELSE 0 END), 6) AS accuracy FROM scored",
    "weighted_metrics": f"""WITH {confusion('labels', 'quality', 'toxic')} SELECT round(cast(sum(hits) AS double) / sum(support), 6) AS accuracy,
        round(sum(prec * support) / sum(support), 6) AS precision, round(sum(rec * support) / sum(support), 6) AS recall,
        round(sum(f1 * support) / sum(support), 6) AS f1_score FROM per_class""",
    "binary_f1": f"""{WITH}, {SCORED}, {confusion('scored', 'SepsisLabel', 'prediction')}
        SELECT round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1_score FROM per_class WHERE label = 1""",
    "classification_report": f"""{WITH}, {SCORED}, {confusion('scored', 'SepsisLabel', 'prediction')}
        SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, cast(s AS bigint) AS support FROM (
        SELECT cast(label AS varchar) AS label, prec AS p, rec AS r, f1 AS f, support AS s FROM per_class
        UNION ALL SELECT 'accuracy', sum(hits) / cast(sum(support) AS double), sum(hits) / cast(sum(support) AS double), sum(hits) / cast(sum(support) AS double), sum(support) FROM per_class
        UNION ALL SELECT 'macro avg', avg(prec), avg(rec), avg(f1), sum(support) FROM per_class
        UNION ALL SELECT 'weighted avg', sum(prec * support) / sum(support), sum(rec * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM per_class)""",
    "roc_points": f"""{WITH}, {SCORED}, by_score AS (SELECT score, sum(SepsisLabel) AS p, sum(1 - SepsisLabel) AS n FROM scored GROUP BY score)
        SELECT score AS threshold, round(sum(n) OVER (ORDER BY score DESC) / cast(sum(n) OVER () AS double), 6) AS fpr,
        round(sum(p) OVER (ORDER BY score DESC) / cast(sum(p) OVER () AS double), 6) AS tpr FROM by_score
        UNION ALL SELECT NULL, 0, 0""",
    "roc_auc": f"""{WITH}, {SCORED}, ranked AS (SELECT SepsisLabel, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)
        SELECT round((sum(CASE WHEN SepsisLabel = 1 THEN r END) - sum(SepsisLabel) * (sum(SepsisLabel) + 1) / 2.0)
        / (cast(sum(SepsisLabel) AS double) * sum(1 - SepsisLabel)), 6) AS auc FROM ranked""",
    "patient_verdict": f"{WITH}, {SCORED} SELECT Patient_ID, max(prediction) AS prediction FROM scored GROUP BY Patient_ID",
    "scoring_log": f"""WITH {LOG} SELECT request, n_input_rows, timestamp, round(total_latency, 6) AS total_latency,
        round(average_latency_per_row, 6) AS average_latency_per_row FROM log""",
    "latency_summary": f"""WITH {LOG} SELECT count(*) AS requests, cast(sum(n_input_rows) AS bigint) AS rows, round(sum(total_latency), 6) AS total_latency,
        round(max(total_latency), 6) AS max_latency, round(sum(total_latency) / sum(n_input_rows), 6) AS average_latency_per_row FROM log""",
    "grid_pivot": f"""WITH {GRID} SELECT max_depth, n_estimators, """
    + ", ".join(f"round(avg(score) FILTER (WHERE learning_rate = '{v}'), 6) AS {n}" for v, n in [("0.01", "rate_001"), ("0.1", "rate_01"), ("0.2", "rate_02")])
    + " FROM grid GROUP BY max_depth, n_estimators",
    "best_candidate": f"""WITH {GRID}, means AS (SELECT model, round(avg(score), 6) AS score FROM grid GROUP BY model)
        SELECT model, score FROM means ORDER BY score DESC, model LIMIT 1""",
    "prediction_histogram": f"""{WITH}, {SCORED}, ends AS (SELECT min(score) AS lo, (max(score) - min(score)) / 10 AS w FROM scored),
        bins AS (SELECT least(floor((score - lo) / w), 9) AS b FROM scored, ends)
        SELECT cast(i AS integer) AS bin, round(lo + w * i, 6) AS lower, (SELECT count(*) FROM bins WHERE b = i) AS n FROM range(10) t(i), ends""",
    "linear_contributions": f"{PREP} SELECT event_id, "
    + ", ".join(f"round({b} * ({c} - (SELECT avg({c}) FROM prep)), 6) AS {c}" for c, b in COEFFICIENTS.items()) + " FROM prep",
    "mean_abs_contribution": f"{PREP} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs({b} * ({c} - (SELECT avg({c}) FROM prep)))), 6) AS importance FROM prep" for c, b in COEFFICIENTS.items()),
}

ORACLES.update(
    {
        "request_rejects": """SELECT doc_id AS request, CASE doc_id % 4 WHEN 0 THEN 'no JSON payload' WHEN 1 THEN '''data'' field is missing'
        WHEN 2 THEN '''columns'' field is missing' ELSE 'invalid input shape' END AS reason FROM documents""",
        "profile_saved": "SELECT column_name, dtype, min, max, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, null_count, n_rows FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{k}' AS dtype, cast(min({c}) AS double) AS min, cast(max({c}) AS double) AS max, avg({c}) AS mean, "
            f"cast(median({c}) AS double) AS median, stddev_samp({c}) AS std, count(*) - count({c}) AS null_count, count(*) AS n_rows FROM lineitem"
            for c, k in [("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"), ("l_linenumber", "int32"),
                         ("l_quantity", "float64"), ("l_extendedprice", "float64"), ("l_discount", "float64"), ("l_tax", "float64")]
        )
        + ")",
        "versioned_merge": f"{HALVES} SELECT side, count(*) AS n, 'merged' AS version FROM sides GROUP BY side "
        "UNION ALL SELECT side, count(*) AS n, 'reverted' AS version FROM sides WHERE side = 'train' GROUP BY side",
        "stream_ingest": "SELECT * FROM events",
        "stream_latency_window": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS requests, count(*) AS rows,
        round(sum(value), 6) AS total_latency, round(max(value), 6) AS max_latency FROM events GROUP BY date_trunc('day', ts)
        HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    }
)

SHIFTS = {
    "HR": 0, "O2Sat": 1, "Temp": 2, "MAP": 4, "Resp": 6, "BUN": 15, "Chloride": 18, "Creatinine": 19, "Glucose": 21,
    "Hct": 28, "Hgb": 29, "WBC": 31, "Platelets": 33,
}
LOGS = ["MAP", "BUN", "Creatinine", "Glucose", "WBC", "Platelets"]
RAW = (
    WITH
    + ", raw AS (SELECT o.event_id, Patient_ID, ICULOS, Age, Gender, Unit1, Unit2, HospAdmTime, SepsisLabel, "
    + ", ".join(f"CASE WHEN (o.event_id + {i}) % 3 = 0 THEN round(value + {i}, 2) END AS {c}" for c, i in SHIFTS.items())
    + " FROM obs o JOIN events e USING (event_id))"
)

ALL_RAW = (
    WITH
    + ", raw AS (SELECT Patient_ID, ICULOS, Age, Gender, Unit1, Unit2, HospAdmTime, SepsisLabel, "
    + ", ".join(f'CASE WHEN (o.event_id + {i}) % 3 = 0 THEN round(value + {i}, 2) END AS "{c}"' for i, c in enumerate(S.MEASUREMENTS))
    + " FROM obs o JOIN events e USING (event_id))"
)

ORACLES.update(
    {
        "last_rows": f"{WITH} SELECT Patient_ID, ICULOS, HR, SepsisLabel FROM obs ORDER BY Patient_ID DESC, ICULOS DESC LIMIT 1000",
        "prepare_all_columns": RAW
        + ", filled AS (SELECT event_id, Age, Gender, HospAdmTime, ICULOS, " + each(SHIFTS, FILL) + " FROM raw) SELECT event_id, "
        + ", ".join(f"round({f'ln(1 + {c})' if c in LOGS else c}, 6) AS {c}" for c in SHIFTS)
        + """, Age, HospAdmTime, ICULOS, cast(CASE WHEN Gender = 0 THEN 1 ELSE 0 END AS integer) AS "F",
        cast(CASE WHEN Gender = 1 THEN 1 ELSE 0 END AS integer) AS "M" FROM filled WHERE """
        + each(SHIFTS, "{c} IS NOT NULL", " AND "),
        "merged_csv": f"{ALL_RAW} SELECT * FROM raw",
        "request_parse": f"{ALL_RAW} SELECT * EXCLUDE (SepsisLabel) FROM raw",
        "cohort_files": f"""{RUNNING} SELECT cohort, count(*) AS n, count(DISTINCT obs.Patient_ID) AS patients
        FROM obs JOIN cohorts USING (Patient_ID) GROUP BY cohort""",
        "appended_log": f"WITH {LOG} SELECT request, n_input_rows, round(total_latency, 6) AS total_latency FROM log",
        "stream_score": f"{RAW} SELECT Patient_ID AS request, count(*) AS n_input_rows FROM raw GROUP BY Patient_ID",
        "patient_split_training": "SELECT false AS left_in_right, false AS right_in_left, cast(0 AS bigint) AS shared_keys",
    }
)

DRIFT = f"""WITH recorded AS ({profile(["event_id", "user_id", "value"], "events", "WHERE event_type = 'error'")}),
    observed AS ({profile(["event_id", "user_id", "value"], "events")}), findings AS ({stat_checks()})
    SELECT rule, column_name, severity, cast(expected AS varchar) AS expected, cast(observed AS varchar) AS observed FROM findings
    UNION ALL SELECT 'null_key', 'Patient_ID', 'error', '0.0', cast(cast(count(*) AS double) AS varchar) FROM events
    WHERE event_id % 100 = 0 HAVING count(*) > 0 """ + " ".join(
    f"""UNION ALL SELECT 'unique_values', '{c}', 'warning', cast(cast(count(DISTINCT {c}) FILTER (WHERE event_type = 'error') AS double) AS varchar),
    cast(cast(count(DISTINCT {c}) AS double) AS varchar) FROM events
    HAVING count(DISTINCT {c}) > count(DISTINCT {c}) FILTER (WHERE event_type = 'error')"""
    for c in ("event_type", "props")
)

ORACLES.update(
    {
        "alert_text": f"""{HALVES}, recorded AS ({profile(NUMERIC, "sides", "WHERE side = 'train'")}),
        observed AS ({profile(NUMERIC, "sides", "WHERE side = 'test'")}), findings AS ({stat_checks()})
        SELECT rule, column_name, concat('Validation of schema and statistics failed [monitor] ', severity, ': column ', column_name,
        ', rule ', rule, ', expected ', cast(expected AS varchar), ', observed ', cast(observed AS varchar)) AS message FROM findings""",
        "stream_drift": DRIFT,
        "stream_drift_files": DRIFT,
    }
)

REQUESTED = [*S.MEASUREMENTS, "Age", "Gender", "Unit1", "Unit2", "HospAdmTime", "ICULOS"]
QUOTED = [f'"{c}"' for c in REQUESTED]

ORACLES.update(
    {
        "request_log": f"{ALL_RAW} SELECT * EXCLUDE (SepsisLabel) FROM raw",
        "request_log_monitor": f"""{ALL_RAW}, {sides("raw", "Patient_ID", "split", 0.5)},
        recorded AS ({profile(QUOTED, "sides", "WHERE side = 'train'")}), observed AS ({profile(QUOTED, "sides", "WHERE side = 'test'")}),
        findings AS ({stat_checks()}) SELECT rule, replace(column_name, '"', '') AS column_name, severity, expected FROM findings""",
    }
)

ACCEPTED = ALL_RAW.replace("SELECT Patient_ID", "SELECT o.event_id, Patient_ID", 1)
SURVIVING = (
    RAW + ", filled AS (SELECT event_id, Patient_ID, SepsisLabel, Gender, Age, HospAdmTime, ICULOS, " + each(SHIFTS, FILL) + " FROM raw), "
    "kept AS (SELECT *, " + each(SHIFTS, "{c} IS NOT NULL", " AND ") + " AS known FROM filled)"
)
NUMBER = "cast(substr(Patient_ID, 2) AS bigint)"

ORACLES.update(
    {
        "delimited_ingest": f"{ACCEPTED} SELECT * EXCLUDE (event_id) FROM raw WHERE event_id % 100 NOT IN (0, 50, 75)",
        "delimited_batch": f"{ACCEPTED} SELECT * EXCLUDE (event_id) FROM raw WHERE event_id % 100 NOT IN (0, 50, 75) AND {NUMBER} % 3 = 1",
        "delimited_rejects": f"""{WITH} SELECT Patient_ID, cast(CASE event_id % 100 WHEN 0 THEN 2 WHEN 50 THEN 41 ELSE 42 END AS bigint) AS n_fields,
        count(*) AS n FROM obs WHERE event_id % 100 IN (0, 50, 75) GROUP BY ALL""",
        "stream_outcomes": f"""{SURVIVING} SELECT Patient_ID AS request, 'accepted' AS outcome, count(*) AS n_rows,
        count(*) FILTER (WHERE known) AS n_predicted, count(*) FILTER (WHERE NOT known) AS n_not_predicted
        FROM kept WHERE {NUMBER} % 10 > 0 GROUP BY Patient_ID
        UNION ALL SELECT DISTINCT Patient_ID, '''columns'' field is missing', 0, 0, 0 FROM kept WHERE {NUMBER} % 10 = 0""",
        "batch_score_rows": PREP.replace(WITH, HALVES, 1).replace("FROM obs), prep", "FROM sides WHERE side = 'test'), prep", 1)
        + " SELECT event_id, Patient_ID, SepsisLabel, true AS predicted FROM prep",
        "model_contributions": f"""{PREP}, ranked AS (SELECT *, row_number() OVER (PARTITION BY SepsisLabel ORDER BY md5(concat('undersample|', event_id))) AS r FROM prep),
        balanced AS (SELECT event_id FROM ranked WHERE SepsisLabel = 1 OR r <= 2 * (SELECT count(*) FROM prep WHERE SepsisLabel = 1)),
        {sides("balanced", "event_id", "42", 0.2)} SELECT event_id, true AS adds_up FROM sides WHERE side = 'train'""",
        "patient_split_rows": f"""{PREP}, ranked AS (SELECT *, row_number() OVER (PARTITION BY SepsisLabel ORDER BY md5(concat('undersample|', event_id))) AS r FROM prep),
        balanced AS (SELECT event_id, Patient_ID, SepsisLabel FROM ranked WHERE SepsisLabel = 1 OR r <= 2 * (SELECT count(*) FROM prep WHERE SepsisLabel = 1)),
        {sides("balanced", "Patient_ID", "42", 0.2)} SELECT event_id, Patient_ID, SepsisLabel, side FROM sides""",
        "batch_retrain": f"""{WITH}, {sides("obs", "Patient_ID", "split", 0.2)}, ends AS (SELECT count(*) AS n, sum(SepsisLabel) AS p FROM sides WHERE side = 'train'),
        news AS (SELECT count(*) AS n, count(*) - sum(SepsisLabel) AS p FROM sides WHERE side = 'test')
        SELECT 'first run' AS step, n AS n_rows, cast(p AS bigint) AS positives FROM ends UNION ALL SELECT 'reverted', n, cast(p AS bigint) FROM ends
        UNION ALL SELECT 'retrain, model-run-20240102-000000, then batch-2', e.n + w.n, cast(e.p + w.p AS bigint) FROM ends e, news w""",
    }
)
