"""Registered maintenance queries: upsert, remap, deletes, inserts, updates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from starledger.operators import maintenance as mt
from starledger.plans import fixtures as fx
from starledger.plans.registry import register
from starledger.sources.tables import read_table

M1 = fx.orders_star_cte()
M2 = fx.lineitem_star_cte()
Y = fx.REPORT_YEAR
YR = f"incident_date >= DATE '{Y}-01-01' AND incident_date < DATE '{Y + 1}-01-01'"
PUBLIC = "id, student_no, first_name, last_name, grade, section, adviser, status"
AS_OF = "2001-12-31"


# --------------------------------------------------------------------------- G1
def _catalog_updates(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    code = F.format_string("P-%05d", k)
    u1 = p.filter(k % 5 == 0).select(
        code.alias("code"), F.upper("p_name").alias("name"),
        F.when(size >= 26, "Minor").otherwise("Major").alias("category"),
        (F.lit(1) + (size + 3) % 10).cast("int").alias("severity_points"),
        F.lit("Revised").alias("recommended_action"), (k * 2).alias("ord"))
    u2 = p.filter(k % 10 == 0).select(
        code.alias("code"), F.concat(F.lit("Second "), F.col("p_name")).alias("name"), F.lit("Major").alias("category"),
        F.lit(5).cast("int").alias("severity_points"), F.lit("Revised twice").alias("recommended_action"),
        (k * 2 + 1).alias("ord"))
    u3 = p.filter(k % 50 == 0).select(
        F.format_string("N-%05d", k).alias("code"), F.concat(F.lit("New "), F.col("p_name")).alias("name"),
        F.lit("Minor").alias("category"), F.lit(1).cast("int").alias("severity_points"),
        F.lit("Added").alias("recommended_action"), (F.lit(1_000_000_000) + k).alias("ord"))
    return u1.unionByName(u2).unionByName(u3)


UPSERT_SQL = f"""{M2},
u0 AS (SELECT printf('P-%05d', p_partkey) AS code, upper(p_name) AS name,
              CASE WHEN p_size >= 26 THEN 'Minor' ELSE 'Major' END AS category,
              CAST(1 + (p_size + 3) % 10 AS INTEGER) AS severity_points, 'Revised' AS recommended_action, p_partkey * 2 AS ord
       FROM part WHERE p_partkey % 5 = 0
       UNION ALL SELECT printf('P-%05d', p_partkey), 'Second ' || p_name, 'Major', CAST(5 AS INTEGER), 'Revised twice', p_partkey * 2 + 1
       FROM part WHERE p_partkey % 10 = 0
       UNION ALL SELECT printf('N-%05d', p_partkey), 'New ' || p_name, 'Minor', CAST(1 AS INTEGER), 'Added', 1000000000 + p_partkey
       FROM part WHERE p_partkey % 50 = 0),
u AS (SELECT * FROM u0 QUALIFY ROW_NUMBER() OVER (PARTITION BY code ORDER BY ord DESC) = 1)
SELECT c.id, c.code,
       CASE WHEN u.code IS NOT NULL THEN u.name ELSE c.name END AS name,
       CASE WHEN u.code IS NOT NULL THEN u.category ELSE c.category END AS category,
       CASE WHEN u.code IS NOT NULL THEN u.severity_points ELSE c.severity_points END AS severity_points,
       CASE WHEN u.code IS NOT NULL THEN u.recommended_action ELSE c.recommended_action END AS recommended_action,
       CASE WHEN u.code IS NOT NULL THEN TRUE ELSE c.active END AS active
FROM cat c LEFT JOIN u ON u.code = c.code
UNION ALL
SELECT CAST((SELECT MAX(id) FROM cat) + ROW_NUMBER() OVER (ORDER BY ord) AS BIGINT), code, name, category,
       severity_points, recommended_action, TRUE
FROM u WHERE code NOT IN (SELECT code FROM cat)"""


@register("upsert_catalog", UPSERT_SQL)
def q_upsert_catalog(spark, sf_dir):
    cat = fx.part_catalog(spark, sf_dir)
    return mt.upsert(cat, _catalog_updates(spark, sf_dir), "code",
                     ["name", "category", "severity_points", "recommended_action"], "ord",
                     on_update={"active": F.lit(True)})


# --------------------------------------------------------------------------- G2
REMAP_CTE = f"""{M2},
m AS (SELECT printf('P-%05d', p_partkey) AS old_code, printf('P-%05d', p_partkey + 1) AS new_code FROM part WHERE p_size % 7 = 0),
pr AS (SELECT o.id AS old_id, n.id AS new_id FROM m JOIN cat o ON o.code = m.old_code JOIN cat n ON n.code = m.new_code)"""


def _remap(spark, sf_dir):
    st = fx.lineitem_star(spark, sf_dir)
    p = read_table(spark, sf_dir, "part").filter(F.col("p_size") % 7 == 0)
    mapping = p.select(F.format_string("P-%05d", "p_partkey").alias("old_code"),
                       F.format_string("P-%05d", F.col("p_partkey") + 1).alias("new_code"))
    return mt.remap_keys(st.fact, st.catalog, mapping)


@register("remap_keys", f"""{REMAP_CTE}
SELECT f.id, f.incident_no, f.incident_date, f.student_id, COALESCE(pr.new_id, f.offense_id) AS offense_id,
       f.action_taken, f.status, f.reported_by, f.notes
FROM fact f LEFT JOIN pr ON pr.old_id = f.offense_id""")
def q_remap_keys(spark, sf_dir):
    return _remap(spark, sf_dir).fact


@register("remap_catalog", f"{REMAP_CTE} SELECT * FROM cat WHERE id NOT IN (SELECT old_id FROM pr)")
def q_remap_catalog(spark, sf_dir):
    return _remap(spark, sf_dir).catalog


# --------------------------------------------------------------------------- G3 / C8 / E9
def _inactive_keys(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"))


def _guard(spark, sf_dir, keys=None):
    st = fx.orders_star(spark, sf_dir)
    child = st.fact
    keys = _inactive_keys(spark, sf_dir) if keys is None else keys
    return mt.guarded_delete(st.subject, child, keys, "id", "student_id",
                             ["student_no", "first_name", "last_name"])


GUARD_CTE = f"""{M1}, ch AS (SELECT * FROM fact),
k AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal < 0),
miss AS (SELECT id FROM k WHERE id NOT IN (SELECT id FROM subj)),
prot AS (SELECT s.id, s.student_no, s.first_name, s.last_name, COUNT(*) AS incident_count
         FROM subj s JOIN ch ON ch.student_id = s.id WHERE s.id IN (SELECT id FROM k)
         GROUP BY s.id, s.student_no, s.first_name, s.last_name)"""


@register("guarded_delete", f"""{GUARD_CTE}
SELECT {PUBLIC} FROM subj
WHERE id NOT IN (SELECT id FROM k) OR EXISTS (SELECT 1 FROM miss) OR EXISTS (SELECT 1 FROM prot)""")
def q_guarded_delete(spark, sf_dir):
    return _guard(spark, sf_dir).snapshot


@register("guarded_delete_ok", f"""{M1}, ch AS (SELECT * FROM fact),
k AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT student_id FROM ch)),
miss AS (SELECT id FROM k WHERE id NOT IN (SELECT id FROM subj)),
prot AS (SELECT s.id FROM subj s JOIN ch ON ch.student_id = s.id WHERE s.id IN (SELECT id FROM k))
SELECT {PUBLIC} FROM subj
WHERE id NOT IN (SELECT id FROM k) OR EXISTS (SELECT 1 FROM miss) OR EXISTS (SELECT 1 FROM prot)""")
def q_guarded_delete_ok(spark, sf_dir):
    st = fx.orders_star(spark, sf_dir)
    child = st.fact.select(F.col("student_id").alias("id"))
    keys = _inactive_keys(spark, sf_dir).join(child, "id", "left_anti")
    return _guard(spark, sf_dir, keys).snapshot


@register("protected_parents", f"{GUARD_CTE} SELECT * FROM prot")
def q_protected_parents(spark, sf_dir):
    return _guard(spark, sf_dir).protected


@register("protected_preview", f"""{GUARD_CTE},
h AS (SELECT id, first_name, last_name, first_name || ' ' || last_name || ' (' || student_no || ')' AS label
      FROM prot ORDER BY last_name, first_name, id LIMIT 3),
n AS (SELECT COUNT(*) AS c FROM prot)
SELECT n.c AS protected_count,
       CASE WHEN n.c = 1 THEN printf('%d selected student has', n.c) ELSE printf('%d selected students have', n.c) END
       || ' incident records and cannot be deleted: '
       || (SELECT string_agg(label, ', ' ORDER BY last_name, first_name, id) FROM h)
       || CASE WHEN n.c > 3 THEN printf(', and %d more', n.c - 3) ELSE '' END
       || '. No students were deleted' AS message
FROM n WHERE n.c > 0""")
def q_protected_preview(spark, sf_dir):
    prot = _guard(spark, sf_dir).protected
    label = F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"), F.lit(" ("), F.col("student_no"), F.lit(")"))
    return mt.protected_preview(prot, label, [F.col("last_name"), F.col("first_name"), F.col("id")], "student")


# --------------------------------------------------------------------------- C7 / G4 / G5
def _probe_keys(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("id"))


PROBE = "SELECT DISTINCT l_orderkey * 2 AS id FROM lineitem"


@register("missing_keys", f"{M1} SELECT id FROM ({PROBE}) k WHERE id NOT IN (SELECT id FROM fact)")
def q_missing_keys(spark, sf_dir):
    from starledger.operators.joins import missing_keys
    return missing_keys(_probe_keys(spark, sf_dir), fx.order_facts(spark, sf_dir))


FACT_COLS = "id, incident_no, incident_date, student_id, offense_id, action_taken, status, reported_by, notes"


@register("delete_keys", f"""{M1}, k AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
SELECT {FACT_COLS} FROM fact WHERE id NOT IN (SELECT id FROM k)
   OR EXISTS (SELECT 1 FROM k WHERE id NOT IN (SELECT id FROM fact))""")
def q_delete_keys(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    keys = o.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")) \
        .select(F.col("o_orderkey").alias("id"))
    return mt.delete_keys(fx.order_facts(spark, sf_dir), keys).snapshot


@register("delete_keys_rejected", f"""{M1}, k AS ({PROBE})
SELECT {FACT_COLS} FROM fact WHERE id NOT IN (SELECT id FROM k)
   OR EXISTS (SELECT 1 FROM k WHERE id NOT IN (SELECT id FROM fact))""")
def q_delete_keys_rejected(spark, sf_dir):
    return mt.delete_keys(fx.order_facts(spark, sf_dir), _probe_keys(spark, sf_dir)).snapshot


@register("delete_keys_lenient", f"""{M1}, k AS ({PROBE})
SELECT {FACT_COLS} FROM fact WHERE id NOT IN (SELECT id FROM k)""")
def q_delete_keys_lenient(spark, sf_dir):
    return mt.delete_keys(fx.order_facts(spark, sf_dir), _probe_keys(spark, sf_dir), on_missing="ignore").snapshot


# --------------------------------------------------------------------------- G6
def _insert_batch(spark, sf_dir):
    sup = fx.supplier_subjects(spark, sf_dir)
    cus = fx.customer_subjects(spark, sf_dir)
    cols = ["student_no", "first_name", "last_name", "grade", "section", "adviser", "status"]
    b1 = sup.select(*cols, F.col("id").alias("ord"))
    b2 = cus.filter(F.col("id") % 4 == 0).select(*cols, (F.lit(100_000_000) + F.col("id")).alias("ord"))
    b3 = sup.filter(F.col("id") % 3 == 0).select(*cols, (F.lit(200_000_000) + F.col("id")).alias("ord"))
    return b1.unionByName(b2).unionByName(b3)


INSERT_CTE = f"""{M1}, sup AS ({fx.SUPPLIER_SUBJECTS_SQL}),
b AS (SELECT student_no, first_name, last_name, grade, section, adviser, status, id AS ord FROM sup
      UNION ALL SELECT student_no, first_name, last_name, grade, section, adviser, status, 100000000 + id FROM subj WHERE id % 4 = 0
      UNION ALL SELECT student_no, first_name, last_name, grade, section, adviser, status, 200000000 + id FROM sup WHERE id % 3 = 0),
r AS (SELECT b.*, CASE WHEN student_no IN (SELECT student_no FROM subj) THEN 'conflict'
                       WHEN ord <> MIN(ord) OVER (PARTITION BY student_no) THEN 'duplicate in batch' END AS reason FROM b)"""


@register("insert_new", f"""{INSERT_CTE}
SELECT {PUBLIC} FROM subj
UNION ALL
SELECT CAST((SELECT MAX(id) FROM subj) + ROW_NUMBER() OVER (ORDER BY ord) AS BIGINT), student_no, first_name, last_name,
       grade, section, adviser, status FROM r WHERE reason IS NULL""")
def q_insert_new(spark, sf_dir):
    return mt.insert_new(fx.customer_subjects(spark, sf_dir), _insert_batch(spark, sf_dir), "student_no", "ord").snapshot


@register("insert_rejects", f"{INSERT_CTE} SELECT ord, student_no, reason FROM r WHERE reason IS NOT NULL")
def q_insert_rejects(spark, sf_dir):
    return mt.insert_new(fx.customer_subjects(spark, sf_dir), _insert_batch(spark, sf_dir), "student_no", "ord").rejected


# --------------------------------------------------------------------------- G7
def _updates(spark, sf_dir):
    c = fx.customer_subjects(spark, sf_dir)
    k = F.col("id")
    cols = ["student_no", "first_name", "grade", "section", "adviser"]
    flip = F.when(F.col("status") == "Active", "Inactive").otherwise("Active")
    u1 = c.filter(k % 6 == 0).select("id", *cols, F.upper("last_name").alias("last_name"), flip.alias("status"))
    u2 = c.filter(k % 50 == 1).select((k + 1_000_000).alias("id"), *cols, "last_name", "status")
    u3 = c.filter((k % 35 == 0) & (k % 6 != 0)).select(
        "id", F.format_string("Customer#%09d", k + 1).alias("student_no"), *cols[1:], "last_name", "status")
    return u1.unionByName(u2).unionByName(u3)


UPDATE_CTE = f"""{M1},
u AS (SELECT id, student_no, first_name, upper(last_name) AS last_name, grade, section, adviser,
             CASE WHEN status = 'Active' THEN 'Inactive' ELSE 'Active' END AS status FROM subj WHERE id % 6 = 0
      UNION ALL SELECT id + 1000000, student_no, first_name, last_name, grade, section, adviser, status FROM subj WHERE id % 50 = 1
      UNION ALL SELECT id, printf('Customer#%09d', id + 1), first_name, last_name, grade, section, adviser, status
      FROM subj WHERE id % 35 = 0 AND id % 6 <> 0),
r AS (SELECT u.*, CASE WHEN u.id NOT IN (SELECT id FROM subj) THEN 'not found'
                       WHEN COUNT(*) OVER (PARTITION BY u.id) > 1 THEN 'duplicate id'
                       WHEN EXISTS (SELECT 1 FROM subj s WHERE s.student_no = u.student_no AND s.id <> u.id) THEN 'conflict'
                       WHEN COUNT(*) OVER (PARTITION BY u.student_no) > 1 THEN 'conflict' END AS reason FROM u)"""


@register("update_rows", f"""{UPDATE_CTE}
SELECT s.id, COALESCE(r.student_no, s.student_no) AS student_no, COALESCE(r.first_name, s.first_name) AS first_name,
       COALESCE(r.last_name, s.last_name) AS last_name, COALESCE(r.grade, s.grade) AS grade,
       COALESCE(r.section, s.section) AS section, COALESCE(r.adviser, s.adviser) AS adviser,
       COALESCE(r.status, s.status) AS status
FROM subj s LEFT JOIN (SELECT * FROM r WHERE reason IS NULL) r ON r.id = s.id""")
def q_update_rows(spark, sf_dir):
    return mt.update_rows(fx.customer_subjects(spark, sf_dir), _updates(spark, sf_dir),
                          ["student_no", "first_name", "last_name", "grade", "section", "adviser", "status"],
                          unique_key="student_no").snapshot


@register("update_rejects", f"{UPDATE_CTE} SELECT id, reason FROM r WHERE reason IS NOT NULL")
def q_update_rejects(spark, sf_dir):
    return mt.update_rows(fx.customer_subjects(spark, sf_dir), _updates(spark, sf_dir),
                          ["student_no", "first_name", "last_name", "grade", "section", "adviser", "status"],
                          unique_key="student_no").rejected


# --------------------------------------------------------------------------- G8
def _fact_batch(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("ord"),
        F.when(k % 11 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey")).alias("student_id"),
        (F.lit(1) + k % 6).cast("bigint").alias("offense_id"),
        F.when(k % 9 == 0, F.lit(None).cast("date")).otherwise(F.date_add(F.col("o_orderdate").cast("date"), 30))
        .alias("incident_date"),
        F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("Warned")).alias("action_taken"),
        F.lit("Open").alias("status"), F.lit("Batch").alias("reported_by"), F.lit("").alias("notes"))


FACT_BATCH_CTE = f"""{M1},
b AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS student_id,
             CAST(1 + o_orderkey % 6 AS BIGINT) AS offense_id,
             CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 30 END AS incident_date,
             CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Warned' END AS action_taken FROM orders),
r AS (SELECT b.*, o.recommended_action AS da,
             CASE WHEN b.student_id NOT IN (SELECT id FROM subj) THEN 'Student not found'
                  WHEN o.id IS NULL THEN 'Offense not found' END AS reason
      FROM b LEFT JOIN cat o ON o.id = b.offense_id)"""


@register("insert_facts", f"""{FACT_BATCH_CTE},
ok AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ord) AS seq FROM r WHERE reason IS NULL)
SELECT CAST((SELECT MAX(id) FROM fact) + seq AS BIGINT) AS id,
       printf('INC-%05d', (SELECT COALESCE(MAX(CASE WHEN upper(substr(incident_no, 1, 4)) = 'INC-' THEN
              COALESCE(TRY_CAST(regexp_extract(substr(incident_no, 5), '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) END), 0) FROM fact) + seq) AS incident_no,
       COALESCE(incident_date, DATE '{AS_OF}') AS incident_date, student_id, offense_id,
       CASE WHEN action_taken IS NULL OR action_taken = '' THEN da ELSE action_taken END AS action_taken,
       'Open' AS status, 'Batch' AS reported_by, '' AS notes
FROM ok""")
def q_insert_facts(spark, sf_dir):
    st = fx.orders_star(spark, sf_dir)
    return mt.insert_facts(st.fact, st.subject, st.catalog, _fact_batch(spark, sf_dir), "ord", AS_OF).inserted


@register("insert_fact_rejects", f"{FACT_BATCH_CTE} SELECT ord, reason FROM r WHERE reason IS NOT NULL")
def q_insert_fact_rejects(spark, sf_dir):
    st = fx.orders_star(spark, sf_dir)
    return mt.insert_facts(st.fact, st.subject, st.catalog, _fact_batch(spark, sf_dir), "ord", AS_OF).rejected


# --------------------------------------------------------------------------- G7 for facts, timestamps
BORN, NOW = dt.datetime(2020, 1, 1, 8), dt.datetime(2021, 6, 1, 12, 30)
BORN_SQL, NOW_SQL = f"TIMESTAMP '{BORN}'", f"TIMESTAMP '{NOW}'"


def _fact_updates(spark, sf_dir):
    """An update of every fourth fact: some unknown facts, subjects and items, some states out of the domain."""
    b, k = _fact_batch(spark, sf_dir), F.col("ord")
    status = F.when(k % 28 == 0, "Pending").otherwise("Resolved")
    return b.filter(k % 4 == 0).select(F.when(k % 36 == 0, -k).otherwise(k).alias("id"), "incident_date", "student_id", "offense_id", "action_taken",
                                       status.alias("status"), "reported_by", "notes")


FACT_UPDATE_CTE = f"""{FACT_BATCH_CTE.replace("r AS (SELECT b.*", "r0 AS (SELECT b.*")},
u AS (SELECT CASE WHEN ord % 36 = 0 THEN -ord ELSE ord END AS id, incident_date, student_id, offense_id,
             CASE WHEN action_taken = '' THEN da ELSE action_taken END AS action_taken,
             CASE WHEN ord % 28 = 0 THEN 'Pending' ELSE 'Resolved' END AS status, reason AS parent FROM r0 WHERE ord % 4 = 0),
r AS (SELECT u.*, CASE WHEN status = 'Pending' THEN 'status_domain' WHEN id NOT IN (SELECT id FROM fact) THEN 'not found' ELSE parent END AS reason FROM u)"""
UPDATED_FACT = f"""f.id, f.incident_no, CASE WHEN r.id IS NULL THEN f.incident_date ELSE COALESCE(r.incident_date, DATE '{AS_OF}') END AS incident_date,
       COALESCE(r.student_id, f.student_id) AS student_id, COALESCE(r.offense_id, f.offense_id) AS offense_id,
       COALESCE(r.action_taken, f.action_taken) AS action_taken, COALESCE(r.status, f.status) AS status,
       CASE WHEN r.id IS NULL THEN f.reported_by ELSE 'Batch' END AS reported_by, f.notes"""


def _update_facts(spark, sf_dir):
    from starledger.operators.intake import fact_rules
    from starledger.operators.versions import stamps, with_stamps
    st = fx.orders_star(spark, sf_dir)
    return mt.update_facts(with_stamps(st.fact, BORN), st.subject, st.catalog, _fact_updates(spark, sf_dir), AS_OF,
                           rules=fact_rules(), on_update=stamps(NOW)[1])


@register("update_facts", f"""{FACT_UPDATE_CTE}
SELECT {UPDATED_FACT}, {BORN_SQL} AS created_at, CASE WHEN r.id IS NULL THEN {BORN_SQL} ELSE {NOW_SQL} END AS updated_at
FROM fact f LEFT JOIN (SELECT * FROM r WHERE reason IS NULL) r ON r.id = f.id""")
def q_update_facts(spark, sf_dir):
    return _update_facts(spark, sf_dir).snapshot


@register("update_fact_rejects", f"{FACT_UPDATE_CTE} SELECT id, reason FROM r WHERE reason IS NOT NULL")
def q_update_fact_rejects(spark, sf_dir):
    return _update_facts(spark, sf_dir).rejected


# Copy-on-write: the same kinds of writes on a versioned table.
def _versioned_facts(spark, sf_dir):
    from starledger.operators import versions
    return versions.create(versions.with_stamps(fx.order_facts(spark, sf_dir), BORN), "id", 32)


@register("version_update", f"""{M1}
SELECT * REPLACE (CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0) THEN 'Resolved' ELSE status END AS status),
       {BORN_SQL} AS created_at,
       CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0) THEN {NOW_SQL} ELSE {BORN_SQL} END AS updated_at
FROM fact""")
def q_version_update(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") == 50) & (F.col("l_discount") == 0))
    keys = li.select(F.col("l_orderkey").alias("id")).distinct().withColumn("status", F.lit("Resolved"))
    return _versioned_facts(spark, sf_dir).update(keys, ["status"], NOW)[0].rows()


@register("version_delete", f"""{M1}, k AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
SELECT *, {BORN_SQL} AS created_at, {BORN_SQL} AS updated_at FROM fact WHERE id NOT IN (SELECT id FROM k)""")
def q_version_delete(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    keys = o.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select(F.col("o_orderkey").alias("id"))
    return _versioned_facts(spark, sf_dir).delete(keys)[0].rows()


@register("version_upsert", UPSERT_SQL.replace("AS active\nFROM cat c", f"AS active, {BORN_SQL} AS created_at, "
          f"CASE WHEN u.code IS NOT NULL THEN {NOW_SQL} ELSE {BORN_SQL} END AS updated_at\nFROM cat c")
          .replace("recommended_action, TRUE\nFROM u", f"recommended_action, TRUE, {NOW_SQL}, {NOW_SQL}\nFROM u"))
def q_version_upsert(spark, sf_dir):
    from starledger.operators import versions
    cat = versions.create(versions.with_stamps(fx.part_catalog(spark, sf_dir), BORN), "code", 16)
    return cat.upsert(_catalog_updates(spark, sf_dir), ["name", "category", "severity_points", "recommended_action"], "ord", "id", NOW,
                      on_update={"active": F.lit(True)}).rows()


# One person's record by number (B12, R3): the facts lie in buckets of the subject.
@register("record_by_no", f"""{M1}, p AS (SELECT * FROM subj WHERE lower(student_no) = (SELECT lower(min(student_no)) FROM subj WHERE status = 'Active'))
SELECT i.student_id, i.id, i.incident_no, i.incident_date, i.action_taken, i.status, i.reported_by, i.notes,
       o.code AS offense_code, o.name AS offense_name, o.category, o.severity_points
FROM fact i JOIN cat o ON o.id = i.offense_id WHERE i.student_id IN (SELECT id FROM p)""")
def q_record_by_no(spark, sf_dir):
    from starledger.operators import versions
    from starledger.plans import reports
    st = fx.orders_star(spark, sf_dir)
    number = st.subject.filter(F.col("status") == "Active").agg(F.min("student_no").alias("n")).first()["n"]
    facts = versions.create(st.fact, "student_id", 32)
    return reports.record_by_no(st.subject, facts, st.catalog, (number or "").upper())["history"]


# --------------------------------------------------------------------------- G9
@register("ensure_column", f"{M1} SELECT {PUBLIC}, '' AS notes FROM subj")
def q_ensure_column(spark, sf_dir):
    s = fx.customer_subjects(spark, sf_dir)
    return mt.ensure_column(mt.ensure_column(s, "status", "Active"), "notes", "")


# --------------------------------------------------------------------------- C6 / H2
FK_SQL = """SELECT f.id, f.student_id, f.offense_id, s.id IS NULL AS missing_subject, c.id IS NULL AS missing_catalog
FROM fact f LEFT JOIN {subj} s ON s.id = f.student_id LEFT JOIN {cat} c ON c.id = f.offense_id
WHERE s.id IS NULL OR c.id IS NULL"""


# Orphans are made on the child's side, by keys that no parent has; parents are whole.
def _orphans(fact, col, n):
    return fact.withColumn(col, F.when(F.col("id") % n == 0, -F.col(col) - 1).otherwise(F.col(col)))


def _orphans_sql(cte, col, n):
    return cte.replace("fact AS (", "fact0 AS (") + f""",
fact AS (SELECT * REPLACE (CASE WHEN id % {n} = 0 THEN -{col} - 1 ELSE {col} END AS {col}) FROM fact0) """


@register("fk_audit", _orphans_sql(M1, "student_id", 11) + FK_SQL.format(subj="subj", cat="cat"))
def q_fk_audit(spark, sf_dir):
    from starledger.operators.joins import fk_audit
    st = fx.orders_star(spark, sf_dir)
    return fk_audit(_orphans(st.fact, "student_id", 11), st.subject, st.catalog)


@register("fk_audit_lineitem", _orphans_sql(M2, "offense_id", 13) + FK_SQL.format(subj="subj", cat="cat"))
def q_fk_audit_lineitem(spark, sf_dir):
    from starledger.operators.joins import fk_audit
    st = fx.lineitem_star(spark, sf_dir)
    return fk_audit(_orphans(st.fact, "offense_id", 13), st.subject, st.catalog)


# The same audits by bitmaps of the keys.
@register("fk_audit_bitmaps", _orphans_sql(M1, "student_id", 11) + FK_SQL.format(subj="subj", cat="cat"))
def q_fk_audit_bitmaps(spark, sf_dir):
    from starledger.operators import keysets
    st = fx.orders_star(spark, sf_dir)
    return keysets.fk_audit(_orphans(st.fact, "student_id", 11), st.subject, st.catalog)


@register("fk_audit_lineitem_bitmaps", _orphans_sql(M2, "offense_id", 13) + FK_SQL.format(subj="subj", cat="cat"))
def q_fk_audit_lineitem_bitmaps(spark, sf_dir):
    from starledger.operators import keysets
    st = fx.lineitem_star(spark, sf_dir)
    return keysets.fk_audit(_orphans(st.fact, "offense_id", 13), st.subject, st.catalog)


@register("missing_keys_bitmaps", f"{M1} SELECT id FROM ({PROBE}) k WHERE id NOT IN (SELECT id FROM fact)")
def q_missing_keys_bitmaps(spark, sf_dir):
    from starledger.operators import keysets
    return keysets.missing_keys(_probe_keys(spark, sf_dir), fx.order_facts(spark, sf_dir))


@register("distinct_keys_bitmaps", "SELECT CAST(COUNT(DISTINCT l_partkey) AS BIGINT) AS n_keys FROM lineitem")
def q_distinct_keys_bitmaps(spark, sf_dir):
    from starledger.operators import keysets
    return keysets.count_keys(keysets.key_bits(read_table(spark, sf_dir, "lineitem"), "l_partkey"))


@register("protected_preview_catalog", f"""{M2},
k AS (SELECT p_partkey AS id FROM part WHERE p_size % 7 = 0),
prot AS (SELECT c.id, c.code, c.name, COUNT(*) AS incident_count
         FROM cat c JOIN fact f ON f.offense_id = c.id WHERE c.id IN (SELECT id FROM k)
         GROUP BY c.id, c.code, c.name),
h AS (SELECT code, id, code || ' - ' || name AS label FROM prot ORDER BY code, id LIMIT 3),
n AS (SELECT COUNT(*) AS c FROM prot)
SELECT n.c AS protected_count,
       CASE WHEN n.c = 1 THEN printf('%d selected offense has', n.c) ELSE printf('%d selected offenses have', n.c) END
       || ' incident records and cannot be deleted: '
       || (SELECT string_agg(label, ', ' ORDER BY code, id) FROM h)
       || CASE WHEN n.c > 3 THEN printf(', and %d more', n.c - 3) ELSE '' END
       || '. No offenses were deleted' AS message
FROM n WHERE n.c > 0""")
def q_protected_preview_catalog(spark, sf_dir):
    st = fx.lineitem_star(spark, sf_dir)
    keys = read_table(spark, sf_dir, "part").filter(F.col("p_size") % 7 == 0).select(F.col("p_partkey").alias("id"))
    res = mt.guarded_delete(st.catalog, st.fact, keys, "id", "offense_id", ["code", "name"])
    label = F.concat(F.col("code"), F.lit(" - "), F.col("name"))
    return mt.protected_preview(res.protected, label, [F.col("code"), F.col("id")], "offense")


# --------------------------------------------------------------------------- H1 / H2 on writes
def _raw_items(spark, sf_dir):
    """Every part as a catalog row as a user might send it: some categories and points out of their domains."""
    p = read_table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(F.col("p_partkey").alias("id"), F.format_string("X-%05d", "p_partkey").alias("code"),
                    F.when(size % 17 == 0, "").otherwise(F.col("p_name")).alias("name"),
                    F.when(size % 3 == 0, "Minor").when(size % 3 == 1, "Major").otherwise("Moderate").alias("category"),
                    (size % 13).cast("int").alias("severity_points"))


ITEMS_CTE = """items AS (
  SELECT p_partkey AS id, printf('X-%05d', p_partkey) AS code, CASE p_size % 17 WHEN 0 THEN '' ELSE p_name END AS name,
         ['Minor', 'Major', 'Moderate'][1 + p_size % 3] AS category, CAST(p_size % 13 AS INTEGER) AS severity_points
  FROM part),
broken AS (
  SELECT id, 2 AS pos, 'name_required' AS rule FROM items WHERE name = ''
  UNION ALL SELECT id, 3, 'category_domain' FROM items WHERE category = 'Moderate'
  UNION ALL SELECT id, 4, 'points_range' FROM items WHERE severity_points IN (0, 11, 12))"""


@register("domain_audit_catalog", f"WITH {ITEMS_CTE} SELECT id, rule FROM broken")
def q_domain_audit_catalog(spark, sf_dir):
    from starledger.operators.intake import catalog_rules, domain_audit
    return domain_audit(_raw_items(spark, sf_dir), catalog_rules())


@register("insert_catalog_rejects", f"""WITH {ITEMS_CTE}
SELECT id AS ord, printf('X-%05d', id) AS code, min_by(rule, pos) AS reason FROM broken GROUP BY id""")
def q_insert_catalog_rejects(spark, sf_dir):
    from starledger.operators.intake import catalog_rules
    batch = _raw_items(spark, sf_dir).withColumnRenamed("id", "ord")
    return mt.insert_new(fx.part_catalog(spark, sf_dir), batch, "code", "ord", rules=catalog_rules()).rejected


@register("domain_audit_facts", """SELECT o_orderkey AS id, 'status_domain' AS rule FROM orders WHERE o_orderstatus = 'P'""")
def q_domain_audit_facts(spark, sf_dir):
    from starledger.operators.intake import domain_audit, fact_rules
    letter = F.col("o_orderstatus")
    status = F.when(letter == "O", "Open").when(letter == "F", "Resolved").otherwise(letter)
    facts = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))
    return domain_audit(facts, fact_rules())


@register("null_audit", "SELECT o_orderkey AS ord, 'incident_date_not_null' AS rule FROM orders WHERE o_orderkey % 9 = 0")
def q_null_audit(spark, sf_dir):
    from starledger.operators.intake import null_audit
    return null_audit(_fact_batch(spark, sf_dir), ["student_id", "offense_id", "incident_date", "status"], key="ord")
