"""Property tests: Spark's date parsing against a Python model of the rules
(ISO or basic ISO, then M/d/Y, d/M/Y, M-d-Y, d-M-Y; numeric text is a
spreadsheet serial day)."""
import datetime as dt
import re

from hypothesis import given, settings, strategies as st

from starledger.functions.scalars import parse_date

EPOCH = dt.date(1899, 12, 30)


def model(text: str):
    t = text.strip()
    if not t:
        return None
    if re.fullmatch(r"\d+(\.\d+)?", t) and not re.fullmatch(r"\d{8}", t):
        v = float(t)
        days = int(v // 1) + (1 if 0 < v < 60 else 0)
        try:
            return EPOCH + dt.timedelta(days=days)
        except OverflowError:
            return None
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}|\d{8}", t):
        try:
            return dt.date.fromisoformat(t)
        except ValueError:
            pass
    for pat in ("%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y"):
        try:
            return dt.datetime.strptime(t, pat).date()
        except ValueError:
            continue
    return None


def render(d: dt.date, m: int, day: int, y: int, form: int) -> str:
    if form == 0:
        return d.isoformat()
    if form == 1:
        return d.strftime("%Y%m%d")
    if form == 2:
        return f"{m}/{day}/{y}"
    if form == 3:
        return f"{m:02d}/{day:02d}/{y}"
    if form == 4:
        return f"{day}/{m}/{y}"
    if form == 5:
        return f"{m}-{day}-{y}"
    if form == 6:
        return f"{day}-{m}-{y}"
    return str((d - EPOCH).days)


cases = st.tuples(
    st.dates(min_value=dt.date(1900, 3, 1), max_value=dt.date(2199, 12, 31)),
    st.integers(1, 13), st.integers(1, 32), st.integers(0, 7), st.sampled_from(["", " ", "  "]),
)


@settings(max_examples=3, deadline=None)
@given(st.lists(cases, min_size=150, max_size=250))
def test_parse_date_matches_model(spark, batch):
    texts = [pad + render(d, m, day, d.year, form) + pad for d, m, day, form, pad in batch]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(parse_date("t")).collect()]
    want = [model(t) for t in texts]
    bad = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not bad, bad[:5]


# --- subject intake against a row-at-a-time model ---------------------------
from starledger.operators import intake  # noqa: E402
from starledger.sources.sheets import stage_rows  # noqa: E402
from starledger.spec import SUBJECT_SCHEMA  # noqa: E402

LABELS = [("student_no", "Student No."), ("first_name", "First Name"), ("last_name", "Last Name"),
          ("grade", "Grade"), ("section", "Section")]
STATUSES = {"active": "Active", "inactive": "Inactive"}


def clean(v):
    return "" if v is None else v.strip()


def model_import(rows, stored):
    seen, out = set(), {}
    for rn, cells in rows:
        if not any(clean(v) for v in cells.values()):
            continue  # blank row: dropped, still numbered
        vals = {c: clean(cells.get(c)) for c, _ in LABELS}
        status = STATUSES.get(clean(cells.get("status") or "Active").lower())
        missing = [lbl for c, lbl in LABELS if not vals[c]]
        if missing:
            out[rn] = ("error", "Missing " + ", ".join(missing))
            continue
        if not status:
            out[rn] = ("error", "Status must be Active or Inactive")
            continue
        k = vals["student_no"].lower()
        if k in seen or k in stored:
            out[rn] = ("skipped", None)
            continue
        seen.add(k)
        out[rn] = ("imported", None)
    return out


cell_rows = st.lists(st.tuples(
    st.sampled_from(["A1", "a1", "B2", "b2", "C3", " C3 ", "", " "]),
    st.sampled_from(["Ann", "", " "]),
    st.sampled_from(["Lee", ""]),
    st.sampled_from(["7", ""]),
    st.sampled_from(["A", ""]),
    st.sampled_from([None, "", " ", "active", "ACTIVE", " Inactive ", "bogus"]),
), min_size=1, max_size=40)


@settings(max_examples=4, deadline=None)
@given(cell_rows)
def test_subject_import_matches_row_model(spark, sheet):
    rows = [(i + 2, dict(zip(["student_no", "first_name", "last_name", "grade", "section", "status"], r)))
            for i, r in enumerate(sheet)]
    df = spark.createDataFrame(
        [(rn, c["student_no"], c["first_name"], c["last_name"], c["grade"], c["section"], "", c["status"])
         for rn, c in rows],
        "row_number long, student_no string, first_name string, last_name string, grade string, "
        "section string, adviser string, status string")
    stored = spark.createDataFrame([(1, "B2", "S", "T", "7", "A", "", "Active")], SUBJECT_SCHEMA)
    res = intake.import_subjects(stage_rows(df), stored, checkpoint=False)
    got = {r.row_number: (r.outcome, r.message) for r in res.outcomes.collect()}
    assert got == model_import(rows, {"b2"})
    s = res.summary().first()
    assert s.imported + s.skipped + s.error_count == s.total_rows == len(got)


# --- fact intake against a row-at-a-time model ------------------------------
from starledger.sources.catalog import catalog_frame  # noqa: E402
from starledger.spec import FACT_SCHEMA, FACT_STATUSES  # noqa: E402


def model_facts(rows, subjects, catalog, base_no, base_id):
    out, acc, n = {}, [], 0
    for rn, c in rows:
        if not any(clean(v) for v in c.values()):
            continue
        sn, oc = clean(c["student_no"]), clean(c["offense_code"])
        status = FACT_STATUSES.get(clean(c["status"] or "Open").lower())
        sid, off = subjects.get(sn.lower()), catalog.get(oc.lower())
        text = clean(c["incident_date"])
        if not sn:
            err = "Student No. is required"
        elif not oc:
            err = "Offense Code is required"
        elif sid is None:
            err = f"Student {sn} was not found"
        elif off is None:
            err = f"Offense code {oc} was not found"
        elif not status:
            err = "Status must be Open, Parent Notified, Under Review, or Resolved"
        elif not text:
            err = "Incident Date is required"
        elif model(text) is None:
            err = "Incident Date must use YYYY-MM-DD or a recognized Excel date"
        else:
            err = None
        out[rn] = ("error", err) if err else ("imported", None)
        if not err:
            n += 1
            acc.append((rn, base_id + n, f"INC-{base_no + n:05d}", model(text), sid, off[0],
                        clean(c["action_taken"]) or off[1], status))
    return out, acc


fact_rows = st.lists(st.tuples(
    st.sampled_from(["2026-02-13", "3/4/2026", "13/02/2026", "46037", "soon", "", "02/30/2026"]),
    st.sampled_from(["S-1", "s-1", "S-2", "S-9", "", " "]),
    st.sampled_from(["MAJ-1", "maj-1", "MIN-1", "ZZ", ""]),
    st.sampled_from(["", "Called"]),
    st.sampled_from([None, "", "open", "RESOLVED", "Pending", " under review "]),
), min_size=1, max_size=40)


@settings(max_examples=4, deadline=None)
@given(fact_rows)
def test_fact_import_matches_row_model(spark, sheet):
    cols = ["incident_date", "student_no", "offense_code", "action_taken", "status"]
    rows = [(i + 2, dict(zip(cols, r))) for i, r in enumerate(sheet)]
    df = spark.createDataFrame([(rn, *[c[k] for k in cols], "", "") for rn, c in rows],
                               "row_number long, incident_date string, student_no string, offense_code string, "
                               "action_taken string, status string, reported_by string, notes string")
    subj = spark.createDataFrame([(1, "S-1", "A", "B", "7", "A", "", "Active"), (2, "S-2", "C", "D", "8", "B", "", "Active")],
                                 SUBJECT_SCHEMA)
    cat = catalog_frame(spark, [("MAJ-1", "Big", "Major", 5, "Refer"), ("MIN-1", "Small", "Minor", 1, "Warn")])
    existing = spark.createDataFrame([(7, "INC-00020", dt.date(2026, 1, 1), 1, 1, "", "Open", "", "")], FACT_SCHEMA)
    res = intake.import_facts(stage_rows(df), subj, cat, existing, checkpoint=False)
    want_out, want_acc = model_facts(rows, {"s-1": 1, "s-2": 2}, {"maj-1": (1, "Refer"), "min-1": (2, "Warn")}, 20, 7)
    assert {r.row_number: (r.outcome, r.message) for r in res.outcomes.collect()} == want_out
    got_acc = sorted((r.row_number, r.id, r.incident_no, r.incident_date, r.student_id, r.offense_id,
                      r.action_taken, r.status) for r in res.accepted.collect())
    assert got_acc == want_acc


# --- keyed upsert against a dict model -------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from starledger.operators import maintenance as mt  # noqa: E402

upserts = st.lists(st.tuples(st.sampled_from(["A", "B", "C", "D", "E"]), st.integers(1, 10)), min_size=0, max_size=12)


@settings(max_examples=4, deadline=None)
@given(upserts)
def test_upsert_matches_model(spark, batch):
    base_rows = [("A", "a", "Minor", 1, "", False), ("C", "c", "Major", 5, "", False)]
    base = catalog_frame(spark, [r[:5] for r in base_rows], active=False)
    upd = spark.createDataFrame([(k, f"n{p}", "Minor", p, "x", i) for i, (k, p) in enumerate(batch)],
                                "code string, name string, category string, severity_points int, "
                                "recommended_action string, ord long")
    cols = ["name", "category", "severity_points", "recommended_action"]
    out = mt.upsert(base, upd, "code", cols, "ord", on_update={"active": F.lit(True)})
    # model: stored ids kept; new keys get ids after the maximum, in the order of their winning (last) rows
    model = {"A": [1, "a", 1, False], "C": [2, "c", 5, False]}
    last = {}
    for i, (k, p) in enumerate(batch):
        last[k] = (i, p)
    nxt = 3
    for k, (i, p) in sorted(last.items(), key=lambda kv: kv[1][0]):
        if k in model:
            model[k][1:] = [f"n{p}", p, True]
        else:
            model[k] = [nxt, f"n{p}", p, True]
            nxt += 1
    got = {r.code: [r.id, r.name, r.severity_points, r.active] for r in out.collect()}
    assert got == model
    again = mt.upsert(out, upd, "code", cols, "ord", on_update={"active": F.lit(True)})
    assert {r.code: [r.id, r.name, r.severity_points, r.active] for r in again.collect()} == model
