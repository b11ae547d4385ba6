"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

OPERATION = """CASE event_type WHEN 'click' THEN 'Addition' WHEN 'view' THEN 'Subtraction'
  WHEN 'purchase' THEN 'Multiplication' WHEN 'signup' THEN 'Division' END"""
GRADE_NAMES = "['class-one','class-two','class-three','class-four','class-five','class-six','class-seven','class-eight','class-nine','class-ten']"
SEGMENT = """CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'BUILDING' THEN 3
  WHEN 'FURNITURE' THEN 4 WHEN 'HOUSEHOLD' THEN 5 END"""


def op_order(c: str) -> str:
    return (
        f"CASE {c} WHEN 'Addition' THEN 0 WHEN 'Subtraction' THEN 1 WHEN 'Multiplication' THEN 2"
        f" WHEN 'Division' THEN 3 END"
    )


def grade_order(c: str) -> str:
    return f"CAST(nullif(list_position({GRADE_NAMES}, {c}), 0) AS INTEGER)"


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def week(c: str) -> str:
    monday = f"date_trunc('week', {c})"
    return f"strftime({monday}, '%Y-%m-%d') || ',' || strftime({monday} + INTERVAL 6 DAY, '%Y-%m-%d')"


def even(x: str, n: int) -> str:
    return f"(round_even(({x}) * {float(10**n)}::DOUBLE, 0) / {float(10**n)}::DOUBLE)"


def median(x: str, when: str = "true") -> str:
    ordered = f"list_sort(list(CAST({x} AS DOUBLE)) FILTER (WHERE ({x}) IS NOT NULL AND ({when})))"
    return f"(({ordered})[(len({ordered}) + 1) // 2] + ({ordered})[(len({ordered}) + 2) // 2]) / 2"


def number(x: str) -> str:
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(24,2)) AS VARCHAR), '0$', '')"


def percent(x: str) -> str:
    return f"CAST(CAST(round_even(({x}) * 100.0::DOUBLE, 0) AS BIGINT) AS VARCHAR) || ' %'"


def seconds(a: str, b: str) -> str:
    return f"(CAST(date_diff('microsecond', {a}, {b}) AS DOUBLE) / 1000000.0::DOUBLE)"


def exact(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,6))) AS DOUBLE)"


def events(shared: bool = False) -> str:
    learner = "user_id // 8" if shared else "user_id"
    k = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
    return f"""ev AS (SELECT event_id, ts, event_type, value, {learner} AS learner, {k} AS k, {k} // 4 AS b,
  'q-' || event_type || '-' || {k} AS question_id, 'qs-' || event_type || '-' || ({k} // 4) AS question_set_id,
  {OPERATION} AS operation FROM events)"""


LEARNERS = f"""lr AS (SELECT c_custkey, c_name, {SEGMENT} AS seg, CASE WHEN c_acctbal >= 0 THEN n_name END AS school,
  CASE WHEN c_acctbal >= 0 THEN r_name END AS tenant
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)"""

PURPOSE = "CASE WHEN b = 24 THEN NULL WHEN b % 5 = 0 THEN 'Main Diagnostic' ELSE 'Practice' END"


def attempts(shared: bool = False) -> str:
    """Common table expressions ev, lr and a, the attempt fact."""
    return f"""{events(shared)}, {LEARNERS},
a AS (SELECT lr.tenant AS tenant_name, coalesce(lr.school, 'No School') AS school, {GRADE_NAMES}[lr.seg] AS grade,
  lr.c_name AS learner_name, 'user' || lr.c_custkey AS learner_username, CAST(learner AS VARCHAR) AS learner_id,
  question_id, question_set_id, ts AS updated_at, CAST(ts AS DATE) AS d,
  CASE WHEN value <= 300 THEN 1 + k % 3 END AS attempts_count,
  CASE WHEN value <= 450 THEN CAST(value < 50 AS INTEGER) END AS score,
  'Set ' || event_type || ' ' || b AS qset_name, 'U-' || event_type || '-' || b AS qset_uid,
  {PURPOSE} AS purpose, b % 5 + 1 AS sequence,
  CASE WHEN (learner + b) % 3 <> 0 THEN 'completed' ELSE 'in-progress' END AS status,
  {GRADE_NAMES}[b // 5 + 1] AS qset_grade, operation, operation AS l1_skill, 'L2-' || (b // 5) AS l2_skill,
  CASE WHEN b < 24 THEN 'L3-' || b END AS l3_skill, 'Repo-' || (b % 3) AS repo_name, k, b, event_type, learner, event_id
  FROM ev LEFT JOIN lr ON lr.c_custkey = ev.learner)"""


A = "WITH " + attempts()
S = "WITH " + attempts(shared=True)
EV = "WITH " + events()

FACT_COLUMNS = f"""tenant_name, school, grade, learner_name, learner_username, learner_id, question_id, question_set_id,
  {ts('updated_at')} AS updated_at, attempts_count, score, qset_name, qset_uid, purpose, sequence, status, qset_grade,
  operation, l1_skill, l2_skill, l3_skill, repo_name"""

RESULTS = f"""WITH j AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem),
r AS (SELECT CASE p.p_type WHEN 'SMALL' THEN 'Addition' WHEN 'MEDIUM' THEN 'Subtraction' WHEN 'LARGE' THEN 'Multiplication'
    WHEN 'STANDARD' THEN 'Division' END AS operation,
  {GRADE_NAMES}[(CAST(replace(p.p_brand, 'Brand#', '') AS INTEGER) - 1) // 5 + 1] AS qset_grade,
  CAST(l.l_partkey AS VARCHAR) AS question_set_id, p.p_name AS qset_name, l.l_discount * 10 AS score, p.p_size
  FROM j JOIN orders o ON o.o_orderkey = j.l_orderkey AND o.o_orderstatus = 'F'
  JOIN lineitem l ON l.l_partkey = j.l_partkey AND l.l_orderkey = j.l_orderkey
  JOIN part p ON p.p_partkey = l.l_partkey)"""
AVG_SCORE = "CAST(sum(CAST(score AS DECIMAL(20,10))) AS DOUBLE) / count(score)"


def grade_performance(source: str) -> str:
    return f"""{source},
q AS (SELECT operation, qset_grade, question_set_id, qset_name, {AVG_SCORE} AS m FROM x GROUP BY ALL),
n AS (SELECT operation, qset_grade,
  coalesce(string_agg(DISTINCT qset_name, ', ' || chr(10) ORDER BY qset_name) FILTER (WHERE m < 0.4), '') AS lo,
  coalesce(string_agg(DISTINCT qset_name, ', ' || chr(10) ORDER BY qset_name) FILTER (WHERE m > 0.6), '') AS hi
  FROM q WHERE operation IS NOT NULL AND qset_grade IS NOT NULL GROUP BY ALL),
s AS (SELECT operation, qset_grade, count(*) AS attempts_count, {median('score')} AS med, {AVG_SCORE} AS av FROM x GROUP BY ALL)
SELECT s.operation, s.qset_grade, attempts_count, {percent('med')} AS median, {percent('av')} AS avg,
  n.lo AS qsets_score_less_than_20, n.hi AS qsets_score_more_than_90
FROM s LEFT JOIN n ON n.operation = s.operation AND n.qset_grade = s.qset_grade"""


def learner_days(source: str, bucket: str) -> str:
    return f"""{source}, ld AS (SELECT {bucket} AS bucket, learner_id, d,
  least({seconds('min(updated_at)', 'max(updated_at)')}, 2700.0::DOUBLE) AS sec FROM a GROUP BY ALL)"""


def adjusted(keys: str, where: str, order: str) -> str:
    """dt: one row per learner, day and keys with its adjusted time."""
    filled = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"""{S}, d0 AS (SELECT learner_id, d, {keys}, min(updated_at) AS lo, max(updated_at) AS hi,
  {seconds('min(updated_at)', 'max(updated_at)')} AS sec FROM a WHERE ({where}) AND {filled} GROUP BY ALL),
d1 AS (SELECT *, least(sec, 2700.0::DOUBLE) AS c FROM d0),
d2 AS (SELECT *, sum(CAST(c AS DECIMAL(18,6))) OVER (PARTITION BY learner_id, d) AS tot,
  lag(c) OVER (PARTITION BY learner_id, d ORDER BY lo, {order}) AS pc FROM d1),
dt AS (SELECT *, CASE WHEN tot > 2700 THEN coalesce(abs(c - pc), sec) ELSE c END AS t FROM d2)"""


GRADE_KEYS = "tenant_name, school, grade, operation, qset_grade"
OPERATION_KEYS = "tenant_name, school, grade, operation"
GRADE_DAYS = adjusted(GRADE_KEYS, "purpose IS DISTINCT FROM 'Main Diagnostic'", GRADE_KEYS)
OPERATION_DAYS = adjusted(OPERATION_KEYS, "true", OPERATION_KEYS)

GRADE_JUMPS = f"""{GRADE_DAYS},
g0 AS (SELECT learner_id, operation, qset_grade, {exact('t')} AS total, min(lo) AS lo FROM dt GROUP BY ALL),
g1 AS (SELECT *, lag(total) OVER w AS prev, lag(qset_grade) OVER w AS step FROM g0
  WINDOW w AS (PARTITION BY learner_id, operation ORDER BY {grade_order('qset_grade')})),
ju AS (SELECT learner_id, step, {even('prev / 60.0::DOUBLE', 2)} AS m, lo FROM g1 WHERE prev IS NOT NULL),
js AS (SELECT * FROM ju WHERE step IN ('class-one','class-two','class-three','class-four','class-five'))"""
OPERATION_JUMPS = f"""{OPERATION_DAYS},
g0 AS (SELECT learner_id, operation, {exact('t')} AS total, min(lo) AS lo FROM dt GROUP BY ALL),
g1 AS (SELECT *, lag(total) OVER w AS prev, lag(operation) OVER w AS step FROM g0
  WINDOW w AS (PARTITION BY learner_id ORDER BY {op_order('operation')})),
ju AS (SELECT learner_id, step, {even('prev / 60.0::DOUBLE', 2)} AS m, lo FROM g1 WHERE prev IS NOT NULL),
js AS (SELECT * FROM ju WHERE step <> 'Division')"""


def jump(source: str, by_step: bool, by_week: bool) -> str:
    bucket = week("lo") if by_week else "'overall'"
    where = "WHERE lo >= TIMESTAMP '2023-12-25'" if by_week else ""
    return f"""{source}
SELECT {bucket} AS bucket, {'step' if by_step else "'all'"} AS step, {even(median('m'), 2)} AS median_minutes,
  count(DISTINCT learner_id) AS learners FROM {'js' if by_step else 'ju'} {where} GROUP BY 1, 2"""


def new_learners(counted: str) -> str:
    return f"""{A}, w AS (SELECT learner_id, date_trunc('week', d) AS wk, count(DISTINCT coalesce(operation, '-')) AS n
  FROM a GROUP BY ALL),
f AS (SELECT learner_id, min(wk) AS wk FROM w GROUP BY 1),
c AS (SELECT f.wk, {counted} AS n FROM f JOIN w ON w.learner_id = f.learner_id AND w.wk = f.wk GROUP BY 1)
SELECT {week('x.wk')} AS bucket, CAST(coalesce(c.n, 0) AS BIGINT) AS learners
FROM (SELECT DISTINCT wk FROM w) x LEFT JOIN c ON c.wk = x.wk"""


LAST = f"""sets AS (SELECT DISTINCT question_set_id, operation, b // 5 AS g, b % 5 + 1 AS seq FROM ev),
ts1 AS (SELECT *, row_number() OVER (PARTITION BY operation, g ORDER BY seq DESC, question_set_id) AS rn FROM sets),
qs AS (SELECT DISTINCT question_id, question_set_id, k % 4 + 1 AS seq FROM ev),
tq AS (SELECT *, row_number() OVER (PARTITION BY question_set_id ORDER BY seq DESC, question_id) AS rn FROM qs),
last AS (SELECT s.operation, {GRADE_NAMES}[g + 1] AS qset_grade, s.question_set_id, t.question_id
  FROM ts1 s JOIN tq t ON t.question_set_id = s.question_set_id WHERE s.rn = 1 AND t.rn = 1)"""

LADDER = f"""{A}, {LAST},
lg AS (SELECT learner_id, a.grade, a.operation, a.qset_grade, bool_or(l.question_id IS NOT NULL) AS is_last
  FROM a LEFT JOIN last l ON l.question_id = a.question_id AND l.question_set_id = a.question_set_id
    AND l.operation = a.operation AND l.qset_grade = a.qset_grade
  WHERE purpose IS DISTINCT FROM 'Main Diagnostic' AND a.operation IS NOT NULL AND grade IS NOT NULL
  GROUP BY ALL),
l2 AS (SELECT *, {op_order('operation')} AS operation_order, {grade_order('qset_grade')} AS qset_grade_order,
  CASE grade WHEN 'class-two' THEN 'class-one' WHEN 'class-three' THEN 'class-two' WHEN 'class-four' THEN 'class-three'
    WHEN 'class-five' THEN 'class-four' WHEN 'class-six' THEN 'class-five' END AS target_grade FROM lg),
l3 AS (SELECT *, lead(qset_grade) OVER (PARTITION BY learner_id ORDER BY operation_order, qset_grade_order) AS next_grade
  FROM l2)"""
CURRENT = f"""{LADDER},
l4 AS (SELECT *, row_number() OVER (PARTITION BY learner_id, operation, grade ORDER BY qset_grade_order DESC) AS up,
  first_value(qset_grade) OVER (PARTITION BY learner_id, operation, grade ORDER BY qset_grade_order) AS starting_grade
  FROM l3 WHERE target_grade IS NOT NULL),
cur AS (SELECT learner_id, operation, grade, target_grade, starting_grade,
  CASE WHEN NOT (is_last OR next_grade IS NOT NULL) THEN qset_grade
    WHEN qset_grade = target_grade THEN 'target-achieved'
    WHEN qset_grade_order <= 5 THEN {GRADE_NAMES}[qset_grade_order + 1] ELSE qset_grade END AS current_grade
  FROM l4 WHERE up = 1)"""
CURRENT_GRADES = [
    "class-one",
    "class-two",
    "class-three",
    "class-four",
    "class-five",
    "class-six",
    "class-seven",
    "class-eight",
    "class-nine",
    "class-ten",
    "target-achieved",
]


def share(grade: str) -> str:
    in_grade = f"count(DISTINCT learner_id) FILTER (WHERE current_grade = '{grade}')"
    fraction = f"CAST({in_grade} AS DOUBLE) / count(DISTINCT learner_id)"
    return f"CASE WHEN {in_grade} > 0 THEN {even(fraction, 2)} * 100.0::DOUBLE END AS \"{grade}\""


SHARES = ", ".join(share(g) for g in CURRENT_GRADES)
MATRIX = f"""{CURRENT}, mx AS (SELECT operation, starting_grade, target_grade, {SHARES},
  count(DISTINCT learner_id) AS learners_count FROM cur GROUP BY 1, 2, 3),
mt AS (SELECT *, CAST(sum(learners_count) OVER (PARTITION BY operation, starting_grade) AS BIGINT) AS total_count FROM mx)"""

QSET_KEYS = "question_set_id, qset_uid, operation, qset_grade, sequence, purpose, qset_name, l2_skill, l3_skill"
QSET_LEARNERS = f"""{A}, q0 AS (SELECT {QSET_KEYS}, learner_id, d, {seconds('min(updated_at)', 'max(updated_at)')} AS sec,
  sum(score) AS s, count(score) AS n FROM a WHERE status = 'completed' AND operation IS NOT NULL AND purpose IS NOT NULL
  AND l3_skill IS NOT NULL GROUP BY ALL),
q1 AS (SELECT {QSET_KEYS}, learner_id, {exact('sec')} AS total_time, CAST(coalesce(sum(s), 0) AS BIGINT) AS total_score,
  CAST(sum(n) AS BIGINT) AS total_count, CASE WHEN sum(n) > 0 THEN CAST(sum(s) AS DOUBLE) / CAST(sum(n) AS DOUBLE) END AS accuracy
  FROM q0 GROUP BY ALL)"""
MEAN_ACCURACY = "CAST(sum(CAST(accuracy AS DECIMAL(20,10))) AS DOUBLE) / count(accuracy)"
MEAN_TIME = "CAST(sum(CAST(total_time AS DECIMAL(20,10))) AS DOUBLE) / count(*)"
QSET_MEASURES = f"""{QSET_KEYS}, count(DISTINCT learner_id) AS count_of_learners,
  {{}} AS median_accuracy, {{}} AS average_accuracy,
  {even('(' + median('total_time') + ') / 60.0::DOUBLE', 2)} AS median_time,
  {even('(' + MEAN_TIME + ') / 60.0::DOUBLE', 2)} AS mean_time"""

QUESTION_KEYS = "question_set_id, question_set_uid, qs_seq, question_id, question_uid, q_seq"
QUESTION_TIMES = f"""{S}, t0 AS (SELECT question_set_id, qset_uid AS question_set_uid, sequence AS qs_seq, question_id,
  'QU-' || event_type || '-' || k AS question_uid, k % 4 + 1 AS q_seq, learner_id, score, updated_at, d FROM a),
t1 AS (SELECT *, coalesce({seconds('''lag(updated_at) OVER (PARTITION BY question_set_id, learner_id, d
  ORDER BY q_seq, updated_at, question_id)''', 'updated_at')}, 0) AS question_time_taken FROM t0)"""
QUESTION_MEASURES = f"""{QUESTION_KEYS}, count(DISTINCT learner_id) AS learners_count, {{}} AS median_accuracy,
  {{}} AS average_accuracy, {even(exact('question_time_taken') + ' / count(*)', 3)} AS average_time_taken"""

LISTED_GRADES = [f"class-{n}" for n in "one two three four five six seven eight nine ten".split()]
LEARNER_LIST = ", ".join(
    [
        f"avg(CASE WHEN qset_grade = '{g}' THEN CAST(n AS DOUBLE) END) AS \"{g}\","
        f" avg(CASE WHEN qset_grade = '{g}' THEN acc END) AS \"{g}-avg\""
        for g in LISTED_GRADES
    ]
)

WEEKS = [
    "2024-01-29,2024-02-04",
    "2024-01-22,2024-01-28",
    "2024-01-15,2024-01-21",
    "2024-01-08,2024-01-14",
    "2024-01-01,2024-01-07",
]


def over_buckets(select: str, tail: str) -> str:
    """The same figures for the overall bucket and per week."""
    return f"{select.format(bucket=chr(39) + 'overall' + chr(39))} {tail} UNION ALL {select.format(bucket=week('d'))} {tail}"


def _report_rows() -> list[tuple[int, str, str | None]]:
    operations = ["Addition", "Subtraction", "Multiplication", "Division"]
    grades = CURRENT_GRADES[:6]
    names: list[tuple[str, str | None]] = [("Active Learners", None)]
    names += [("Active Learners", o) for o in operations]
    names += [
        ("New Learners Added", None),
        ("Logged In Learners", None),
        ("Sessions", None),
        ("Total Time Spent (In Min)", None),
        ("Average Time Spent Per Learner (In Min)", None),
        ("Median Time (In Min) For A Grade Jump", None),
    ]
    names += [
        ("Median Time (In Min) For A Grade Jump", f"{a} to {b}") for a, b in zip(grades, grades[1:])
    ]
    names += [("Median Time (In Min) For An Operator Jump", None)]
    names += [
        ("Median Time (In Min) For An Operator Jump", f"{a} to {b}")
        for a, b in zip(operations, operations[1:])
    ]
    names += [
        ("Work Done", None),
        ("Work Done Per Learner", None),
        ("Median Work Done Per Learner", None),
        ("Median Accuracy Of Learners", None),
    ]
    return [(i, m, s) for i, (m, s) in enumerate(names)]


def _master() -> str:
    """cells(o, bucket, value): every figure of the master report, by row number."""
    rows = _report_rows()
    labels = ", ".join(
        f"({i}, '{m}', {'NULL' if s is None else chr(39) + s + chr(39)})" for i, m, s in rows
    )
    grade_part = GRADE_JUMPS.removeprefix(S + ", ")
    operation_part = OPERATION_JUMPS.removeprefix(S + ", ")
    for old in ("d0", "d1", "d2", "dt", "g0", "g1", "ju", "js"):
        operation_part = _rename(operation_part, old, f"o{old}")
    weekly, overall = week("d"), "'overall'"

    def both(body: str) -> str:
        return f"{body.format(bucket=overall)} UNION ALL {body.format(bucket=weekly)}"

    def jump_cells(table: str, base: int, following: str) -> str:
        text = f"{number(even(median('m'), 2))} || ' (' || count(DISTINCT learner_id) || ')'"
        out = []
        for step, source in ((None, "ju"), ("step", "js")):
            number_of_row = f"{base}" if step is None else f"{base} + {following}"
            for bucket in (overall, week("lo")):
                where = "" if bucket == overall else "WHERE lo >= TIMESTAMP '2023-12-25'"
                out.append(
                    f"SELECT {number_of_row} AS o, {bucket} AS bucket, {text} AS value"
                    f" FROM {table}{source} {where} GROUP BY 1, 2"
                )
        return " UNION ALL ".join(out)

    floor_work = "CAST(floor(CAST({w} AS DOUBLE) / count(DISTINCT learner_id)) AS BIGINT)"
    return f"""{S}, {grade_part}, {operation_part},
ld AS (SELECT learner_id, d, least({seconds('min(updated_at)', 'max(updated_at)')}, 2700.0::DOUBLE) AS sec FROM a GROUP BY ALL),
cd AS (SELECT d, school, grade, count(DISTINCT learner_id) AS n FROM a WHERE grade IS NOT NULL GROUP BY ALL),
lo AS (SELECT DISTINCT learner_id, d FROM a WHERE event_type = 'signup'),
fw AS (SELECT learner_id, min(date_trunc('week', d)) AS wk FROM a GROUP BY 1),
nl AS (SELECT fw.wk, count(*) AS n FROM fw JOIN (SELECT DISTINCT learner_id, date_trunc('week', d) AS wk,
  coalesce(operation, '-') AS op FROM a) x ON x.learner_id = fw.learner_id AND x.wk = fw.wk GROUP BY 1),
pw AS ({both("SELECT {bucket} AS bucket, learner_id, count(attempts_count) AS w, sum(score) AS s, count(score) AS c FROM a GROUP BY 1, 2")}),
cells AS (
{both("SELECT 0 AS o, {bucket} AS bucket, CAST(count(DISTINCT learner_id) AS VARCHAR) AS value FROM a GROUP BY 2")}
UNION ALL {both("SELECT 1 + " + op_order('operation') + " AS o, {bucket} AS bucket, CAST(count(DISTINCT learner_id) AS VARCHAR) AS value FROM a WHERE operation IS NOT NULL GROUP BY 1, 2")}
UNION ALL SELECT 5, {week('x.wk')}, CAST(coalesce(nl.n, 0) AS VARCHAR) FROM (SELECT DISTINCT date_trunc('week', d) AS wk FROM a) x LEFT JOIN nl ON nl.wk = x.wk
UNION ALL {both("SELECT 6 AS o, {bucket} AS bucket, CAST(count(*) AS VARCHAR) AS value FROM lo GROUP BY 2")}
UNION ALL {both("SELECT 7 AS o, {bucket} AS bucket, CAST(count(*) FILTER (WHERE n >= 3) AS VARCHAR) AS value FROM cd GROUP BY 2")}
UNION ALL {both("SELECT 8 AS o, {bucket} AS bucket, " + number(even(exact('sec') + ' / 60.0::DOUBLE', 2)) + " AS value FROM ld GROUP BY 2")}
UNION ALL {both("SELECT 9 AS o, {bucket} AS bucket, " + number(even(even(exact('sec') + ' / 60.0::DOUBLE', 2) + ' / count(DISTINCT learner_id)', 2)) + " AS value FROM ld GROUP BY 2")}
UNION ALL {jump_cells('', 10, grade_order('step'))}
UNION ALL {jump_cells('o', 16, '1 + ' + op_order('step'))}
UNION ALL SELECT 20, 'overall', CAST(count(*) AS VARCHAR) FROM a
UNION ALL SELECT 20, {weekly}, CAST(count(attempts_count) AS VARCHAR) FROM a GROUP BY 2
UNION ALL SELECT 21, 'overall', CAST({floor_work.format(w='count(*)')} AS VARCHAR) FROM a
UNION ALL SELECT 21, {weekly}, CAST({floor_work.format(w='count(attempts_count)')} AS VARCHAR) FROM a GROUP BY 2
UNION ALL SELECT 22, bucket, {number(even(median('w'), 2))} FROM pw GROUP BY 2
UNION ALL SELECT 23, bucket, {number(even(median('acc'), 2))} FROM (SELECT bucket, CASE WHEN c > 0 THEN {even('CAST(s AS DOUBLE) / CAST(c AS DOUBLE) * 100.0::DOUBLE', 2)} END AS acc FROM pw) GROUP BY 2
),
labels(o, metrics, sub_metrics) AS (VALUES {labels}),
blank AS (SELECT o, 'overall' AS bucket, CASE WHEN o IN (0, 6, 7, 8, 9, 20, 21) THEN '0' WHEN o IN (10, 16) THEN '' END AS value
  FROM labels WHERE o NOT IN (SELECT o FROM cells WHERE bucket = 'overall')),
filled AS (SELECT * FROM cells UNION ALL SELECT * FROM blank)"""


def _rename(sql: str, old: str, new: str) -> str:
    import re

    return re.sub(rf"\b{old}\b", new, sql)


MASTER = _master()


def named(row: str) -> str:
    return f"SELECT event_id, {row} FROM events"


def distinct_values(column: str, source: str) -> str:
    return f"SELECT DISTINCT {column} FROM ({source})"


SKILLS = f"""{EV} SELECT DISTINCT 'l1-' || event_type AS identifier, operation AS skill, 'l1_skill' AS type FROM ev WHERE operation IS NOT NULL
UNION SELECT DISTINCT 'l2-' || (b // 5), 'L2-' || (b // 5), 'l2_skill' FROM ev
UNION SELECT DISTINCT 'l3-' || b, 'L3-' || b, 'l3_skill' FROM ev WHERE b < 24"""
SCHOOLS = "SELECT n_name AS school_name FROM nation UNION ALL SELECT 'No School'"
REPOSITORIES = f"{EV} SELECT DISTINCT 'repo-' || (b % 3) AS identifier, 'Repo-' || (b % 3) AS repo_name FROM ev"

QSET_SQL = f"{QSET_LEARNERS} SELECT {QSET_MEASURES} FROM q1 {{}} GROUP BY ALL"

ORACLES: dict[str, str] = {
    # sources
    "attempts_flat": f"""{A} SELECT tenant_name, nullif(school, 'No School') AS school,
  CAST(list_position({GRADE_NAMES}, grade) AS VARCHAR) AS grade, learner_name, learner_username, learner_id, question_id,
  question_set_id, {ts('updated_at')} AS updated_at, attempts_count, score, 'class-' || (b // 5 + 1) AS qset_grade_identifier,
  CASE WHEN operation IS NOT NULL THEN 'l1-' || event_type END AS operation_identifier, qset_name, qset_uid, purpose,
  'repo-' || (b % 3) AS repo_name_identifier, CASE WHEN operation IS NOT NULL THEN 'l1-' || event_type END AS l1_skill_identifier,
  'l2-' || (b // 5) AS l2_skill_identifier, CASE WHEN b < 24 THEN 'l3-' || b END AS l3_skill_identifier, sequence, status FROM a""",
    "attempts_enriched": f"{A} SELECT {FACT_COLUMNS} FROM a",
    "attempt_fact": f"{A} SELECT {FACT_COLUMNS} FROM a",
    "last_question": f"{EV}, {LAST} SELECT * FROM last",
    "dim_learners": f"""WITH {LEARNERS} SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS identifier, 'user' || c_custkey AS user_name,
  c_name AS name, school FROM lr""",
    "dim_grades": f"""SELECT DISTINCT 'class-' || ({SEGMENT}) AS identifier, {SEGMENT} AS id, CAST({SEGMENT} AS VARCHAR) AS grade
  FROM customer""",
    "dim_grades_list": f"SELECT DISTINCT {SEGMENT} AS id, {GRADE_NAMES}[{SEGMENT}] AS grade FROM customer",
    "dim_schools": SCHOOLS,
    "dim_qset_types": f"{EV} SELECT DISTINCT {PURPOSE} AS purpose FROM ev",
    "dim_repositories": REPOSITORIES,
    "dim_skills": SKILLS,
    "dim_tenants": "SELECT DISTINCT r_regionkey AS id, r_name AS tenant_name FROM region",
    "login_events": f"""{A} SELECT CAST(event_id AS VARCHAR) AS id, CAST(k % 3 AS VARCHAR) AS level, learner_id,
  {ts('updated_at')} AS created_on, nullif(school, 'No School') AS school, grade, tenant_name FROM a WHERE event_type = 'signup'""",
    "question_sequence": f"{EV} SELECT DISTINCT question_id, question_set_id, k % 4 + 1 AS sequence FROM ev",
    "question_set_ids": f"{EV} SELECT DISTINCT 'U-' || event_type || '-' || b AS qset_id FROM ev",
    "question_set_ids_of_repository": f"{EV} SELECT DISTINCT 'U-' || event_type || '-' || b AS qset_id FROM ev WHERE b % 3 = 1",
    "question_level": f"""{A} SELECT question_set_id, qset_uid AS question_set_uid, sequence AS qs_seq, question_id,
  'QU-' || event_type || '-' || k AS question_uid, k % 4 + 1 AS q_seq, learner_id, score, {ts('updated_at')} AS updated_at,
  {day('d')} AS updated_date FROM a""",
    "set_results": f"{RESULTS} SELECT operation, qset_grade, question_set_id, qset_name, score FROM r",
    "incremental_refresh": f"{A} SELECT DISTINCT {FACT_COLUMNS} FROM a",
    "streaming_refresh": f"{A} SELECT DISTINCT {FACT_COLUMNS} FROM a",
    "data_bounds": f"""SELECT {ts('min(ts)')} AS min_updated_at, {ts('max(ts)')} AS max_updated_at,
  strftime(max(ts) + INTERVAL '5 hours 30 minutes', '%d %b %Y %H:%M') AS last_record_shown FROM events""",
    "non_diagnostic": f"""{A} SELECT learner_id, question_id, {ts('updated_at')} AS updated_at, purpose FROM a
  WHERE purpose IS NULL OR purpose <> 'Main Diagnostic'""",
    "dim_values_l1": f"SELECT DISTINCT skill FROM ({SKILLS}) WHERE type = 'l1_skill'",
    "dim_values_l2": f"SELECT DISTINCT skill FROM ({SKILLS}) WHERE type = 'l2_skill'",
    "dim_values_l3": f"SELECT DISTINCT skill FROM ({SKILLS}) WHERE type = 'l3_skill'",
    "dim_values_schools": distinct_values("school_name", SCHOOLS),
    "dim_values_qset_types": f"{EV} SELECT DISTINCT {PURPOSE} AS purpose FROM ev",
    "dim_values_tenants": "SELECT DISTINCT r_name AS tenant_name FROM region",
    "dim_values_repositories": distinct_values("repo_name", REPOSITORIES),
    # filters and projections
    "filtered_attempts": f"""{A} SELECT learner_id, question_id, {ts('updated_at')} AS updated_at FROM a WHERE school = 'NATION_7'
  AND grade = 'class-two' AND operation = 'Addition' AND tenant_name = 'ASIA'""",
    "date_range_overall": f"""{A} SELECT learner_id, question_id, {ts('updated_at')} AS updated_at FROM a
  WHERE d >= DATE '2024-01-10' AND d <= DATE '2024-01-23'""",
    "date_range_weekly": f"""{A} SELECT learner_id, question_id, {ts('updated_at')} AS updated_at FROM a
  WHERE d >= DATE '2024-01-08'""",
    "default_lookback": f"""{A} SELECT learner_id, question_id, {ts('updated_at')} AS updated_at FROM a
  WHERE d >= date_trunc('week', DATE '2024-02-20') - INTERVAL 35 DAY""",
    "filter_in_list": f"""{A} SELECT learner_id, question_id, {ts('updated_at')} AS updated_at, purpose FROM a
  WHERE purpose IN ('Practice', 'Pre Test')""",
    "completed_attempts": f"""{A} SELECT learner_id, question_id, {ts('updated_at')} AS updated_at, qset_uid FROM a
  WHERE status = 'completed' AND repo_name = 'Repo-1' AND l1_skill = 'Addition' AND purpose = 'Practice'""",
    "learner_labels": "SELECT DISTINCT 'user' || c_custkey || '-' || c_name AS learners_name FROM customer",
    "learner_labels_no_school": "SELECT DISTINCT 'user' || c_custkey || '-' || c_name AS learners_name FROM customer WHERE c_acctbal < 0",
    # joins and reshaping
    "skill_decode": f"{A} SELECT learner_id, question_id, {ts('updated_at')} AS updated_at, l3_skill FROM a",
    "last_question_reached": f"""{A}, {LAST} SELECT learner_id, a.question_id, a.question_set_id, {ts('updated_at')} AS updated_at,
  l.question_id IS NOT NULL AS is_found FROM a LEFT JOIN last l ON l.question_id = a.question_id
  AND l.question_set_id = a.question_set_id AND l.operation = a.operation AND l.qset_grade = a.qset_grade""",
    "pivot_weekly": f"{A} SELECT "
    + ", ".join(
        f"count(DISTINCT learner_id) FILTER (WHERE {week('d')} = '{w}') AS \"{w}\"" for w in WEEKS
    )
    + " FROM a",
    "pivot_operation_week": f"{A} SELECT operation, "
    + ", ".join(
        f"nullif(count(DISTINCT learner_id) FILTER (WHERE {week('d')} = '{w}'), 0) AS \"{w}\"" for w in WEEKS
    )
    + " FROM a WHERE operation IS NOT NULL GROUP BY 1",
    "operation_domain_fill": f"""{A}, f AS (SELECT {week('d')} AS bucket, operation, learner_id FROM a
  WHERE school = 'NATION_7' AND operation IS NOT NULL),
o(operation) AS (VALUES ('Addition'), ('Subtraction'), ('Multiplication'), ('Division'))
SELECT bk.bucket, o.operation, nullif((SELECT count(DISTINCT learner_id) FROM f WHERE f.bucket = bk.bucket
  AND f.operation = o.operation), 0) AS learners FROM (SELECT DISTINCT bucket FROM f) bk CROSS JOIN o""",
    "week_calendar": f"""SELECT {day('w')} || ',' || {day('w + INTERVAL 6 DAY')} AS week_id,
  strftime(w, '%d %b') || ' to ' || strftime(w + INTERVAL 6 DAY, '%d %b %Y') AS week_name, {day('w')} AS week_start,
  {day('w + INTERVAL 6 DAY')} AS week_end
  FROM (SELECT unnest(generate_series(date_trunc('week', min(ts)), date_trunc('week', max(ts)), INTERVAL 7 DAY)) AS w FROM events)""",
    # activity
    "unique_learners_overall": f"""{A} SELECT 'overall' AS bucket, operation, count(DISTINCT learner_id) AS learners FROM a
  WHERE operation IS NOT NULL GROUP BY 2 UNION ALL SELECT 'overall', NULL, count(DISTINCT learner_id) FROM a""",
    "unique_learners_in_period": f"""{A}, p AS (SELECT * FROM a WHERE d BETWEEN DATE '2024-01-10' AND DATE '2024-01-23')
  SELECT 'overall' AS bucket, operation, count(DISTINCT learner_id) AS learners FROM p
  WHERE operation IS NOT NULL GROUP BY 2 UNION ALL SELECT 'overall', NULL, count(DISTINCT learner_id) FROM p""",
    "unique_learners_weekly": f"{A} SELECT {week('d')} AS bucket, count(DISTINCT learner_id) AS learners FROM a GROUP BY 1",
    "unique_learners_weekly_by_operation": f"""{A} SELECT {week('d')} AS bucket, operation, count(DISTINCT learner_id) AS learners
  FROM a WHERE operation IS NOT NULL GROUP BY 1, 2""",
    "new_learners_weekly": new_learners("sum(w.n)"),
    "new_learners_weekly_distinct": new_learners("count(*)"),
    "new_learners_weekly_selected": f"""{A}, s AS (SELECT learner_id, date_trunc('week', d) AS wk FROM a
  WHERE operation = 'Division' AND d >= DATE '2024-01-08'),
f AS (SELECT learner_id, min(wk) AS wk FROM s WHERE learner_id NOT IN (SELECT learner_id FROM a WHERE d < DATE '2024-01-08') GROUP BY 1)
SELECT {week('x.wk')} AS bucket, (SELECT count(*) FROM f WHERE f.wk = x.wk) AS learners FROM (SELECT DISTINCT wk FROM s) x""",
    "logins_overall": f"""{A} SELECT 'overall' AS bucket, count(*) AS logins FROM (SELECT DISTINCT learner_id, d FROM a
  WHERE event_type = 'signup')""",
    "logins_weekly": f"""{A} SELECT {week('d')} AS bucket, count(*) AS logins FROM (SELECT DISTINCT learner_id, d FROM a
  WHERE event_type = 'signup') GROUP BY 1""",
    "sessions_overall": f"""{A} SELECT 'overall' AS bucket, count(*) FILTER (WHERE n >= 3) AS sessions FROM
  (SELECT d, school, grade, count(DISTINCT learner_id) AS n FROM a WHERE grade IS NOT NULL GROUP BY ALL)""",
    "sessions_weekly": f"""{A} SELECT {week('d')} AS bucket, count(*) FILTER (WHERE n >= 3) AS sessions FROM
  (SELECT d, school, grade, count(DISTINCT learner_id) AS n FROM a WHERE grade IS NOT NULL GROUP BY ALL) GROUP BY 1""",
    "work_done_overall": f"{A} SELECT 'overall' AS bucket, count(*) AS work_done FROM a",
    "work_done_weekly": f"{A} SELECT {week('d')} AS bucket, count(attempts_count) AS work_done FROM a GROUP BY 1",
    "work_per_learner_overall": f"""{A} SELECT 'overall' AS bucket,
  CAST(count(*) // count(DISTINCT learner_id) AS BIGINT) AS work_per_learner FROM a""",
    "work_per_learner_weekly": f"""{A} SELECT {week('d')} AS bucket,
  CAST(count(attempts_count) // count(DISTINCT learner_id) AS BIGINT) AS work_per_learner FROM a GROUP BY 1""",
    "median_work_overall": f"""{A} SELECT 'overall' AS bucket, {median('n')} AS median_work FROM
  (SELECT learner_id, count(attempts_count) AS n FROM a GROUP BY 1)""",
    "median_work_weekly": f"""{A} SELECT bucket, {median('n')} AS median_work FROM
  (SELECT {week('d')} AS bucket, learner_id, count(attempts_count) AS n FROM a GROUP BY 1, 2) GROUP BY 1""",
    "time_spent_overall": f"""{learner_days(A, "'overall'")} SELECT bucket, {even(exact('sec') + ' / 60.0::DOUBLE', 2)} AS minutes
  FROM ld GROUP BY 1""",
    "time_spent_weekly": f"""{learner_days(A, week('d'))} SELECT bucket, {even(exact('sec') + ' / 60.0::DOUBLE', 2)} AS minutes
  FROM ld GROUP BY 1""",
    "time_per_learner_overall": f"""{learner_days(A, "'overall'")} SELECT bucket,
  {even(even(exact('sec') + ' / 60.0::DOUBLE', 2) + ' / count(DISTINCT learner_id)', 2)} AS minutes_per_learner FROM ld GROUP BY 1""",
    "time_per_learner_weekly": f"""{learner_days(A, week('d'))} SELECT bucket,
  {even(even(exact('sec') + ' / 60.0::DOUBLE', 2) + ' / count(DISTINCT learner_id)', 2)} AS minutes_per_learner FROM ld GROUP BY 1""",
    "low_time_weeks": f"""{learner_days(S, week('d'))} SELECT bucket, {even(exact('sec') + ' / 60.0::DOUBLE', 2)} AS minutes,
  {even(exact('sec') + ' / 60.0::DOUBLE', 2)} < 2000 AS low_time FROM ld GROUP BY 1""",
    "median_accuracy_overall": f"""{A} SELECT 'overall' AS bucket, {even(median('acc'), 2)} AS median_accuracy FROM
  (SELECT learner_id, CASE WHEN count(score) > 0 THEN {even('CAST(sum(score) AS DOUBLE) / count(score) * 100.0::DOUBLE', 2)} END AS acc
   FROM a GROUP BY 1)""",
    "median_accuracy_weekly": f"""{A} SELECT bucket, {even(median('acc'), 2)} AS median_accuracy FROM
  (SELECT {week('d')} AS bucket, learner_id,
    CASE WHEN count(score) > 0 THEN {even('CAST(sum(score) AS DOUBLE) / count(score) * 100.0::DOUBLE', 2)} END AS acc
   FROM a GROUP BY 1, 2) GROUP BY 1""",
    # time on task and jumps
    "grade_time_daily": f"""{GRADE_DAYS} SELECT learner_id, {GRADE_KEYS}, {day('d')} AS activity_date, {ts('lo')} AS first_at,
  {ts('hi')} AS last_at, t AS time_spent, {op_order('operation')} AS operation_order, {grade_order('qset_grade')} AS grade_order FROM dt""",
    "operation_time_daily": f"""{OPERATION_DAYS} SELECT learner_id, {OPERATION_KEYS}, {day('d')} AS activity_date,
  {ts('lo')} AS first_at, {ts('hi')} AS last_at, t AS time_spent, {op_order('operation')} AS operation_order FROM dt""",
    "daily_time_adjusted": f"""{OPERATION_DAYS} SELECT learner_id, {day('d')} AS activity_date, operation, sec AS seconds,
  t AS time_spent FROM dt""",
    "grade_jump_overall": jump(GRADE_JUMPS, False, False),
    "grade_jump_by_grade": jump(GRADE_JUMPS, True, False),
    "grade_jump_weekly": jump(GRADE_JUMPS, False, True),
    "grade_jump_by_grade_week": jump(GRADE_JUMPS, True, True),
    "operation_jump_overall": jump(OPERATION_JUMPS, False, False),
    "operation_jump_by_operation": jump(OPERATION_JUMPS, True, False),
    "operation_jump_weekly": jump(OPERATION_JUMPS, False, True),
    "operation_jump_by_operation_week": jump(OPERATION_JUMPS, True, True),
    # content
    "qset_avg_score": f"""{RESULTS} SELECT operation, qset_grade, question_set_id, qset_name, {AVG_SCORE} AS avg_score FROM r
  GROUP BY 1, 2, 3, 4""",
    "qset_grade_summary": f"""{RESULTS} SELECT operation, qset_grade, count(*) AS attempts_count, {median('score')} AS median,
  {AVG_SCORE} AS avg FROM r GROUP BY 1, 2""",
    "easy_hard_qsets": f"""{RESULTS}, q AS (SELECT operation, qset_grade, question_set_id, qset_name, {AVG_SCORE} AS m FROM r
  WHERE operation IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT operation, qset_grade,
  coalesce(string_agg(DISTINCT qset_name, ', ' || chr(10) ORDER BY qset_name) FILTER (WHERE m < 0.4), '') AS qsets_score_less_than_20,
  coalesce(string_agg(DISTINCT qset_name, ', ' || chr(10) ORDER BY qset_name) FILTER (WHERE m > 0.6), '') AS qsets_score_more_than_90
FROM q GROUP BY 1, 2""",
    "grade_performance": grade_performance(f"{RESULTS}, x AS (SELECT * FROM r)"),
    "grade_performance_of_repository": grade_performance(
        f"{RESULTS}, x AS (SELECT * FROM r WHERE p_size > 10 AND p_size % 3 = 1)"
    ),
    "qset_learner_accuracy": f"""{QSET_LEARNERS} SELECT {QSET_KEYS}, learner_id, total_time, total_score, total_count, accuracy
  FROM q1""",
    "qset_performance": QSET_SQL.format(median("accuracy"), MEAN_ACCURACY, ""),
    "qset_performance_report": f"""WITH w AS ({QSET_SQL.format(median("accuracy"), MEAN_ACCURACY, "WHERE purpose = 'Practice'")})
SELECT * REPLACE ({percent('median_accuracy')} AS median_accuracy, {percent('average_accuracy')} AS average_accuracy) FROM w""",
    "question_time_taken": f"""{QUESTION_TIMES} SELECT {QUESTION_KEYS}, learner_id, score, {ts('updated_at')} AS updated_at,
  {day('d')} AS updated_date, question_time_taken FROM t1""",
    "question_performance": f"""{QUESTION_TIMES} SELECT {QUESTION_MEASURES.format(median('score'),
  'CAST(sum(score) AS DOUBLE) / nullif(count(score), 0)')} FROM t1 GROUP BY ALL""",
    "question_performance_report": f"""{QUESTION_TIMES}, w AS (SELECT {QUESTION_MEASURES.format(median('score'),
  'CAST(sum(score) AS DOUBLE) / nullif(count(score), 0)')} FROM t1 WHERE question_set_uid = 'U-click-3' GROUP BY ALL)
SELECT * REPLACE ({percent('median_accuracy')} AS median_accuracy, {percent('average_accuracy')} AS average_accuracy) FROM w""",
    # progression
    "learner_grade_ladder": f"{LADDER} SELECT * FROM l3",
    "learner_current_grade": f"{CURRENT} SELECT * FROM cur",
    "learner_progress_matrix": f"{MATRIX} SELECT * FROM mt",
    "learner_progress_report": f"{MATRIX} SELECT * REPLACE ("
    + ", ".join(
        number(f'round("{g}", 2)') + f" || ' %' AS \"{g}\""
        for g in [*CURRENT_GRADES[:5], "target-achieved"]
    )
    + ") FROM mt",
    # drill-downs and reports
    "learner_list": f"""{A}, g AS (SELECT learner_id, qset_grade, any_value(grade) AS grade, any_value(learner_name) AS learner_name,
  any_value(learner_username) AS learner_username, count(attempts_count) AS n,
  CASE WHEN count(score) > 0 THEN {even('CAST(sum(score) AS DOUBLE) / count(score) * 100.0::DOUBLE', 2)} END AS acc
  FROM a WHERE operation = 'Addition' AND grade IS NOT NULL GROUP BY 1, 2)
SELECT learner_id, {LEARNER_LIST}, any_value(grade) AS grade, any_value(learner_name) AS learner_name,
  any_value(learner_username) AS learner_username FROM g GROUP BY 1""",
    "learner_detail": f"""{S}, dd AS (SELECT learner_id, question_set_id, qset_name, d, count(attempts_count) AS n,
  sum(score) AS s, min(updated_at) AS lo, max(updated_at) AS hi,
  array_to_string(list_sort(list(DISTINCT k % 4 + 1) FILTER (WHERE score = 0)), ',') AS wrong FROM a GROUP BY 1, 2, 3, 4),
st AS (SELECT learner_id, question_set_id, qset_name, CAST(sum(n) AS BIGINT) AS total_questions_attempted,
  CAST(coalesce(sum(s), 0) AS BIGINT) AS total_score, max(d) AS last_day,
  {even(exact(f"least({seconds('lo', 'hi')}, 2700.0::DOUBLE)") + ' / 60.0::DOUBLE', 2)} AS time_taken, max(hi) AS max_timestamp,
  coalesce(string_agg(wrong, ',' ORDER BY d) FILTER (WHERE wrong <> ''), '') AS incorrect_attempts FROM dd GROUP BY 1, 2, 3)
SELECT learner_id, question_set_id, qset_name, total_questions_attempted, total_score,
  CASE WHEN total_questions_attempted > 0 THEN
    {even('CAST(total_score AS DOUBLE) / total_questions_attempted * 100.0::DOUBLE', 2)} END AS accuracy, time_taken,
  CASE WHEN max_timestamp = max(max_timestamp) OVER (PARTITION BY learner_id) THEN 'in progress' ELSE {day('last_day')} END AS attempted_date,
  incorrect_attempts, {ts('max_timestamp')} AS max_timestamp FROM st""",
    "master_report_long": f"""{MASTER} SELECT CAST(l.o AS INTEGER) AS metric_order, metrics, sub_metrics, bucket, value
  FROM filled f JOIN labels l ON l.o = f.o""",
    "master_report_wide": f"{MASTER} SELECT CAST(l.o AS INTEGER) AS metric_order, metrics, sub_metrics, "
    "max(value) FILTER (WHERE bucket = 'overall') AS overall_count, "
    + ", ".join(
        f"max(value) FILTER (WHERE bucket = '{w}') AS \"{w}\""
        for w in [*WEEKS, "2023-12-25,2023-12-31"]
    )
    + " FROM labels l LEFT JOIN filled f ON f.o = l.o GROUP BY 1, 2, 3",
    # scalar functions and formats
    "ordered_by_domain": f"""{A} SELECT DISTINCT question_set_id, operation, qset_grade, sequence,
  {op_order('operation')} AS operation_order, {grade_order('qset_grade')} AS qset_grade_order FROM a""",
    "week_range_label": named(f"{week('ts')} AS week_range"),
    "json_extract": named("json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS \"none\""),
    "percent_format": named(f"{percent('value / 500.0::DOUBLE')} AS shown"),
    "share_format": named(f"{number('round(value, 2)')} || ' %' AS shown"),
    "median_count_format": f"""{A} SELECT bucket, {number(median('n'))} || ' (' || count(*) || ')' AS shown FROM
  (SELECT {week('d')} AS bucket, learner_id, count(attempts_count) AS n FROM a GROUP BY 1, 2) GROUP BY 1""",
}

# What a store holds after several syncs is what one extract of everything gives.
ORACLES["refreshed_logins"] = ORACLES["login_events"]
ORACLES["refreshed_new_learners"] = ORACLES["new_learners_weekly"]


# Filtered forms: the same SQL over the attempts that the filters leave.
SCHOOL_CLASS = "school = 'NATION_7' AND grade = 'class-two' AND tenant_name = 'ASIA'"
SOME_DAYS = "d BETWEEN DATE '2024-01-10' AND DATE '2024-01-23'"


def narrowed(sql: str, where: str) -> str:
    """``sql`` over the attempts for which ``where`` holds."""
    for source in (A, S):
        body = source.removeprefix("WITH ")
        kept = _rename(body, "a", "every_a") + f", a AS (SELECT * FROM every_a WHERE {where})"
        sql = sql.replace(body, kept)
    return sql


def _weekly_figure(figure: str, where: str) -> str:
    return narrowed(f"{A} SELECT {week('d')} AS bucket, {figure} FROM a GROUP BY 1", where)


ORACLES |= {
    "completed_attempts_of_skill": f"""{A} SELECT learner_id, question_id, {ts('updated_at')} AS updated_at, qset_uid FROM a
  WHERE status = 'completed' AND l2_skill = 'L2-1' AND l3_skill = 'L3-7'""",
    "completed_attempts_of_sets": f"""{A} SELECT learner_id, question_id, {ts('updated_at')} AS updated_at, qset_uid FROM a
  WHERE status = 'completed' AND qset_uid IN ('U-click-3', 'U-view-8', 'U-none-1')""",
    "unique_learners_weekly_selected": _weekly_figure("count(DISTINCT learner_id) AS learners", f"{SCHOOL_CLASS} AND {SOME_DAYS}"),
    "sessions_weekly_selected": narrowed(
        f"""{A}, cd AS (SELECT d, grade, count(DISTINCT learner_id) AS n FROM a WHERE grade IS NOT NULL GROUP BY ALL)
SELECT {week('d')} AS bucket, count(*) FILTER (WHERE n >= 2) AS sessions FROM cd GROUP BY 1""",
        f"school = 'NATION_7' AND {SOME_DAYS}",
    ),
    "time_per_learner_overall_selected": narrowed(
        f"""{A}, ld AS (SELECT learner_id, d, least({seconds('min(updated_at)', 'max(updated_at)')}, 2700.0::DOUBLE) AS sec FROM a GROUP BY ALL),
m AS (SELECT {even(exact('sec') + ' / 60.0::DOUBLE', 2)} AS minutes, count(DISTINCT learner_id) AS n FROM ld)
SELECT 'overall' AS bucket, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE {even('minutes / n', 2)} END AS minutes_per_learner FROM m""",
        f"{SCHOOL_CLASS} AND {SOME_DAYS}",
    ),
    "qset_performance_report_selected": narrowed(
        ORACLES["qset_performance_report"].replace("WHERE purpose = 'Practice'", ""),
        "qset_uid IN ('U-click-3', 'U-click-6', 'U-view-8') AND repo_name = 'Repo-0' AND l2_skill = 'L2-0'",
    ),
    "learner_progress_report_of_school": narrowed(ORACLES["learner_progress_report"], "school = 'NATION_7'"),
    "learner_list_selected": narrowed(
        ORACLES["learner_list"].replace("operation = 'Addition'", "operation = 'Division'"),
        "school = 'NATION_7' AND tenant_name = 'ASIA' AND purpose = 'Practice' AND d >= DATE '2024-01-08'",
    ),
    "learner_detail_of_learner": narrowed(ORACLES["learner_detail"], "learner_id = '5' AND purpose = 'Practice'"),
    "learner_detail_of_username": narrowed(
        ORACLES["learner_detail"], "learner_username = 'user7' AND qset_grade = 'class-two' AND operation = 'Addition'"
    ),
    "master_report_long_selected": narrowed(ORACLES["master_report_long"], "grade = 'class-two' AND tenant_name = 'ASIA'"),
}

# Bitmaps give the figures that distinct counts give.
ORACLES |= {
    "learner_bitmaps_weekly": ORACLES["unique_learners_weekly"],
    "learner_bitmaps_weekly_by_operation": ORACLES["unique_learners_weekly_by_operation"],
    "learner_bitmaps_selected": ORACLES["unique_learners_weekly_selected"],
}
