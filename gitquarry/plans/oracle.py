"""Oracle SQL (DuckDB dialect) for the registered queries.

Each string repeats, independently of the Spark code, the derivation of
the logical tables in ``gitquarry.sources.adapters`` from the driver's
tables and then the operator's semantics written as plain SQL: the
reference's shapes (six self-joins, group fold) where they matter.
"""

from __future__ import annotations

BUGFIX_RE = "(?i)fix(e[ds])?|bugs?|defects?|patch"

COMMIT_CTE = """
commit_t AS (
  SELECT event_id AS _id, user_id % 25 AS vcs_system_id, user_id AS committer_id,
         date_trunc('hour', ts) AS committer_date,
         CASE WHEN event_type = 'signup' THEN 'Merge branch main' || chr(10) || chr(10) || 'into release'
              WHEN event_type = 'purchase' THEN 'FIXED defect in checkout'
              WHEN event_type = 'error' THEN CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'typo fix' END
              WHEN event_type = 'view' THEN 'Prefix cleanup in view'
              ELSE CASE WHEN event_id % 5 = 0 THEN 'Refactor dispatch loop' ELSE 'Add click handler' END
         END AS message
  FROM events)"""

FILE_ACTION_CTE = """
fa_v AS (
  SELECT event_id * 2 AS _id, event_id AS commit_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 + user_id % 10 AS file_id, value
  FROM events
  UNION ALL
  SELECT event_id * 2 + 1, event_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 + (user_id + 3) % 10, value
  FROM events WHERE event_id % 3 = 0),
fa_t AS (SELECT _id, commit_id, file_id FROM fa_v),
hv AS (SELECT _id AS file_action_id, CAST(round(value * 100) AS BIGINT) + (_id % 2) * 37 AS v FROM fa_v),
hunk_t AS (
  SELECT file_action_id, CAST(v % 400 AS INTEGER) AS new_start,
         CAST((v // 7) % 300 AS INTEGER) AS old_start, CAST(v % 13 AS INTEGER) AS old_lines FROM hv
  UNION ALL
  SELECT file_action_id, CAST((v // 3) % 500 AS INTEGER),
         CAST(CASE WHEN v % 11 = 0 THEN -1 ELSE (v // 11) % 350 END AS INTEGER),
         CAST((v // 5) % 9 AS INTEGER) FROM hv)"""

MESSAGE_CTE = """
message_t AS (
  SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS from_id, ts AS date
  FROM events WHERE event_type IN ('view', 'click', 'signup')),
comment_t AS (
  SELECT CASE WHEN event_id % 89 = 0 THEN NULL WHEN user_id % 7 = 0 THEN user_id + 1000
              ELSE user_id END AS author_id, ts AS created_at
  FROM events WHERE event_type IN ('error', 'purchase'))"""

VOLUME_CTE = """
message_t AS (SELECT o_custkey % 500 AS from_id, o_orderdate AS date FROM orders),
comment_t AS (SELECT l_suppkey % 500 AS author_id, l_shipdate AS created_at FROM lineitem),
commit_t AS (
  SELECT l_orderkey * 8 + l_linenumber AS _id, l_partkey % 500 AS committer_id,
         l_shipdate AS committer_date,
         CASE WHEN l_returnflag = 'R' THEN 'Fix returned item'
              WHEN l_returnflag = 'A' THEN 'Accept change' ELSE 'New feature' END AS message
  FROM lineitem)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def bugfix_labels() -> str:
    return _with(COMMIT_CTE) + f"""
SELECT _id, vcs_system_id, message, regexp_matches(message, '{BUGFIX_RE}') AS bugfix
FROM commit_t"""


def bugfix_labels_project(project_like: str) -> str:
    return _with(COMMIT_CTE) + f"""
, p AS (SELECT r_regionkey AS project_id FROM region WHERE r_name LIKE '{project_like}')
, v AS (SELECT n.n_nationkey AS vcs_id FROM nation n JOIN p ON n.n_regionkey = p.project_id)
SELECT c._id, c.vcs_system_id, c.message, regexp_matches(c.message, '{BUGFIX_RE}') AS bugfix
FROM commit_t c JOIN v ON c.vcs_system_id = v.vcs_id"""


def bugfix_counts(fmt: str) -> str:
    return _with(COMMIT_CTE) + f"""
SELECT strftime(committer_date, '{fmt}') AS "Date", committer_id AS "ID",
       regexp_matches(message, '{BUGFIX_RE}') AS bugfix, count(*) AS bug_fix
FROM commit_t GROUP BY 1, 2, 3"""


def developer_activity(fmt: str, bugfix_only: bool, volume: bool = False) -> str:
    ctes = (VOLUME_CTE,) if volume else (COMMIT_CTE, MESSAGE_CTE)
    flag_filter = "WHERE bugfix" if bugfix_only else ""
    return _with(*ctes) + f"""
, messages AS (SELECT strftime(date, '{fmt}') AS d, from_id AS id, count(*) AS messages
               FROM message_t GROUP BY 1, 2)
, comments AS (SELECT strftime(created_at, '{fmt}') AS d, author_id AS id, count(*) AS comments
               FROM comment_t GROUP BY 1, 2)
, commits AS (SELECT strftime(committer_date, '{fmt}') AS d, committer_id AS id, count(*) AS commits
              FROM commit_t GROUP BY 1, 2)
, bugfix AS (SELECT * FROM (
               SELECT strftime(committer_date, '{fmt}') AS d, committer_id AS id,
                      regexp_matches(message, '{BUGFIX_RE}') AS bugfix, count(*) AS bug_fix
               FROM commit_t GROUP BY 1, 2, 3) {flag_filter})
, join1 AS (SELECT coalesce(c.d, m.d) AS d, coalesce(c.id, m.id) AS id, c.comments, m.messages
            FROM comments c FULL OUTER JOIN messages m ON c.d = m.d AND c.id = m.id)
, join2 AS (SELECT coalesce(c.d, b.d) AS d, coalesce(c.id, b.id) AS id, c.commits, b.bug_fix
            FROM commits c FULL OUTER JOIN bugfix b ON c.d = b.d AND c.id = b.id)
SELECT coalesce(a.d, b.d) AS "Date", coalesce(a.id, b.id) AS "ID",
       a.comments, a.messages, b.commits, b.bug_fix
FROM join1 a FULL OUTER JOIN join2 b ON a.d = b.d AND a.id = b.id"""


def _inducing_pairs(match: str) -> str:
    """Brute force in the reference's shape: self-join every fix hunk with
    every earlier commit on its file, then a per-fix fold."""
    if match == "per_hunk":
        bound = "old_start + old_lines"
        anchor_cte = ""
        anchor_join = ""
    else:
        bound = """CASE WHEN a_fa IS NULL OR file_action_id < a_fa
                        OR (file_action_id = a_fa AND old_start < a_os)
                        OR (file_action_id = a_fa AND old_start = a_os AND old_lines < a_ol)
                   THEN old_start + old_lines ELSE a_os + a_ol END"""
        anchor_cte = """
, anchor AS (SELECT commit_id, file_action_id AS a_fa, old_start AS a_os, old_lines AS a_ol
             FROM (SELECT *, row_number() OVER (PARTITION BY commit_id
                                                ORDER BY file_action_id, old_start, old_lines) AS rn
                   FROM j WHERE old_start <> -1) WHERE rn = 1)"""
        anchor_join = "LEFT JOIN anchor USING (commit_id)"
    return _with(COMMIT_CTE, FILE_ACTION_CTE) + f"""
, c AS (SELECT _id AS commit_id, committer_date AS cdate,
               regexp_matches(message, '{BUGFIX_RE}') AS bugfix FROM commit_t)
, r AS (SELECT c.commit_id, c.cdate, c.bugfix, h.file_action_id, fa.file_id,
               h.new_start, h.old_start, h.old_lines
        FROM hunk_t h JOIN fa_t fa ON h.file_action_id = fa._id JOIN c ON fa.commit_id = c.commit_id)
, j AS (SELECT f.commit_id, f.cdate, f.file_action_id, f.file_id, f.old_start, f.old_lines,
               o.commit_id AS other_commit_id, o.cdate AS other_date, o.new_start AS other_new_start
        FROM r f JOIN r o ON f.file_id = o.file_id AND f.cdate > o.cdate
        WHERE f.bugfix){anchor_cte}
, t AS (SELECT j.*, {bound} AS bound FROM j {anchor_join})
, best AS (SELECT commit_id, other_commit_id,
                  row_number() OVER (PARTITION BY commit_id ORDER BY other_date DESC, other_commit_id) AS rn
           FROM t WHERE other_new_start <= bound)
, fixes AS (SELECT DISTINCT commit_id FROM j)
, pairs AS (SELECT fixes.commit_id AS fix_commit_id, best.other_commit_id AS inducing_commit_id
            FROM fixes LEFT JOIN best ON fixes.commit_id = best.commit_id AND best.rn = 1)
"""


def bug_inducing_pairs(match: str) -> str:
    return _inducing_pairs(match) + "SELECT * FROM pairs"


def bug_inducing(match: str) -> str:
    return _inducing_pairs(match) + "SELECT DISTINCT inducing_commit_id AS commit_id FROM pairs"


# ---------------------------------------------------------------- identity
PEOPLE_CTE = """
person_t AS (
  SELECT c_custkey AS k, c_custkey % 4 AS v,
         translate(left(md5('f' || CAST(c_custkey // 4 AS VARCHAR)), 8), '0123456789', 'ghijklmnop') AS f,
         translate(left(md5('l' || CAST(c_custkey // 4 AS VARCHAR)), 7), '0123456789', 'ghijklmnop') AS l
  FROM customer),
head_t AS (
  SELECT *, CASE WHEN k < 60 THEN 'admin' WHEN k < 2000 AND k % 37 = 3 THEN 'é' ELSE f END AS h FROM person_t),
people_t AS (
  SELECT k AS _id,
         CASE WHEN k % 41 = 0 THEN NULL WHEN v = 1 THEN l || ' ' || h
              WHEN v = 2 THEN h || ' ' || left(l, 6) ELSE h || ' ' || l END AS name,
         CASE WHEN k % 29 = 5 THEN 'list.' || f WHEN v = 0 THEN f || '.' || l
              WHEN v = 1 AND k // 4 % 3 = 0 THEN f || '.' || l WHEN v = 1 THEN l || f
              WHEN v = 2 THEN left(f, 1) || l WHEN k // 4 % 3 = 1 THEN l || '_' || f ELSE f || '-' || CAST(k AS VARCHAR) END
         || CASE WHEN k % 17 = 0 THEN '' ELSE '@example.org' END AS email
  FROM head_t),
persons AS (
  SELECT * FROM (
    SELECT lower(regexp_replace(split_part(email, '@', 1), '[^a-zA-Z]', '', 'g')) AS "Prefix",
           lower(regexp_replace(split_part(name, ' ', 1), '[^a-zA-Z]', '', 'g')) AS "Firstname",
           lower(regexp_replace(split_part(rtrim(name, ' '), ' ', -1), '[^a-zA-Z]', '', 'g')) AS "Lastname"
    FROM people_t)
  WHERE "Prefix" IS NOT NULL AND "Firstname" IS NOT NULL AND "Lastname" IS NOT NULL)"""

_L = ['"Prefix"', '"Firstname"', '"Lastname"']
_R = ['"Prefix_1"', '"Firstname_1"', '"Lastname_1"']


def _self_join(eq: tuple) -> str:
    """One of the reference's blocking joins: eq[i] is True for equal,
    False for NOT equal on Prefix, Firstname, Lastname."""
    conds = [f"a.{c} = b.{c}" if e else f"NOT (a.{c} = b.{c})" for c, e in zip(_L, eq)]
    return (f"SELECT a.\"Prefix\", a.\"Firstname\", a.\"Lastname\", b.\"Prefix\" AS \"Prefix_1\", "
            f"b.\"Firstname\" AS \"Firstname_1\", b.\"Lastname\" AS \"Lastname_1\" "
            f"FROM persons a JOIN persons b ON {' AND '.join(conds)}")


def pairs_cte(mode: str) -> str:
    masks = [(False, True, True), (True, False, True), (True, True, False)]
    if mode == "one_or_two":
        masks += [(False, False, True), (True, False, False), (False, True, False)]
    body = "\n  UNION ALL ".join(_self_join(m) for m in masks)
    return f"\ncand AS (SELECT DISTINCT * FROM (\n  {body}))"


def people_normalized() -> str:
    return _with(PEOPLE_CTE) + "SELECT * FROM persons"


def candidate_pairs(mode: str) -> str:
    return _with(PEOPLE_CTE, pairs_cte(mode)) + "SELECT * FROM cand"


def jw_sql(a: str, b: str) -> str:
    """Jaro-Winkler as the JVM string library computes it, in DuckDB SQL."""
    j = f"jaro_similarity({a}, {b})"
    lcp = (f"len(list_filter(range(1, least(length({a}), length({b})) + 1), "
           f"lambda i: left({a}, i) = left({b}, i)))")
    boost = (f"({j} + ((least(0.1::DOUBLE, 1.0::DOUBLE / greatest(length({a}), length({b}))) "
             f"* {lcp}) * (1.0::DOUBLE - {j})))")
    jw = f"(CASE WHEN {j} < 0.7 THEN {j} ELSE {boost} END)"
    return (f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE "
            f"ELSE floor({jw} * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END)")


def _k_sql(a: str, b: str) -> str:
    return (f"coalesce(list_sum([least(length({a}) - length(replace({a}, ch, '')), "
            f"length({b}) - length(replace({b}, ch, ''))) "
            f"for ch in list_distinct(string_split({a}, ''))]), 0)")


def jaccard_sql(a: str, b: str, rounded: bool) -> str:
    k = _k_sql(a, b)
    n = f"(length({a}) + length({b}) - {k})"
    if rounded:
        return (f"(CASE WHEN {n} = 0 THEN NULL ELSE "
                f"floor((200 * {k} + {n}) / (2 * {n})) / 100.0::DOUBLE END)")
    return f"(CAST({k} AS DOUBLE) / NULLIF(CAST({n} AS DOUBLE), 0))"


def edit_ratio_sql(a: str, b: str) -> str:
    m = f"greatest(length({a}), length({b}))"
    return f"(CAST({m} - levenshtein({a}, {b}) AS DOUBLE) / NULLIF(CAST({m} AS DOUBLE), 0))"


_SHORT = {'"Prefix"': "P", '"Firstname"': "F", '"Lastname"': "L"}


def feature_exprs(kind: str) -> list[str]:
    same = list(zip(_L, _R))
    all_to_all = [(a, b) for a in _L for b in _R]
    out = []
    if kind == "simple":
        out += [f"{jw_sql(a, b)} AS f{i + 1}" for i, (a, b) in enumerate(same)]
        out += [f"{jaccard_sql(a, b, False)} AS f{i + 4}" for i, (a, b) in enumerate(same)]
        out += [f"{edit_ratio_sql(a, b)} AS f{i + 7}" for i, (a, b) in enumerate(same)]
    elif kind == "broad":
        out += [f"{jw_sql(a, b)} AS f{i + 1}" for i, (a, b) in enumerate(all_to_all[:6])]
        out += [f"{edit_ratio_sql(a, b)} AS f{i + 7}" for i, (a, b) in enumerate(same)]
        for a, b in all_to_all:
            name = _SHORT[a] + _SHORT[b.replace("_1", "")]
            out.append(f"{jaccard_sql(a, b, True)} AS \"{name}-Jaccard\"")
    else:
        out += [f"{jw_sql(a, b)} AS f{i + 1}" for i, (a, b) in enumerate(all_to_all)]
        P, Fn, L = _L
        P1, F1, L1 = _R
        rules = [f"{P1} = {Fn} || {L}", f"{P} = {F1} || {L1}", f"{P1} = {L} || {Fn}",
                 f"{P} = {L1} || {F1}", f"{L1} || {F1} = {L} || {Fn}",
                 f"{L1} || {F1} = {Fn} || {L}", f"{L} || {Fn} = {F1} || {L1}"]
        out += [f"({r}) AS c{i + 1}" for i, r in enumerate(rules)]
    return out


def features_cte(kind: str, source: str = "cand", name: str = "feat") -> str:
    cols = ", ".join(_L + _R)
    extra = ", \"Label\"" if source != "cand" else ""
    return (f"\n{name} AS (SELECT {cols}{extra}, {', '.join(feature_exprs(kind))} FROM {source} "
            f"WHERE {' AND '.join(c + ' IS NOT NULL' for c in _L + _R)} "
            f"AND \"Prefix\" NOT LIKE '%log%' AND \"Prefix\" NOT LIKE '%list%' "
            f"AND \"Prefix\" NOT LIKE '%user%')")


def pair_features(kind: str, mode: str = "one_or_two") -> str:
    return _with(PEOPLE_CTE, pairs_cte(mode), features_cte(kind)) + "SELECT * FROM feat"


LABEL_SQL = """
labelled AS (SELECT "Prefix", "Firstname", "Lastname", "Prefix_1", "Firstname_1", "Lastname_1",
  CASE WHEN c1 OR c2 OR c3 OR c4 OR c5 OR c6 OR c7 OR (f5 >= 0.9 AND f9 >= 0.9) THEN 'T'
       WHEN greatest(f1, f5, f9) < 0.7 THEN 'F' ELSE 'U' END AS "Label" FROM feat)"""


def labelled_pairs() -> str:
    return _with(PEOPLE_CTE, pairs_cte("one_or_two"), features_cte("rules"), LABEL_SQL) + \
        "SELECT * FROM labelled"


def hash_unit_sql(cols: list[str], seed: int, digits: int = 8) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cols) + \
        f", '{seed}')"
    h = f"md5({text})"
    terms = [f"(instr('0123456789abcdef', substr({h}, {i + 1}, 1)) - 1) * {16 ** (digits - i - 1)}"
             for i in range(digits)]
    return f"(CAST({' + '.join(terms)} AS DOUBLE) / {float(16 ** digits)})"


def labelling_sample(mode: str, fraction: float, seed: int) -> str:
    u = hash_unit_sql(_L + _R, seed)
    return _with(PEOPLE_CTE, pairs_cte(mode)) + f"SELECT * FROM cand WHERE {u} >= 0 AND {u} < {fraction}"


def balanced_sample(per_label: int, seed: int) -> str:
    u = hash_unit_sql(_L + _R + ['"Label"'], seed)
    cols = ", ".join(_L + _R)
    return _with(PEOPLE_CTE, pairs_cte("one_or_two"), features_cte("rules"), LABEL_SQL) + f"""
SELECT {cols}, "Label" FROM (
  SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY {u}, {cols}, "Label") AS rn
  FROM labelled) WHERE rn <= {per_label}"""


def rule_confusion() -> str:
    """A6 on a rule prediction from the simple features against the rule labels."""
    feat_simple = features_cte("simple", name="fs")
    return _with(PEOPLE_CTE, pairs_cte("one_or_two"), features_cte("rules"), LABEL_SQL,
                 feat_simple) + """
, pred AS (
  SELECT l."Label", CASE WHEN s.f2 >= 0.85 AND s.f3 >= 0.85 THEN 'T'
                         WHEN greatest(s.f4, s.f5, s.f6) < 0.5 THEN 'F' ELSE 'U' END AS "predictedLabel"
  FROM labelled l JOIN fs s USING ("Prefix", "Firstname", "Lastname", "Prefix_1", "Firstname_1", "Lastname_1"))
, grid AS (SELECT p AS "predictedLabel", l AS "Label"
           FROM (VALUES ('T'), ('F'), ('U')) a(p), (VALUES ('T'), ('F'), ('U')) b(l))
SELECT g."predictedLabel", g."Label", coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN (SELECT "predictedLabel", "Label", count(*) AS n FROM pred GROUP BY 1, 2) c
  USING ("predictedLabel", "Label")"""


# ---------------------------------------------------------------- entity states
ENTITY_CTE = """
ces AS (
  SELECT l_orderkey * 8 + l_linenumber AS _id, l_orderkey AS commit_id, l_partkey AS file_id,
         CASE WHEN l_returnflag = 'R' THEN 'class' WHEN l_returnflag = 'A' THEN 'method'
              ELSE 'file' END AS ce_type,
         l_extendedprice AS "LOC", l_quantity AS "WMC", l_tax AS "CBO"
  FROM lineitem)"""


def entity_states_logical() -> str:
    return _with(ENTITY_CTE) + 'SELECT _id, commit_id, file_id, ce_type, "LOC", "WMC", "CBO" FROM ces'


def size_regression_coefficients(fraction: float, seed: int, digits: int) -> str:
    cols = ['CAST("LOC" AS DECIMAL(38,6))', 'CAST("WMC" AS DECIMAL(38,6))',
            'CAST("CBO" AS DECIMAL(38,6))']
    u = hash_unit_sql(cols, seed)
    return _with(ENTITY_CTE) + f"""
, train AS (SELECT "LOC" AS y, "WMC" AS x1, "CBO" AS x2 FROM ces
            WHERE ce_type = 'class' AND {u} < {fraction})
, s AS (SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
               covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y,
               avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM train)
, b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
               (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM s)
SELECT term, round(estimate, {digits}) AS estimate FROM (
  SELECT '(Intercept)' AS term, my - b1 * m1 - b2 * m2 AS estimate FROM b
  UNION ALL SELECT 'WMC', b1 FROM b
  UNION ALL SELECT 'CBO', b2 FROM b)"""


def bug_inducing_count(match: str) -> str:
    return _inducing_pairs(match) + \
        "SELECT count(*) AS n_inducing FROM (SELECT DISTINCT inducing_commit_id FROM pairs)"


def developer_activity_top(fmt: str, n: int) -> str:
    cols = ['"Date"', '"ID"', "comments", "messages", "commits", "bug_fix"]
    order = ", ".join(f"{c} NULLS FIRST" for c in cols)
    return f"SELECT * FROM ({developer_activity(fmt, False)}) ORDER BY {order} LIMIT {n}"


# ---------------------------------------------------------------- matchers
def _hash_text(cols: list[str], seed: int) -> str:
    return hash_unit_sql(cols, seed)


def _person_labels_cte(seed: int, uncertain: float = 0.1, wrong: float = 0.02) -> str:
    cols, u = ", ".join(_L + _R), _hash_text(_L + _R, seed)
    one = ", ".join(f"a.{c}" for c in _L) + ", " + ", ".join(f"b.{c} AS {r}" for c, r in zip(_L, _R))
    records = """
records AS (
  SELECT lower(regexp_replace(split_part(email, '@', 1), '[^a-zA-Z]', '', 'g')) AS "Prefix",
         lower(regexp_replace(split_part(name, ' ', 1), '[^a-zA-Z]', '', 'g')) AS "Firstname",
         lower(regexp_replace(split_part(rtrim(name, ' '), ' ', -1), '[^a-zA-Z]', '', 'g')) AS "Lastname", _id // 4 AS person
  FROM people_t WHERE name IS NOT NULL AND email IS NOT NULL)"""
    return f"""{records},
same AS (SELECT DISTINCT {one}, TRUE AS same FROM records a JOIN records b ON a.person = b.person),
drawn AS (SELECT cand.*, coalesce(same, FALSE) AS same, {u} AS u FROM cand LEFT JOIN same USING ({cols})),
plabel AS (SELECT {cols}, CASE WHEN u < {uncertain} THEN 'U'
                               WHEN same <> (u >= {uncertain} AND u < {uncertain} + {wrong}) THEN 'T' ELSE 'F' END AS "Label" FROM drawn)"""


def person_labels(seed: int) -> str:
    return _with(PEOPLE_CTE, pairs_cte("one_or_two"), _person_labels_cte(seed)) + "SELECT * FROM plabel"


def matcher_split_totals(seed: int, fraction: float, split_seed: int) -> str:
    u = _hash_text(_L + _R, split_seed)
    return _with(PEOPLE_CTE, pairs_cte("one_or_two"), _person_labels_cte(seed)) + f"""
SELECT CASE WHEN {u} < {fraction}::DOUBLE THEN 'train' ELSE 'test' END AS part, "Label", count(*) AS n FROM plabel GROUP BY 1, 2"""


def matcher_label_index(seed: int) -> str:
    return _with(PEOPLE_CTE, pairs_cte("one_or_two"), _person_labels_cte(seed)) + """
SELECT "Label" AS label, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, "Label") - 1 AS INTEGER) AS index
FROM plabel GROUP BY "Label"
"""


def matcher_feature_index(features: list[str], most: int) -> str:
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM feat" for f in features)
    return _with(PEOPLE_CTE, pairs_cte("one_or_two"), features_cte("rules")) + f"""
, v AS (SELECT DISTINCT feature, value FROM ({rows}) WHERE value IS NOT NULL)
, few AS (SELECT *, count(*) OVER (PARTITION BY feature) AS k FROM v)
SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value <> 0, value) - 1 AS INTEGER) AS index
FROM few WHERE k <= {most}"""


def fixed_tree(seed: int, tree: str, labels: list[str], boosted: list[str] = (), weights: list[float] = ()) -> str:
    cols = ", ".join(_L + _R)
    names = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    vote = " + ".join(f"{w!r} * {t}" for t, w in zip(boosted, weights))
    extra = f", CASE WHEN {vote} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS boosted" if boosted else ""
    return _with(PEOPLE_CTE, pairs_cte("one_or_two"), _person_labels_cte(seed), features_cte("rules", "plabel")) + f"""
, pred AS (SELECT {cols}, "Label", {names}[CAST({tree} AS INTEGER) + 1] AS "predictedLabel"{extra} FROM feat)
"""


FIXED_TREE_QUERIES = {
    "errors": 'SELECT * FROM pred WHERE "Label" <> "predictedLabel"',
    "accuracy": """SELECT round(avg(CASE WHEN "Label" = "predictedLabel" THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy, count(*) AS n,
       round(1.0::DOUBLE - avg(CASE WHEN "Label" = "predictedLabel" THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS test_error FROM pred""",
    "confusion": """SELECT g."predictedLabel", g."Label", coalesce(c.n, 0) AS n
FROM (SELECT p AS "predictedLabel", l AS "Label" FROM (VALUES ('T'), ('F'), ('U')) a(p), (VALUES ('T'), ('F'), ('U')) b(l)) g
LEFT JOIN (SELECT "predictedLabel", "Label", count(*) AS n FROM pred GROUP BY 1, 2) c USING ("predictedLabel", "Label")""",
    "errors_sql": """SELECT "Label", "predictedLabel", count(*) AS n, min("Lastname") AS first_name FROM pred
WHERE "Label" <> "predictedLabel" GROUP BY 1, 2""",
}


def people_joined_names() -> str:
    return _with(PEOPLE_CTE) + """SELECT "Prefix" || ' ' || "Firstname" || ' ' || "Lastname" AS joined,
       contains("Prefix", "Lastname") AS holds_last FROM persons"""


def labelled_csv(seed: int) -> str:
    cols = ", ".join(f"nullif({c}, '') AS {c}" for c in _L + _R)
    return _with(PEOPLE_CTE, pairs_cte("one_or_two"), _person_labels_cte(seed)) + f'SELECT {cols}, "Label" FROM plabel'


# ---------------------------------------------------------------- dumps
def dump_commits() -> str:
    return """
SELECT CAST(event_id AS VARCHAR) AS _id, CAST(user_id AS VARCHAR) AS committer_id, epoch_us(ts) // 1000 AS committed_ms,
       CASE WHEN event_id % 2 = 0 THEN 'say "' || event_type || '"' || chr(10) ELSE event_type END AS message,
       CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END END AS n_file_actions
FROM events WHERE event_id % 50 NOT IN (7, 9)"""


def dump_dead_letters() -> str:
    return """
SELECT left('{"_id":"' || event_id || '","committer_id":' || user_id || ',"committer_date":"', 20) AS line, 'no document' AS reason
FROM events WHERE event_id % 50 = 7
UNION ALL SELECT '{"message":"' || event_type || '"}', 'no id' FROM events WHERE event_id % 50 = 9"""


def dump_file_actions() -> str:
    return """
WITH a AS (
  SELECT 'a' || event_id AS _id, event_id, props, user_id FROM events
  UNION ALL SELECT 'b' || event_id, event_id, props, user_id FROM events WHERE event_id % 6 = 0)
SELECT _id, CAST(event_id AS VARCHAR) AS commit_id,
       CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 + user_id % 10 AS VARCHAR) AS file_id
FROM a"""


def entity_states_registry() -> str:
    return """SELECT l_orderkey * 8 + l_linenumber AS _id, l_orderkey AS commit_id, l_partkey AS file_id, l_extendedprice AS "LOC",
       l_quantity AS "WMC", l_tax AS "CBO", l_discount AS "NOM" FROM lineitem"""


# ---------------------------------------------------------------- regression
_GLM_COLS = ['CAST("LOC" AS DECIMAL(38,6))', 'CAST("WMC" AS DECIMAL(38,6))', 'CAST("CBO" AS DECIMAL(38,6))']


def size_regression_fit(fraction: float, seed: int) -> str:
    u = hash_unit_sql(_GLM_COLS, seed)
    f = lambda c: f"printf('%.5e', {c}) AS {c}"
    return _with(ENTITY_CTE) + f"""
, train AS (SELECT "LOC" AS y, "WMC" AS x1, "CBO" AS x2 FROM ces WHERE ce_type = 'class' AND {u} < {fraction})
, s AS (SELECT count(*) AS n, count(*) * var_pop(x1) AS s11, count(*) * var_pop(x2) AS s22, count(*) * covar_pop(x1, x2) AS s12,
               count(*) * covar_pop(x1, y) AS s1y, count(*) * covar_pop(x2, y) AS s2y, count(*) * var_pop(y) AS syy,
               avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM train)
, b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
               (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s)
, d AS (SELECT *, syy - b1 * s1y - b2 * s2y AS deviance FROM b)
, v AS (SELECT *, deviance / (n - 3) AS dispersion FROM d)
, t AS (
  SELECT '(Intercept)' AS term, my - b1 * m1 - b2 * m2 AS estimate,
         sqrt(dispersion * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS std_error, * FROM v
  UNION ALL SELECT 'WMC', b1, sqrt(dispersion * s22 / det), * FROM v
  UNION ALL SELECT 'CBO', b2, sqrt(dispersion * s11 / det), * FROM v)
, o AS (SELECT term, n, n - 3 AS df_residual, estimate, std_error, estimate / std_error AS t_value, deviance, syy AS null_deviance, dispersion,
               n * (ln(2 * pi() * deviance / n) + 1) + 2 + 6 AS aic FROM t)
SELECT term, n, df_residual, {", ".join(map(f, ["estimate", "std_error", "t_value", "deviance", "null_deviance", "dispersion", "aic"]))} FROM o"""


def size_regression_test_rows(fraction: float, seed: int) -> str:
    u = hash_unit_sql(_GLM_COLS, seed)
    return _with(ENTITY_CTE) + f"""
, class AS (SELECT "LOC", "WMC", "CBO" FROM ces WHERE ce_type = 'class')
SELECT * FROM class EXCEPT SELECT * FROM class WHERE {u} < {fraction}"""


def defect_score_equations() -> str:
    return _with(COMMIT_CTE, ENTITY_CTE) + f"""
, rows AS (SELECT ces.*, CASE WHEN regexp_matches(message, '{BUGFIX_RE}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y
           FROM ces JOIN commit_t ON ces.commit_id = commit_t._id WHERE ce_type = 'class' AND message IS NOT NULL)
, s AS (SELECT '(Intercept)' AS term, avg(y) AS v FROM rows UNION ALL SELECT 'LOC', avg("LOC" * y) FROM rows
        UNION ALL SELECT 'WMC', avg("WMC" * y) FROM rows UNION ALL SELECT 'CBO', avg("CBO" * y) FROM rows)
SELECT term, printf('%.3e', v) AS observed, printf('%.3e', v) AS fitted FROM s"""
