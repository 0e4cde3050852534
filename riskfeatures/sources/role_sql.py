"""Role views: the reference's table roles bound onto the driver tables.

Each entry is portable SQL text that runs unchanged in Spark SQL and DuckDB
(FIXTURES.md §4).  Spark registers them as temp views over the parquet
tables; the DuckDB oracles use the same text as a WITH prefix.
"""

from __future__ import annotations

ROLE_SQL: dict[str, str] = {
    "task": """
WITH o AS (
  SELECT *, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 41 - 20 AS INT) AS sd FROM orders),
p AS (
  SELECT *, sd + CAST(o_orderkey % 119 - 2 AS INT) AS ed,
    CASE o_orderstatus WHEN 'F' THEN 'completed'
      WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'not_started' ELSE 'ongoing' END
      ELSE CASE o_orderkey % 4 WHEN 0 THEN 'terminated' WHEN 1 THEN 'archived'
                               WHEN 2 THEN 'in_progress' ELSE 'completed' END END AS st
  FROM o)
SELECT o_orderkey AS id, st AS status,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'approved' WHEN '2' THEN 'in_review'
       WHEN '3' THEN 'pending' WHEN '4' THEN 'rejected' END AS approval_status,
  CASE o_orderkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' ELSE 'escalated' END AS lead_approval_status,
  CASE WHEN substr(o_orderpriority,1,1) IN ('1','2') THEN 'high'
       WHEN substr(o_orderpriority,1,1) = '5' THEN 'low' ELSE 'mid' END AS weight_level,
  (o_orderkey % 3 <> 0) AS is_planned, (o_orderkey % 7 = 0) AS is_overdue,
  CAST(o_orderkey % 11 AS INT) AS risk_mapping,
  sd AS start_date, CASE WHEN o_orderkey % 997 = 5 THEN NULL ELSE ed END AS end_date,
  CASE WHEN st = 'completed' AND o_orderkey % 2 = 0
       THEN ed + CAST(o_custkey % 21 - 10 AS INT) END AS actual_end_date,
  o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS created_date,
  o_orderdate + (o_orderkey % 200) * INTERVAL '1' DAY AS updated_date,
  o_custkey AS major_activity_id,
  CASE WHEN o_orderkey % 21 <> 0 THEN o_custkey END AS position_id,
  CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_custkey % 25 AS INT) END AS department_id,
  CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey % 130 END AS derived_from_cross_department_assignment_id
FROM p
""",
    "position": """
SELECT c_custkey AS id, c_nationkey AS department_id, CASE WHEN c_custkey % 17 <> 0 THEN c_custkey % 97 END AS user_id, c_mktsegment AS position_name FROM customer
""",
    "major_activity": """
SELECT c_custkey AS id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'not_started' WHEN 'MACHINERY' THEN 'ongoing' WHEN 'FURNITURE' THEN 'completed' WHEN 'HOUSEHOLD' THEN 'terminated' END AS status,
  CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_review' WHEN 2 THEN 'approved' ELSE 'rejected' END AS approval_status,
  CASE WHEN c_custkey % 19 <> 0 THEN c_nationkey END AS kpi_id FROM customer
""",
    "kpi": """
SELECT n_nationkey AS id, (n_nationkey % 3 = 0) AS is_overdue,
  CASE n_nationkey % 5 WHEN 0 THEN 'not_started' WHEN 1 THEN 'ongoing' WHEN 2 THEN 'completed' WHEN 3 THEN 'terminated' ELSE 'archived' END AS status,
  CAST(n_nationkey % 6 AS DOUBLE) AS planned_kpi, CAST(n_nationkey % 11 AS DOUBLE) AS achieved_kpi,
  n_regionkey AS goal_id, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey % 7 END AS milestone_id FROM nation
""",
    "goal": """
SELECT r_regionkey AS id, r_name AS goal_name, CAST(1996 + r_regionkey AS INT) AS year FROM region
""",
    "goal_pillar": """
SELECT r_regionkey AS goal_id, r_regionkey % 3 AS pillar_id FROM region UNION ALL SELECT r_regionkey, 3 FROM region WHERE r_regionkey % 2 = 0
""",
    "milestone": """
SELECT DISTINCT n_nationkey % 7 AS id, n_nationkey % 7 % 3 AS ksi_id, (n_nationkey % 7 % 2 = 0) AS is_overdue, DATE '1999-06-30' + CAST(CASE n_nationkey % 7 WHEN 0 THEN -545 WHEN 1 THEN 0 WHEN 2 THEN 15 WHEN 3 THEN 60 WHEN 4 THEN 120 WHEN 5 THEN 300 ELSE 800 END AS INT) AS end_date FROM nation
""",
    "ksi": """
SELECT DISTINCT n_nationkey % 3 AS id, (n_nationkey % 3 = 1) AS is_overdue, CASE n_nationkey % 3 WHEN 0 THEN 'ongoing' WHEN 1 THEN 'completed' ELSE 'not_started' END AS status FROM nation
""",
    "task_history": """
SELECT l_orderkey AS history_relation_id, l_shipdate AS history_date, l_partkey * 10 + l_linenumber AS history_id,
  CASE WHEN l_linenumber = 1 THEN '+' WHEN l_linenumber = 7 THEN '-' ELSE '~' END AS history_type,
  CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'A' THEN 'ongoing' WHEN l_returnflag = 'R' THEN 'in_progress' ELSE 'not_started' END AS status,
  CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'pending' END AS approval_status,
  CASE WHEN l_linestatus = 'F' THEN 'approved' ELSE 'in_review' END AS lead_approval_status FROM lineitem
""",
    "sub_task": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS task_id, min(l_shipdate) AS created_date,
  CASE WHEN max(l_quantity) > 25 THEN 'completed' ELSE 'ongoing' END AS status, (max(l_tax) >= 0.06) AS is_overdue
FROM lineitem GROUP BY l_orderkey, l_linenumber
""",
    "sub_task_history": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS history_date, l_partkey AS history_id,
  CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'ongoing' ELSE 'not_started' END AS status FROM lineitem
""",
    "major_activity_history": """
SELECT o_custkey AS id, o_orderdate + INTERVAL '10' DAY AS history_date, o_orderkey AS history_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'ongoing' ELSE 'not_started' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_review' WHEN 2 THEN 'approved' ELSE 'rejected' END AS approval_status FROM orders
""",
    "kpi_history": """
SELECT CAST(l_suppkey % 25 AS INT) AS id, l_shipdate AS history_date, l_orderkey * 10 + l_linenumber AS history_id, l_partkey AS history_seq,
  (l_linestatus = 'F') AS is_overdue, CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'ongoing' ELSE 'not_started' END AS status FROM lineitem
""",
    "comment": """
SELECT event_id AS id, user_id AS object_id, CASE event_type WHEN 'view' THEN 24 WHEN 'click' THEN 23 WHEN 'purchase' THEN 22 ELSE 21 END AS content_type_id,
  ts - 9500 * INTERVAL '1' DAY AS created_date FROM events
""",
    "cross_dept_assignment": """
SELECT s_suppkey AS id, s_nationkey AS assigning_department_id, CAST((s_nationkey + s_suppkey) % 25 AS INT) AS assigned_department_id FROM supplier
""",
    "task_challenge": """
SELECT user_id AS task_id, CAST(event_id % 9 AS INT) AS challengegroup_id FROM events WHERE event_type = 'error'
""",
    "subtask_challenge": """
SELECT l_orderkey * 10 + CASE WHEN l_partkey % 100 = 0 THEN l_linenumber ELSE 9 END AS subtask_id, CAST(l_partkey % 9 AS INT) AS challengegroup_id FROM lineitem
""",
    "kpi_challenge": """
SELECT CAST(user_id % 4 * 7 AS INT) AS kpi_id, CAST(event_id % 9 AS INT) AS challengegroup_id FROM events WHERE event_type = 'signup'
""",
    "kpi_potential_challenge": """
SELECT CAST(user_id % 12 * 2 AS INT) AS kpi_id, CAST(event_id % 9 AS INT) AS challengegroup_id FROM events WHERE event_type = 'purchase'
""",
    "challenge_group": """
SELECT n_nationkey AS id, n_name AS challenge_group_name FROM nation
""",
    "kpi_resource_type": """
SELECT CAST(s_suppkey % 25 AS INT) AS kpi_id, CAST(s_suppkey % 4 AS INT) AS resourcetype_id FROM supplier
""",
    "ksi_goal": """
SELECT DISTINCT n_nationkey % 3 AS ksi_id, n_regionkey AS goal_id FROM nation
""",
    "scored": """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS label,
  CAST((o_orderkey * 37 + CASE WHEN o_orderstatus = 'F' THEN 300 ELSE 0 END) % 1000 AS DOUBLE) / 1000 AS score FROM orders
""",
    "text_rows": """
SELECT doc_id AS id, text, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE source END AS source FROM documents
""",
}
