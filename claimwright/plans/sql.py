"""Shared common table expressions of the SQL twins (DuckDB)."""

from __future__ import annotations

CLAIMS = """
line AS (
  SELECT l_orderkey, CAST(MIN(l_shipdate) AS DATE) AS claim_date, MIN(l_partkey) AS part_key,
    SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity * 10 END) AS special_care,
    SUM(CASE WHEN l_returnflag = 'N' THEN l_quantity * 20 END) AS special_earnings,
    SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity * 30 END) AS special_medical,
    SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity * 5 END) AS general_rest,
    SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity * 15 END) AS general_pain
  FROM lineitem GROUP BY l_orderkey),
claims AS (
  SELECT o_orderkey AS claim_id,
    CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN 'Yes' ELSE 'No' END
      AS exceptional_circumstances,
    CASE WHEN o_orderkey % 251 = 0 THEN 'Rare-' || CAST(o_orderkey % 7 AS VARCHAR)
      ELSE substring(o_orderpriority, 3) END AS accident_type,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS whiplash,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS minor_psychological_injury,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Severe fracture' WHEN o_orderkey % 13 = 0 THEN 'MAJOR burn'
      WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'Soft tissue' END AS injury_description,
    c_mktsegment AS vehicle_type,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS accident_date,
    claim_date, special_care, special_earnings, special_medical, general_rest, general_pain,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(18 + o_custkey % 60 AS DOUBLE) END AS driver_age,
    CAST(p_size AS DOUBLE) AS vehicle_age,
    CASE WHEN o_orderkey % 101 = 0 THEN NULL
      WHEN o_orderkey % 499 = 0 THEN CAST('NaN' AS DOUBLE)
      WHEN o_orderkey % 503 = 0 THEN CAST('Infinity' AS DOUBLE)
      ELSE 0.5::DOUBLE * (coalesce(special_care, 0) + coalesce(special_earnings, 0) + coalesce(special_medical, 0))
        + 0.8::DOUBLE * (coalesce(general_rest, 0) + coalesce(general_pain, 0))
        + CASE WHEN o_orderkey % 23 = 0 THEN 900 ELSE 0 END
        + CASE WHEN o_orderpriority LIKE '1%' THEN 400 ELSE 0 END
        + o_custkey % 100 END AS settlement_value
  FROM orders LEFT JOIN line ON l_orderkey = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN part ON p_partkey = part_key)"""

FINITE = """
finite AS (SELECT * FROM claims
  WHERE settlement_value IS NOT NULL AND isfinite(settlement_value))"""

TRIMMED = """
trimmed AS (SELECT * FROM finite
  WHERE settlement_value <= (SELECT quantile_cont(settlement_value, 0.999) FROM finite))"""

IMPUTED = """
med AS (SELECT median(special_care) AS m1, median(special_earnings) AS m2, median(special_medical) AS m3,
  median(general_rest) AS m4, median(general_pain) AS m5, median(driver_age) AS m6,
  median(vehicle_age) AS m7 FROM trimmed),
imputed AS (SELECT claim_id,
  coalesce(exceptional_circumstances, 'Unknown') AS exceptional_circumstances,
  coalesce(accident_type, 'Unknown') AS accident_type, coalesce(whiplash, 'Unknown') AS whiplash,
  coalesce(minor_psychological_injury, 'Unknown') AS minor_psychological_injury,
  coalesce(injury_description, 'Unknown') AS injury_description,
  coalesce(vehicle_type, 'Unknown') AS vehicle_type, accident_date, claim_date,
  coalesce(special_care, m1) AS special_care, coalesce(special_earnings, m2) AS special_earnings,
  coalesce(special_medical, m3) AS special_medical, coalesce(general_rest, m4) AS general_rest,
  coalesce(general_pain, m5) AS general_pain, coalesce(driver_age, m6) AS driver_age,
  coalesce(vehicle_age, m7) AS vehicle_age, settlement_value AS y
  FROM trimmed, med)"""

BASE = """
totals AS (SELECT *, special_care + special_earnings + special_medical AS total_special,
  general_rest + general_pain AS total_general,
  date_diff('day', accident_date, claim_date) AS days_to_claim,
  CASE WHEN regexp_matches(lower(injury_description), 'severe|major|critical') THEN 1 ELSE 0 END AS severe_injury,
  CASE WHEN whiplash = 'Yes' THEN 1 ELSE 0 END AS whiplash_flag,
  CASE WHEN minor_psychological_injury = 'Yes' THEN 1 ELSE 0 END AS psych_flag,
  (claim_id * 2654435761) % 4294967296 % 5 AS fold,
  (claim_id * 2654435761) % 4294967296 // 5 % 5 AS inner_fold FROM imputed),
base AS (SELECT *, total_special + total_general AS total_damages,
  total_special / CASE WHEN total_general = 0 THEN 1 ELSE total_general END AS special_general_ratio,
  CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS split FROM totals)"""

SEGMENTED = """
pair AS (SELECT exceptional_circumstances AS p, accident_type AS s, count(*) AS n FROM base GROUP BY 1, 2),
prim AS (SELECT p, sum(n) AS pn FROM pair GROUP BY 1),
label AS (SELECT p, s, n, CASE WHEN pn < 50 THEN NULL WHEN pn < 150 THEN p
  WHEN n >= 50 THEN p || '_' || s END AS seg FROM pair JOIN prim USING (p)),
rest AS (SELECT coalesce(sum(n), 0) AS n_rest FROM label WHERE seg IS NULL),
dict AS (SELECT p, s, n, coalesce(seg, CASE WHEN n_rest >= 50 THEN 'Other' END) AS segment FROM label, rest),
seg AS (SELECT base.*, segment FROM base JOIN dict ON p = exceptional_circumstances AND s = accident_type
  WHERE segment IS NOT NULL)"""


def on_claims(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([CLAIMS, *ctes]) + "\n" + body


def on_trimmed(body: str, *ctes: str) -> str:
    return on_claims(body, FINITE, TRIMMED, *ctes)


def on_base(body: str, *ctes: str) -> str:
    return on_trimmed(body, IMPUTED, BASE, *ctes)


def on_segments(body: str, *ctes: str) -> str:
    return on_base(body, SEGMENTED, *ctes)


def metrics(y: str = "y", p: str = "prediction") -> str:
    """Metric columns, rounded as the queries round them."""
    return (
        f"count(*) AS n, round(avg(({y}-{p})*({y}-{p})), 4) + 0.0 AS mse, "
        f"round(sqrt(avg(({y}-{p})*({y}-{p}))), 4) + 0.0 AS rmse, round(avg(abs({y}-{p})), 4) + 0.0 AS mae, "
        f"round(1 - sum(({y}-{p})*({y}-{p})) / nullif(var_pop({y}) * count(*), 0), 6) + 0.0 AS r2"
    )
