"""The graph view in SQL, for the oracles."""

from __future__ import annotations

PART_FILE = "p_brand || '/' || p_type || '/' || replace(p_name, ' ', '_') || CASE WHEN p_size % 7 = 0 THEN '.test.ts' ELSE '.ts' END"
_START = "CAST({c} % 40 * 10 + 1 AS INTEGER)"

NODES = f"""nodes0 AS (
    SELECT 'P:' || p_partkey AS id, p_name AS name, {PART_FILE} AS file, {_START.format(c="p_partkey")} AS start_line,
        CASE p_partkey % 10 WHEN 7 THEN 'Interface' WHEN 8 THEN 'Type' WHEN 9 THEN 'Module' ELSE 'Function' END AS kind,
        CAST(p_size AS DOUBLE) AS complexity, CAST(p_size % 18 AS DOUBLE) AS cognitive, p_partkey AS ord FROM part
    UNION ALL SELECT 'S:' || s_suppkey, s_name, 'suppliers/' || s_nationkey || '/api.ts', {_START.format(c="s_suppkey")}, 'Function', NULL, NULL, s_suppkey FROM supplier
    UNION ALL SELECT 'C:' || c_custkey, c_name, 'customers/' || c_mktsegment || '/' || c_nationkey || '.ts', {_START.format(c="c_custkey")}, 'Function', NULL, NULL, c_custkey FROM customer
    UNION ALL SELECT 'O:' || o_orderkey, 'order ' || o_orderkey, 'orders/' || o_orderpriority || '/' || (o_orderkey % 50) || CASE WHEN o_orderstatus = 'P' THEN '.test.ts' ELSE '.ts' END, {_START.format(c="o_orderkey")}, 'Function', NULL, NULL, o_orderkey FROM orders
    UNION ALL SELECT 'N:' || n_nationkey, n_name, 'geo/nation.ts', {_START.format(c="n_nationkey")}, 'Function', NULL, NULL, n_nationkey FROM nation
    UNION ALL SELECT 'R:' || r_regionkey, r_name, 'geo/region.ts', {_START.format(c="r_regionkey")}, 'Function', NULL, NULL, r_regionkey FROM region
), nodes AS MATERIALIZED (SELECT *, start_line + 8 AS end_line, file LIKE '%.test.%' AS test FROM nodes0)"""

EDGES = """edges AS MATERIALIZED (
    SELECT 'O:' || l_orderkey AS src, 'P:' || l_partkey AS dst, CASE WHEN max(l_returnflag) = 'R' THEN 'USAGE' ELSE 'CALLS' END AS kind, l_orderkey * 10000000 + l_partkey AS ord FROM lineitem GROUP BY l_orderkey, l_partkey
    UNION ALL SELECT 'P:' || l_partkey, 'S:' || min(l_suppkey), 'CALLS', l_partkey FROM lineitem GROUP BY l_partkey
    UNION ALL SELECT 'C:' || o_custkey, 'O:' || o_orderkey, 'CALLS', o_orderkey FROM orders
    UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'USAGE', s_suppkey FROM supplier
    UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'USAGE', c_custkey FROM customer
    UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'USAGE', n_nationkey FROM nation
)"""

FILES = f"files AS (SELECT {PART_FILE} AS file, change_count, p_partkey AS ord FROM part JOIN (SELECT l_partkey, count(*) AS change_count FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey)"

COCHANGE = """seen AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
cn AS (SELECT b, count(*) AS n FROM seen GROUP BY b),
copairs AS (SELECT x.b AS file, y.b AS partner, count(*) AS co_changes, least(1.0::DOUBLE, count(*)::DOUBLE * 5 / least(any_value(m.n), any_value(k.n))) AS score
    FROM seen x JOIN seen y ON x.o = y.o AND x.b < y.b JOIN cn m ON m.b = x.b JOIN cn k ON k.b = y.b GROUP BY 1, 2)"""

CALLS = """calls AS (SELECT 'O:' || l_orderkey AS source, 'P:' || l_partkey AS target,
    CASE l_returnflag WHEN 'A' THEN 'import_map' WHEN 'N' THEN 'lsp_ts_import' ELSE 'suffix_match' END AS strategy,
    1 - l_discount * 2 AS confidence, l_orderkey * 100 + l_linenumber AS ord FROM lineitem)"""

SIMILAR = """simpairs AS (SELECT 'P:' || a.p_partkey AS a, 'P:' || b.p_partkey AS b, 1 - abs(a.p_size - b.p_size)::DOUBLE / 50 AS score
    FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey)"""

COVERAGE = f"""pf AS (SELECT p_partkey, {PART_FILE} AS file, p_brand, CAST(p_partkey % 40 * 10 + 1 AS INTEGER) AS start FROM part),
covered AS (SELECT DISTINCT file, start + l_linenumber AS line FROM lineitem JOIN pf ON l_partkey = p_partkey WHERE l_returnflag = 'A'),
fns AS (SELECT file, 'f:' || p_partkey AS name, start AS line FROM pf),
fhits AS (SELECT file, 'f:' || p_partkey AS name, count(*) FILTER (l_returnflag = 'A') AS hits FROM lineitem JOIN pf ON l_partkey = p_partkey GROUP BY 1, 2)"""

CHANGE = f"""big AS (SELECT p_partkey, {PART_FILE} AS file, p_brand, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 48),
changed AS (SELECT file, min(p_partkey) AS ord FROM big GROUP BY file),
listed AS (SELECT DISTINCT file FROM big WHERE p_brand <> 'Brand#5'),
ranges AS (SELECT DISTINCT file, CAST(p_partkey % 40 * 10 + l_linenumber AS INTEGER) AS s, CAST(p_partkey % 40 * 10 + l_linenumber + 2 AS INTEGER) AS e FROM big WHERE p_brand <> 'Brand#5')"""


def section(file: str, entries: list[str]) -> str:
    ordered = sorted(entries, key=lambda p: (-len(p), p))
    return "CASE " + " ".join(f"WHEN {file} = '{p}' OR starts_with({file}, '{p}/') THEN '{p}'" for p in ordered) + " END"
