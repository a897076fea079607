"""Expected results: catalogs and DDL."""

ORACLES: dict[str, str] = {}

ORACLES["catalog_of_hosts"] = """
SELECT host, database, name, engine FROM fx_catalog WHERE host IN (SELECT host FROM fx_hosts WHERE phase = 'Scale')
"""

SCANNED = """
scanned AS (
  SELECT c.* FROM fx_catalog c WHERE host IN (SELECT host FROM fx_hosts WHERE available)
)
"""
_REWRITE = "regexp_replace({}, 'CREATE (TABLE|VIEW|MATERIALIZED VIEW)', 'CREATE \\1 IF NOT EXISTS')"
_TARGET_DATABASE_PATTERN = "'Distributed\\([^,]+, *''?([^,'']+)''?, *[^,]+'"
_TARGET_TABLE_PATTERN = "'Distributed\\([^,]+, [^,]+, *''?([^,'')]+)'"
_TARGET_DATABASE = f"regexp_extract(engine_full, {_TARGET_DATABASE_PATTERN}, 1)"
_TARGET_TABLE = f"regexp_extract(engine_full, {_TARGET_TABLE_PATTERN}, 1)"


def _rewrite(column: str) -> str:
    return _REWRITE.format(column)


ORACLES["catalog_scan"] = f"""
WITH {SCANNED}
SELECT host, database, name, engine, engine_full, create_table_query FROM scanned
"""
ORACLES["first_available_snapshot"] = """
WITH chosen AS (SELECT cluster, min(host) AS host FROM fx_hosts WHERE available GROUP BY cluster)
SELECT cluster, host, database, name FROM fx_catalog JOIN chosen USING (host)
"""
ORACLES["replica_database_ddl"] = f"""
WITH {SCANNED}
SELECT DISTINCT database AS name, 'CREATE DATABASE IF NOT EXISTS "' || database || '"' AS statement
FROM scanned WHERE database <> 'system'
"""
ORACLES["replica_table_ddl"] = f"""
WITH {SCANNED}
SELECT DISTINCT name, {_rewrite("create_table_query")} AS statement
FROM scanned WHERE database <> 'system' AND create_table_query <> '' AND name NOT LIKE '.inner.%'
"""
ORACLES["distributed_database_ddl"] = f"""
WITH {SCANNED}
SELECT DISTINCT d AS name, 'CREATE DATABASE IF NOT EXISTS "' || d || '"' AS statement
FROM (SELECT unnest([database, {_TARGET_DATABASE}]) AS d FROM scanned WHERE engine = 'Distributed') WHERE d <> ''
"""
# The catalog without its hosts, and the tables that distributed tables of it point to.
LOCAL = f"""
folded AS MATERIALIZED (
  SELECT DISTINCT database, name, engine, engine_full, create_table_query FROM scanned
),
locals AS MATERIALIZED (
  SELECT DISTINCT t.database, t.name, t.create_table_query
  FROM folded t JOIN folded d ON d.engine = 'Distributed'
    AND t.database = regexp_extract(d.engine_full, {_TARGET_DATABASE_PATTERN}, 1) AND t.name = regexp_extract(d.engine_full, {_TARGET_TABLE_PATTERN}, 1)
  WHERE t.create_table_query <> ''
)
"""
ORACLES["distributed_local_tables"] = f"WITH {SCANNED}, {LOCAL} SELECT * FROM locals"
ORACLES["distributed_ddl"] = f"""
WITH {SCANNED}, {LOCAL}
SELECT name, statement, min(ord)::INT AS ord FROM (
  SELECT database || '.' || name AS name, {_rewrite("create_table_query")} AS statement, 2 AS ord
  FROM scanned WHERE engine = 'Distributed'
  UNION ALL
  SELECT database || '.' || name, {_rewrite("create_table_query")}, 1 FROM locals
) GROUP BY name, statement
"""
# Each new replica meets every statement that another available host of its cluster offers.
ORACLES["schema_sync_plan"] = f"""
WITH targets AS MATERIALIZED (SELECT * FROM fx_hosts WHERE phase = 'Ready' AND state <> 'Sync'),
offers AS MATERIALIZED (
  SELECT h.cluster, h.host, h.shard, h.phase = 'Normal' AS normal, c.part, c.database, c.name, c.engine, c.engine_full, c.create_table_query
  FROM fx_hosts h JOIN fx_catalog c ON c.host = h.host WHERE h.available
),
shard_rows AS MATERIALIZED (
  SELECT t.cluster, t.shard, t.ordinal, min(o.database) AS database, min(o.name) AS name, min(o.create_table_query) AS create_table_query
  FROM targets t JOIN offers o ON o.cluster = t.cluster AND o.shard = t.shard AND o.normal
  WHERE t.replicas_count > 1 AND o.database <> 'system' GROUP BY t.cluster, t.shard, t.ordinal, o.part
),
cluster_rows AS MATERIALIZED (
  SELECT t.cluster, t.shard, t.ordinal, min(o.database) AS database, min(o.name) AS name, min(o.engine) AS engine,
         min({_TARGET_DATABASE}) AS to_database, min({_TARGET_TABLE}) AS to_name, min(o.create_table_query) AS create_table_query
  FROM targets t JOIN offers o ON o.cluster = t.cluster AND o.host <> t.host GROUP BY t.cluster, t.shard, t.ordinal, o.part
),
steps AS MATERIALIZED (
  SELECT cluster, shard, ordinal, 1 AS step, database AS name, 'CREATE DATABASE IF NOT EXISTS "' || database || '"' AS statement, FALSE AS late FROM shard_rows
  UNION ALL
  SELECT cluster, shard, ordinal, 2, name, {_rewrite("create_table_query")}, FALSE FROM shard_rows
  WHERE create_table_query <> '' AND name NOT LIKE '.inner.%'
  UNION ALL
  SELECT cluster, shard, ordinal, 3, d, 'CREATE DATABASE IF NOT EXISTS "' || d || '"', TRUE
  FROM (SELECT *, unnest([database, to_database]) AS d FROM cluster_rows WHERE engine = 'Distributed') WHERE d <> ''
  UNION ALL
  SELECT r.cluster, r.shard, r.ordinal, 4, r.database || '.' || r.name, {_rewrite("r.create_table_query")}, TRUE
  FROM cluster_rows r JOIN cluster_rows p
    ON p.cluster = r.cluster AND p.shard = r.shard AND p.ordinal = r.ordinal AND p.engine = 'Distributed' AND p.to_database = r.database AND p.to_name = r.name
  WHERE r.create_table_query <> ''
  UNION ALL
  SELECT cluster, shard, ordinal, 5, database || '.' || name, {_rewrite("create_table_query")}, TRUE FROM cluster_rows WHERE engine = 'Distributed'
)
SELECT cluster, shard, ordinal, min(step) AS step, name, statement
FROM steps GROUP BY cluster, shard, ordinal, late, CASE WHEN late THEN 0 ELSE step END, name, statement
"""
ORACLES["drop_table_plan"] = """
SELECT DISTINCT host, name, 'DROP TABLE IF EXISTS "' || database || '"."' || name || '"' AS statement
FROM fx_catalog WHERE engine LIKE 'Replicated%' AND host IN (SELECT host FROM fx_hosts WHERE phase = 'Scale')
"""
ORACLES["readiness"] = """
SELECT host, count(*) FILTER (WHERE cluster = 'all-sharded' AND is_local) > 0 AS ready FROM fx_members GROUP BY host
"""
ORACLES["pending_statements"] = f"""
SELECT c.host, c.part, c.name,
       CASE WHEN l.code = 253 AND contains(s, 'CREATE TABLE') THEN replace(s, 'CREATE TABLE', 'ATTACH TABLE')
            ELSE s END AS statement, l.attempts
FROM (SELECT *, {_rewrite("create_table_query")} AS s FROM fx_catalog) c JOIN fx_ledger l USING (host, part)
WHERE s <> '' AND NOT l.ok AND l.attempts < 10
"""
