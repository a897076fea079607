"""The derived fleet inputs of FIXTURES.md as DuckDB views."""

VIEWS: dict[str, str] = {}

VIEWS["fx_layout"] = """
SELECT o_custkey AS inst, o_orderkey AS cluster, o_orderkey::VARCHAR AS installation_name,
       'cluster' AS cluster_name,
       (o_orderkey % 3)::INT AS shards_raw, ((o_orderkey // 3) % 4)::INT AS replicas_raw,
       ((o_orderkey // 7) % 3)::INT AS prev_shards, ((o_orderkey // 5) % 4)::INT AS prev_replicas,
       CASE o_orderkey % 13 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Off' ELSE '' END AS internal_raw,
       o_orderpriority = '5-LOW' AS paused, o_orderstatus = 'F' AS reclaim_delete
FROM orders
"""
VIEWS["fx_installations"] = """
SELECT c_custkey AS inst, c_name AS inst_name, n_name AS namespace, c_acctbal
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
VIEWS["fx_deleted"] = "SELECT c_custkey AS inst FROM customer WHERE c_custkey % 7 = 0"
VIEWS["fx_slots"] = """
SELECT l_orderkey AS cluster,
       CASE WHEN l_partkey % 50 = 0 THEN 'bad-' || l_orderkey
            WHEN l_partkey % 50 = 1 THEN l_orderkey || '-cluster-' || (l_linenumber % 3) || '-x'
            ELSE l_orderkey || '-cluster-' || (l_linenumber % 3) || '-' || (l_suppkey % 4) END AS slot
FROM lineitem WHERE l_returnflag = 'R'
"""
VIEWS["fx_observed"] = """
SELECT cluster, shard, ordinal, ready, generation, observed_generation,
       CASE WHEN flag = 'A' THEN 'Sync' ELSE 'NotSync' END AS prev_state, image, last_seen,
       CASE WHEN cluster % 17 <> 0 THEN image END AS applied_image,
       CASE WHEN generation > 1 THEN 'owner-' || cluster END AS owner, 'live' AS label
FROM (SELECT l_orderkey AS cluster, (l_linenumber % 3)::INT AS shard, (l_suppkey % 4)::INT AS ordinal,
             max((l_linestatus = 'O')::INT) AS ready, max(l_linenumber) AS generation,
             min(l_linenumber) AS observed_generation, min(l_returnflag) AS flag,
             (max(l_partkey) % 2)::INT AS image, max(l_shipdate) AS last_seen
      FROM lineitem GROUP BY ALL)
"""
_SCALAR = """CASE event_id % 13 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' WHEN 2 THEN '_removed_'
                  ELSE json_extract_string(props, '$.k') END"""
_SETTING_COLUMNS = f"""
       user_id AS owner, (event_id % 3)::INT AS layer, event_id AS seq, event_id % 5 <> 0 AS is_scalar,
       CASE WHEN event_id % 5 <> 0 THEN {_SCALAR} END AS scalar,
       CASE WHEN event_id % 5 = 0 THEN [{_SCALAR}, (event_id % 10)::VARCHAR] END AS vector, value AS num
"""
VIEWS["fx_settings"] = f"""
SELECT {_SETTING_COLUMNS},
       CASE event_type WHEN 'click' THEN 'COMMON//' WHEN 'view' THEN '/config.d/' WHEN 'error' THEN 'users.d/'
            WHEN 'purchase' THEN 'HOST/' ELSE CASE WHEN event_id % 2 = 0 THEN 'misc/' ELSE '' END END
       || 'f' || (event_id % 7) || CASE WHEN event_id % 11 = 0 THEN '/' ELSE '' END AS path
FROM events
"""
VIEWS["fx_user_settings"] = f"""
SELECT {_SETTING_COLUMNS},
       CASE WHEN event_id % 4 = 0 THEN 'default' ELSE 'u' || (event_id % 4) END || '/' ||
       CASE event_type WHEN 'click' THEN 'password' WHEN 'view' THEN 'profile' WHEN 'error' THEN 'quota'
            WHEN 'purchase' THEN 'networks//ip' ELSE 'password_sha256_hex' END AS path
FROM events
"""
VIEWS["fx_hosts"] = """
SELECT s_suppkey AS host, s_suppkey // 12 AS cluster, ((s_suppkey // 4) % 3)::INT AS shard,
       (s_suppkey % 4)::INT AS ordinal, 4 AS replicas_count, s_acctbal >= 1000 AS available,
       CASE WHEN s_suppkey % 5 = 0 THEN 'Ready' WHEN s_acctbal >= 1000 THEN 'Normal' ELSE 'Scale' END AS phase,
       CASE WHEN s_suppkey % 5 <> 0 AND s_acctbal >= 1000 THEN 'Sync' ELSE 'NotSync' END AS state
FROM supplier
"""
VIEWS["fx_parts"] = """
SELECT p_partkey, p_type,
       CASE WHEN regexp_extract(p_brand, '#(\\d+)$', 1) = '1' THEN 'system'
            ELSE 'db' || regexp_extract(p_brand, '#(\\d+)$', 1) END AS database,
       CASE WHEN p_type = 'STANDARD' THEN '.inner.' ELSE '' END || replace(p_name, ' ', '_') || '_' || p_size AS name
FROM part
"""
# The table of each part.  It is made before the join with the hosts: DuckDB now and then
# stops with an internal error about dictionaries where these texts pass through two joins.
VIEWS["fx_tables"] = """
SELECT p_partkey AS part, database, name,
       CASE p_type WHEN 'PROMO' THEN 'Distributed' WHEN 'SMALL' THEN 'ReplicatedMergeTree'
            WHEN 'MEDIUM' THEN 'ReplicatedSummingMergeTree' WHEN 'LARGE' THEN 'MergeTree'
            WHEN 'ECONOMY' THEN 'View' ELSE 'MaterializedView' END AS engine,
       CASE WHEN p_type = 'PROMO'
            THEN 'Distributed(all, ' || CASE WHEN p_partkey % 2 = 0 THEN '''' ELSE '' END || to_database
                 || CASE WHEN p_partkey % 2 = 0 THEN '''' ELSE '' END || ', ' || to_name || ', rand())'
            ELSE 'MergeTree()' END AS engine_full,
       CASE WHEN p_partkey % 17 = 0 THEN ''
            ELSE 'CREATE ' || CASE p_type WHEN 'ECONOMY' THEN 'VIEW' WHEN 'STANDARD' THEN 'MATERIALIZED VIEW'
                                          ELSE 'TABLE' END
                 || ' ' || database || '.' || name || ' (x Int8)' END AS create_table_query
FROM (SELECT *, coalesce(lead(database) OVER o, first_value(database) OVER o) AS to_database,
             coalesce(lead(name) OVER o, first_value(name) OVER o) AS to_name
      FROM fx_parts WINDOW o AS (ORDER BY p_partkey))
"""
VIEWS["fx_catalog"] = """
SELECT host, part, database, name, engine, engine_full, create_table_query
FROM (SELECT DISTINCT l_suppkey AS host, l_partkey AS part FROM lineitem) JOIN fx_tables USING (part)
"""
VIEWS["fx_ledger"] = """
SELECT DISTINCT l_suppkey AS host, l_partkey AS part, (l_partkey + l_suppkey) % 5 >= 2 AS ok,
       CASE WHEN (l_partkey + l_suppkey) % 5 = 0 THEN 253 ELSE 0 END AS code,
       ((l_partkey + 3 * l_suppkey) % 12)::INT AS attempts
FROM lineitem
"""
VIEWS["fx_claims"] = """
SELECT l_orderkey AS object, CASE WHEN l_linenumber % 2 = 0 THEN 'data' ELSE 'log' END || l_linenumber AS claim,
       CASE WHEN class_key % 10 = 0 THEN '' ELSE 'class-' || class_key END AS class,
       CASE WHEN k <> 3 THEN CASE class_key % 4 WHEN 1 THEN (size * 1024) || 'Mi' WHEN 3 THEN (size * 1000) || 'M'
                             ELSE size || 'Gi' END END AS old_size,
       CASE class_key % 4 WHEN 1 THEN (new * 1024) || 'Mi' WHEN 3 THEN (new * 1000) || 'M'
            ELSE new || 'Gi' END AS new_size,
       CASE WHEN k <> 3 THEN size * CASE class_key % 4 WHEN 3 THEN 1000000000 ELSE 1073741824 END END AS old_bytes,
       new * CASE class_key % 4 WHEN 3 THEN 1000000000 ELSE 1073741824 END AS new_bytes,
       l_linenumber AS line
FROM (SELECT *, size + CASE k WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS new
      FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS class_key, min(l_quantity)::BIGINT AS size,
                   min(l_partkey) % 4 AS k
            FROM lineitem GROUP BY ALL))
"""
VIEWS["fx_classes"] = """
SELECT 'class-' || s_suppkey AS class, s_acctbal >= 1000 AS allow_expansion, s_suppkey = 0 AS is_default FROM supplier
"""
VIEWS["fx_volumes"] = """
SELECT object, claim || '-' || object || '-' || (line % 3) AS volume, old_size AS size, old_bytes AS bytes
FROM fx_claims WHERE old_size IS NOT NULL
"""
VIEWS["fx_changes"] = """
SELECT user_id AS key,
       CASE event_type WHEN 'signup' THEN 'ADDED' WHEN 'error' THEN 'DELETED' ELSE 'MODIFIED' END AS kind,
       ts, event_id, (json_extract_string(props, '$.k')::INT % 3)::INT AS phase, event_id AS version
FROM events
"""
VIEWS["fx_log"] = "SELECT event_id, ts::DATE AS event_date, ts AS event_time, value FROM events"
VIEWS["fx_templates"] = """
SELECT p_partkey AS ord, p_brand AS namespace, p_name AS name, p_size AS size,
       CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE '' END AS storage_class, p_partkey % 29 = 0 AS retired
FROM part
"""
VIEWS["fx_references"] = """
SELECT o_custkey AS inst, o_orderkey AS ord, 'Brand#' || (1 + o_custkey % 25) AS own_namespace,
       CASE WHEN o_orderkey % 5 = 0 THEN 'elsewhere' ELSE p_brand END AS namespace, p_name AS name
FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
"""
VIEWS["fx_nodes"] = """
SELECT p_brand AS owner, p_partkey AS ord, p_name AS host,
       CASE WHEN p_size % 3 <> 0 THEN 2181 + p_size % 2 END::INT AS port
FROM part
"""
VIEWS["fx_objects"] = """
SELECT o_orderkey AS object, namespace,
       CASE o_orderstatus WHEN 'F' THEN 'set' WHEN 'O' THEN 'service' ELSE 'config' END AS kind,
       'object-' || o_orderkey AS name, o_custkey::VARCHAR AS l_instance, o_orderpriority AS l_priority
FROM orders JOIN fx_installations ON o_custkey = inst
"""
VIEWS["fx_selectors"] = """
SELECT inst AS selector, namespace, inst::VARCHAR AS m_instance,
       CASE WHEN inst % 2 = 0 THEN '1-URGENT' END AS m_priority
FROM fx_installations
"""
VIEWS["fx_members"] = """
SELECT l_orderkey AS host,
       CASE l_returnflag WHEN 'A' THEN 'all-sharded' WHEN 'N' THEN 'all-replicated' ELSE 'cluster' END AS cluster,
       l_linestatus = 'F' AS is_local
FROM lineitem
"""
VIEWS["fx_mounts"] = """
SELECT l_orderkey AS "set",
       CASE l_partkey % 5 WHEN 0 THEN 'data' WHEN 1 THEN 'log' WHEN 2 THEN 'extra' ELSE 'tmp' END AS mount,
       CASE l_suppkey % 3 WHEN 0 THEN '/data' WHEN 1 THEN '/log' ELSE '/x' END AS path
FROM lineitem
"""
VIEWS["fx_mount_sets"] = """
SELECT o_orderkey AS "set", 'data' AS data_claim,
       CASE o_orderkey % 5 WHEN 0 THEN 'archive' WHEN 1 THEN '' ELSE 'log' END AS log_claim
FROM orders
"""
VIEWS["fx_shards"] = """
SELECT inst, cluster, shard::INT AS shard, cluster || '-cluster-' || shard AS shard_name,
       greatest(replicas_raw, 1) AS replicas, internal_raw
FROM (SELECT *, unnest(range(greatest(shards_raw, 1))) AS shard FROM fx_layout)
"""
VIEWS["fx_parsed_slots"] = """
SELECT slot, CASE WHEN len(string_split(slot, '-')) >= 3
                  THEN coalesce(try_cast(string_split(slot, '-')[-1] AS INT), 0) ELSE -1 END::INT AS ordinal,
       regexp_replace(slot, '-[^-]*$', '') AS shard_name
FROM fx_slots
"""
VIEWS["fx_allocated"] = """
SELECT s.inst, s.cluster, s.shard, s.shard_name, s.replicas, s.internal_raw,
       CASE WHEN len(coalesce(d.slots, [])) < s.replicas THEN coalesce(d.slots, []) ELSE [] END AS slots,
       (s.replicas - CASE WHEN len(coalesce(d.slots, [])) < s.replicas THEN len(coalesce(d.slots, [])) ELSE 0 END)::INT
         AS replica_count
FROM fx_shards s
LEFT JOIN (SELECT shard_name, list(DISTINCT ordinal) AS slots FROM fx_parsed_slots GROUP BY shard_name) d USING (shard_name)
"""
VIEWS["fx_replicas"] = """
SELECT inst, cluster, shard, shard_name, replica_count,
       CASE WHEN lower(internal_raw) IN ('1', 'true', 'yes', 'on', 'enabled') THEN 'true'
            WHEN lower(internal_raw) IN ('0', 'false', 'no', 'off', 'disabled') THEN 'false'
            WHEN replica_count > 1 THEN 'true' ELSE 'false' END AS internal_replication,
       ordinal::INT AS ordinal, shard_name || '-' || ordinal AS replica_name
FROM (SELECT *, unnest(list_filter(range(replicas), lambda x: NOT list_contains(slots, x))[1:replica_count]) AS ordinal
      FROM fx_allocated)
"""
VIEWS["fx_desired"] = """
SELECT inst, cluster, shard, ordinal, replica_name, ((cluster + shard + ordinal) % 2)::INT AS image,
       1 AS replicas, 'RollingUpdate' AS strategy, 'owner-' || cluster AS owner, 'desired' AS label
FROM fx_replicas
"""
VIEWS["fx_phases"] = """
SELECT *, CASE WHEN ready <> 1 THEN 'Scale' WHEN generation = observed_generation AND prev_state = 'NotSync' THEN 'Ready'
               ELSE 'Normal' END AS phase,
       CASE WHEN ready <> 1 THEN 'NotSync' ELSE prev_state END AS state
FROM fx_observed
"""
VIEWS["fx_plan"] = """
SELECT l.inst, j.cluster, j.shard, j.ordinal, j.action, j.snapshot FROM (
  SELECT coalesce(d.cluster, o.cluster) AS cluster, coalesce(d.shard, o.shard) AS shard,
         coalesce(d.ordinal, o.ordinal) AS ordinal,
         CASE WHEN o.cluster IS NULL THEN 'Add' WHEN d.cluster IS NULL THEN 'Delete'
              WHEN d.image IS DISTINCT FROM o.applied_image THEN 'Update' ELSE 'None' END AS action,
         CASE WHEN d.cluster IS NOT NULL
              THEN '{"image":' || d.image || ',"replicas":1,"strategy":"RollingUpdate"}' END AS snapshot
  FROM fx_desired d FULL JOIN fx_observed o
    ON d.cluster = o.cluster AND d.shard = o.shard AND d.ordinal = o.ordinal
) j JOIN fx_layout l ON l.cluster = j.cluster WHERE NOT l.paused
"""
VIEWS["fx_matched"] = """
SELECT s.selector, o.namespace, o.kind, o.name FROM fx_objects o JOIN fx_selectors s
  ON o.namespace = s.namespace AND o.l_instance = s.m_instance AND (s.m_priority IS NULL OR s.m_priority = o.l_priority)
"""
_VALUE = "{'seq': seq, 'is_scalar': is_scalar, 'scalar': scalar, 'vector': vector}"
_NORMAL = "trim(regexp_replace(path, '//+', '/', 'g'), '/')"


def _merged(source: str) -> str:
    return f"""
SELECT owner, path, v.seq AS seq, v.is_scalar AS is_scalar, v.scalar AS scalar, v.vector AS vector
FROM (SELECT owner, path, arg_min({_VALUE}, (layer, seq)) AS v FROM {source} GROUP BY owner, path)
"""


def normalized(source: str, keys: str = "owner") -> str:
    return f"""
SELECT {keys}, path, v.seq AS seq, v.is_scalar AS is_scalar, v.scalar AS scalar, v.vector AS vector
FROM (SELECT {keys}, {_NORMAL} AS path, arg_max({_VALUE}, (path <> {_NORMAL}, seq)) AS v
      FROM {source} GROUP BY ALL)
"""


VIEWS["fx_merged"] = _merged("fx_settings")
VIEWS["fx_effective"] = normalized("fx_merged")
VIEWS["fx_user_merged"] = _merged("fx_user_settings")
VIEWS["fx_user_effective"] = normalized("fx_user_merged")
VIEWS["fx_sections"] = """
SELECT *, CASE WHEN NOT contains(path, '/') THEN 'none'
               WHEN lower(string_split(path, '/')[1]) IN ('common', 'config.d') THEN 'COMMON'
               WHEN lower(string_split(path, '/')[1]) IN ('users', 'users.d') THEN 'USERS'
               WHEN lower(string_split(path, '/')[1]) IN ('host', 'conf.d') THEN 'HOST' ELSE 'unknown' END AS section
FROM fx_effective
"""
VIEWS["fx_user_final"] = """
WITH users AS (
  SELECT DISTINCT owner, string_split(path, '/')[1] AS "user" FROM fx_user_effective WHERE contains(path, '/')
  UNION SELECT inst, 'default' FROM fx_installations
),
facts AS (
  SELECT u.owner, u."user", p.owner IS NOT NULL AS has_pass, d.owner IS NOT NULL AS has_digest,
         CASE WHEN p.owner IS NOT NULL THEN CASE WHEN p.is_scalar THEN p.scalar ELSE array_to_string(p.vector, ',') END
              WHEN u."user" <> 'default' THEN 'default' ELSE '' END AS pass
  FROM users u
  LEFT JOIN fx_user_effective p ON p.owner = u.owner AND p.path = u."user" || '/password'
  LEFT JOIN fx_user_effective d ON d.owner = u.owner AND d.path = u."user" || '/password_sha256_hex'
),
missing AS (
  SELECT u.owner, u."user" || '/' || k.key AS path, k.key FROM users u, (VALUES ('profile'), ('quota'), ('networks/ip'), ('networks/host_regexp')) k(key)
  WHERE NOT EXISTS (SELECT 1 FROM fx_user_effective s WHERE s.owner = u.owner AND s.path = u."user" || '/' || k.key)
)
SELECT s.owner, s.path, s.is_scalar, s.scalar, s.vector FROM fx_user_effective s
LEFT JOIN facts f ON f.owner = s.owner AND s.path = f."user" || '/password'
WHERE f.owner IS NULL OR NOT (f.has_digest OR f.pass <> '')
UNION ALL
SELECT m.owner, m.path, m.key <> 'networks/ip',
       CASE m.key WHEN 'networks/ip' THEN NULL WHEN 'networks/host_regexp'
         THEN i.inst || '-[^.]+\\d+-\\d+\\.' || i.namespace || '\\.svc\\.cluster\\.local$' ELSE 'default' END,
       CASE WHEN m.key = 'networks/ip' THEN ['::/0'] END
FROM missing m LEFT JOIN fx_installations i ON i.inst = m.owner
UNION ALL
SELECT owner, "user" || '/password_sha256_hex', TRUE, sha256(pass), NULL FROM facts WHERE pass <> '' AND NOT has_digest
UNION ALL
SELECT owner, 'default/password', TRUE, '_removed_', NULL FROM facts WHERE "user" = 'default' AND (has_digest OR pass <> '')
"""
_LEVELS = """
  SELECT *, CASE WHEN layer < 2 THEN layer WHEN seq % 7 = 0 THEN 3 ELSE 2 END AS level,
         CASE WHEN seq % 2 = 0 THEN 'files' ELSE 'settings' END AS kind FROM fx_settings
"""
VIEWS["fx_levels"] = normalized(f"({_LEVELS})", "owner, level, kind")
VIEWS["fx_inherited"] = """
WITH place AS (SELECT inst, min(cluster) AS cluster FROM fx_layout GROUP BY inst),
ranked AS (
  SELECT r.replica_name, l.kind, l.path, l.is_scalar, l.scalar, l.vector, 2 AS rank
  FROM fx_levels l JOIN fx_replicas r ON r.inst = l.owner
  WHERE l.level = 0 AND l.kind = 'files' AND contains(l.path, '/') AND lower(string_split(l.path, '/')[1]) IN ('host', 'conf.d')
  UNION ALL
  SELECT r.replica_name, l.kind, l.path, l.is_scalar, l.scalar, l.vector, 3
  FROM fx_levels l JOIN place p ON p.inst = l.owner JOIN fx_replicas r ON r.cluster = p.cluster WHERE l.level = 1
  UNION ALL
  SELECT r.replica_name, l.kind, l.path, l.is_scalar, l.scalar, l.vector, 1
  FROM fx_levels l JOIN place p ON p.inst = l.owner JOIN fx_replicas r ON r.cluster = p.cluster AND r.shard = 0
  WHERE l.level = 2
  UNION ALL
  SELECT r.replica_name, l.kind, l.path, l.is_scalar, l.scalar, l.vector, 0
  FROM fx_levels l JOIN place p ON p.inst = l.owner
  JOIN (SELECT cluster, arg_min(replica_name, ordinal) AS replica_name FROM fx_replicas WHERE shard = 0 GROUP BY cluster) r
    ON r.cluster = p.cluster WHERE l.level = 3
)
SELECT replica_name, kind, path, v.is_scalar AS is_scalar, v.scalar AS scalar, v.vector AS vector
FROM (SELECT replica_name, kind, path, arg_min({'is_scalar': is_scalar, 'scalar': scalar, 'vector': vector}, rank) AS v
      FROM ranked GROUP BY ALL)
"""
