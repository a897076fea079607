"""Expected results: topology, reconciliation and status."""

ORACLES: dict[str, str] = {}

ORACLES["layout_defaults"] = """
SELECT i.inst, coalesce(l.cluster::VARCHAR, 'cluster') AS cluster, greatest(coalesce(l.shards_raw, 0), 1)::INT AS shards,
       greatest(coalesce(l.replicas_raw, 0), 1)::INT AS replicas, l.cluster IS NULL AS defaulted
FROM fx_installations i LEFT JOIN fx_layout l USING (inst)
"""
ORACLES["slot_parse"] = """
SELECT ordinal, count(*) AS slots, count(DISTINCT slot) AS distinct_slots FROM fx_parsed_slots GROUP BY ordinal
"""
ORACLES["allocate_replicas"] = "SELECT * FROM fx_replicas"
ORACLES["replica_names"] = """
SELECT inst, cluster, shard_name, replica_name, replica_name || '-0' AS pod_name,
       'data-' || replica_name || '-0' AS data_volume, replica_name || '.' || namespace AS address,
       'di-' || inst || '-deploy-confd-' || replica_name AS config_name,
       inst || '-[^.]+\\d+-\\d+\\.' || namespace || '\\.svc\\.cluster\\.local$' AS host_regexp
FROM fx_replicas JOIN fx_installations USING (inst)
"""
ORACLES["replica_macros"] = """
SELECT replica_name, m.macro, m.value FROM (
  SELECT replica_name, unnest([
    {'macro': 'installation', 'value': inst::VARCHAR}, {'macro': 'all-sharded-shard', 'value': '0'},
    {'macro': 'cluster', 'value': cluster::VARCHAR}, {'macro': 'shard', 'value': shard::VARCHAR},
    {'macro': 'replica', 'value': replica_name}]) AS m FROM fx_replicas)
"""
ORACLES["topology_counts"] = """
SELECT inst, count(DISTINCT cluster) AS clusters, count(DISTINCT shard_name) AS shards, count(*) AS replicas
FROM fx_replicas GROUP BY inst
"""
ORACLES["routing_topology"] = """
SELECT inst, cluster::VARCHAR AS routing_cluster, shard_name AS routing_shard, internal_replication,
       CASE WHEN cluster % 3 > 0 THEN (cluster % 3)::INT END AS weight, replica_name AS host FROM fx_replicas
UNION ALL
SELECT DISTINCT inst, 'all-replicated', 'all', 'true', NULL::INT, replica_name FROM fx_replicas
UNION ALL
SELECT DISTINCT inst, 'all-sharded', replica_name, 'false', NULL::INT, replica_name FROM fx_replicas
"""
ORACLES["surplus_replicas"] = """
WITH old AS (
  SELECT inst, cluster, shard::INT AS shard, unnest(range(greatest(prev_replicas, 1)))::INT AS ordinal
  FROM (SELECT *, unnest(range(greatest(prev_shards, 1))) AS shard FROM fx_layout)
),
o AS (SELECT cluster, shard, count(*) AS n FROM old GROUP BY ALL),
n AS (SELECT cluster, shard, count(*) AS n FROM fx_replicas GROUP BY ALL)
SELECT old.inst, old.cluster, old.shard, old.ordinal, coalesce(o.n > n.n, FALSE) AS guarded
FROM old JOIN o USING (cluster, shard) LEFT JOIN n USING (cluster, shard)
WHERE NOT EXISTS (SELECT 1 FROM fx_replicas r
                  WHERE r.cluster = old.cluster AND r.shard = old.shard AND r.ordinal = old.ordinal)
"""
ORACLES["surplus_drop_plan"] = f"""
WITH gone AS ({ORACLES["surplus_replicas"]}),
drops AS (
  SELECT host, count(*) AS tables, min(statement) AS first, max(statement) AS last
  FROM (SELECT DISTINCT host, 'DROP TABLE IF EXISTS "' || database || '"."' || name || '"' AS statement
        FROM fx_catalog WHERE engine LIKE 'Replicated%')
  GROUP BY host
)
SELECT inst, cluster, shard, ordinal, tables, first, last
FROM gone JOIN drops ON host = (cluster * 12 + shard * 4 + ordinal) % (SELECT count(*) FROM supplier) WHERE guarded
"""
ORACLES["shard_numbers"] = """
SELECT inst, replica_name, row_number() OVER (PARTITION BY inst ORDER BY replica_name) AS shard_number
FROM (SELECT DISTINCT inst, replica_name FROM fx_replicas)
"""
ORACLES["spec_differences"] = """
WITH lines AS (
  SELECT l_orderkey AS object, l_linenumber AS line, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY ALL
),
news AS (
  SELECT object, 'replicas' AS path, (object % 4 + 1)::VARCHAR AS value FROM lines
  UNION SELECT object, 'template.priority', o_orderpriority FROM lines JOIN orders ON o_orderkey = object
  UNION SELECT object, 'template.containers[name=c' || line || '].name', 'c' || line FROM lines
  UNION SELECT object, 'template.containers[name=c' || line || '].image', 'i' || (part % 5) FROM lines
  UNION SELECT object, 'template.containers[name=c' || line || '].ports[0]', (supp % 4)::VARCHAR FROM lines
  UNION SELECT object, 'template.containers[name=c' || line || '].ports[1]', (supp % 3)::VARCHAR FROM lines
),
kept AS (SELECT * FROM lines WHERE part % 7 <> 0),
olds AS (
  SELECT object, 'replicas' AS path, (object % 3 + 1)::VARCHAR AS value FROM kept
  UNION SELECT object, 'template.priority', o_orderpriority FROM kept JOIN orders ON o_orderkey = object
  UNION SELECT object, 'template.containers[name=c' || line || '].name', 'c' || line FROM kept
  UNION SELECT object, 'template.containers[name=c' || line || '].image', 'i' || (part % 4) FROM kept
  UNION SELECT object, 'template.containers[name=c' || line || '].ports[0]', (supp % 4)::VARCHAR FROM kept
)
SELECT object, path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
       o.value AS old, n.value AS new
FROM news n FULL JOIN olds o USING (object, path) WHERE n.value IS DISTINCT FROM o.value
"""
ORACLES["tree_differences"] = """
WITH n AS (SELECT inst, cluster, shard, ordinal, image FROM fx_desired),
o AS (SELECT inst, cluster, shard, ordinal, image FROM fx_observed JOIN fx_layout USING (cluster)),
d AS (
  SELECT inst, cluster, shard, ordinal, n.image AS a, o.image AS b FROM n FULL JOIN o USING (inst, cluster, shard, ordinal)
),
sides AS (
  SELECT level, CASE WHEN depth >= 1 THEN inst END AS inst, CASE WHEN depth >= 2 THEN cluster END AS cluster,
         CASE WHEN depth >= 3 THEN shard END AS shard, CASE WHEN depth >= 4 THEN ordinal END AS ordinal,
         count(a) AS news, count(b) AS olds, bool_or(a IS DISTINCT FROM b) AS differs
  FROM d, (VALUES (1, 'inst'), (2, 'cluster'), (3, 'shard'), (4, 'ordinal')) AS l(depth, level) GROUP BY ALL
)
SELECT level, inst, cluster, shard, ordinal,
       CASE WHEN olds = 0 THEN 'added' WHEN news = 0 THEN 'removed' ELSE 'changed' END AS change
FROM sides WHERE differs
"""
ORACLES["declared_shards"] = """
WITH own AS (SELECT inst, cluster, cluster % 4 AS shard FROM fx_layout WHERE cluster % 6 = 0),
made AS (SELECT inst, cluster, unnest(range(CASE WHEN cluster % 6 = 0 THEN 1 ELSE 0 END, greatest(shards_raw, 1))) AS shard FROM fx_layout)
SELECT inst, cluster, shard::INT AS shard, cluster || '-cluster-' || shard AS shard_name
FROM (SELECT inst, cluster, shard FROM own UNION SELECT inst, cluster, shard FROM made)
"""
ORACLES["annotated_plan"] = """
SELECT p.inst, p.cluster, p.shard, p.ordinal,
       CASE WHEN p.action = 'None' AND (p.ordinal = 3 OR o.generation > 5) THEN 'Update' ELSE p.action END AS action, p.snapshot
FROM fx_plan p LEFT JOIN fx_observed o USING (cluster, shard, ordinal)
"""
ORACLES["replica_status_by_name"] = """
WITH named AS (SELECT (cluster % 50) || '-' || shard || '-' || ordinal AS replica_name,
                      first(phase ORDER BY cluster, shard, ordinal) AS phase, first(state ORDER BY cluster, shard, ordinal) AS state
               FROM fx_phases GROUP BY 1)
SELECT r.inst, r.cluster, r.shard, r.ordinal, (r.cluster % 50) || '-' || r.shard || '-' || r.ordinal AS replica_name, n.phase, n.state
FROM fx_replicas r LEFT JOIN named n ON n.replica_name = (r.cluster % 50) || '-' || r.shard || '-' || r.ordinal
"""
ORACLES["reconcile_plan"] = "SELECT * FROM fx_plan"
ORACLES["action_counts"] = """
SELECT inst, sum(a)::BIGINT AS added, sum(u)::BIGINT AS updated, sum(d)::BIGINT AS deleted, sum(r)::BIGINT AS ready
FROM (SELECT inst, (action = 'Add')::INT AS a, (action = 'Update')::INT AS u, (action = 'Delete')::INT AS d, 0 AS r
      FROM fx_plan
      UNION ALL
      SELECT l.inst, 0, 0, 0, 1 FROM fx_phases p JOIN fx_layout l USING (cluster) WHERE p.phase = 'Normal')
GROUP BY inst
"""
ORACLES["action_events"] = """
SELECT inst, CASE WHEN cluster % 11 = 0 THEN 'Warning' ELSE 'Normal' END AS type,
       CASE action WHEN 'Add' THEN 'Created' WHEN 'Update' THEN 'Update' ELSE 'Deleted' END AS reason,
       CASE action WHEN 'Add' THEN 'Created' WHEN 'Update' THEN 'Updated' ELSE 'Deleted' END || ' set "'
       || cluster || '-cluster-' || shard || '-' || ordinal || '"' || CASE WHEN cluster % 11 = 0 THEN ' failed' ELSE '' END
       AS message
FROM fx_plan WHERE action <> 'None'
"""
ORACLES["upsert_plan"] = """
SELECT d.cluster, d.shard, d.ordinal, d.image, p.pass,
       CASE WHEN o.cluster IS NULL THEN 'create' WHEN p.pass = 2 THEN 'update' ELSE 'keep' END AS action
FROM fx_desired d LEFT JOIN fx_observed o USING (cluster, shard, ordinal), (VALUES (1), (2)) p(pass)
"""
ORACLES["merge_update"] = """
SELECT d.cluster, d.shard, d.ordinal, d.image, d.replicas, d.strategy, o.last_seen,
       coalesce(o.owner, d.owner) AS owner, CASE WHEN o.owner IS NULL THEN d.label ELSE o.label END AS label,
       o.owner IS NULL AS adopted
FROM fx_desired d JOIN fx_observed o USING (cluster, shard, ordinal)
WHERE d.image IS DISTINCT FROM o.applied_image OR o.owner IS NULL
"""
ORACLES["cascade_delete_plan"] = """
SELECT r.inst, r.cluster, r.shard, r.ordinal, s.step, s.kind, s.name FROM (
  SELECT r.*, unnest(list_filter([
    {'step': 1, 'kind': 'tables', 'name': replica_name, 'keep': TRUE},
    {'step': 2, 'kind': 'set', 'name': replica_name, 'keep': TRUE},
    {'step': 3, 'kind': 'volumes', 'name': replica_name, 'keep': l.reclaim_delete},
    {'step': 4, 'kind': 'config', 'name': 'di-' || r.inst || '-deploy-confd-' || replica_name, 'keep': TRUE},
    {'step': 5, 'kind': 'service', 'name': replica_name, 'keep': TRUE}], lambda x: x.keep)) AS s
  FROM fx_replicas r JOIN fx_layout l USING (cluster) WHERE r.inst IN (SELECT inst FROM fx_deleted)) r
UNION ALL
SELECT inst, NULL, NULL, NULL, s.step, s.kind, s.name FROM (
  SELECT inst, unnest([
    {'step': 6, 'kind': 'config', 'name': 'di-' || inst || '-common-configd'},
    {'step': 6, 'kind': 'config', 'name': 'di-' || inst || '-common-usersd'},
    {'step': 7, 'kind': 'service', 'name': 'svc-' || inst}]) AS s FROM fx_deleted)
"""
ORACLES["desired_objects"] = """
SELECT inst, o.kind, o.name FROM (
  SELECT inst, unnest([
    {'kind': 'set', 'name': replica_name}, {'kind': 'service', 'name': replica_name},
    {'kind': 'config', 'name': 'di-' || inst || '-deploy-confd-' || replica_name}]) AS o FROM fx_replicas
  UNION ALL
  SELECT inst, unnest([
    {'kind': 'service', 'name': 'svc-' || inst}, {'kind': 'config', 'name': 'di-' || inst || '-common-configd'},
    {'kind': 'config', 'name': 'di-' || inst || '-common-usersd'}]) FROM (SELECT DISTINCT inst FROM fx_replicas))
"""
ORACLES["owner_events"] = """
SELECT key, kind, event_id FROM fx_changes WHERE kind = 'ADDED'
UNION ALL
SELECT l.inst, c.kind, c.event_id FROM fx_changes c JOIN fx_layout l ON l.cluster = c.event_id WHERE c.kind <> 'ADDED'
"""
ORACLES["unseen_versions"] = """
SELECT 'ns-' || (key % 5) AS namespace, key::VARCHAR AS name, version FROM fx_changes WHERE version % 3 <> 0
"""
ORACLES["watched_filter"] = """
SELECT inst, namespace FROM fx_installations WHERE namespace IN ('NATION_1', 'NATION_3', 'NATION_7')
"""
ORACLES["label_select"] = "SELECT selector, namespace, kind, name FROM fx_matched"
ORACLES["object_counts"] = """
SELECT selector, kind, selector % 4 AS expected, count(m.name) AS found, count(m.name) = selector % 4 AS ok
FROM (SELECT selector, unnest(['set', 'service', 'config']) AS kind FROM fx_selectors) e
LEFT JOIN fx_matched m USING (selector, kind) GROUP BY selector, kind
"""
ORACLES["diff_columns"] = """
WITH both_sides AS (
  SELECT object, claim, old_size IS NULL AS is_new, CASE WHEN old_size IS NOT NULL THEN class END AS class_a,
         CASE WHEN line % 3 = 0 THEN 'class-new' ELSE class END AS class_b, old_size, new_size
  FROM fx_claims
)
SELECT object, claim, CASE WHEN is_new THEN 'added' ELSE 'changed' END AS change, 'class' AS field,
       class_a AS old, class_b AS new FROM both_sides WHERE class_a IS DISTINCT FROM class_b
UNION ALL
SELECT object, claim, CASE WHEN is_new THEN 'added' ELSE 'changed' END, 'size', old_size, new_size
FROM both_sides WHERE old_size IS DISTINCT FROM new_size
"""
ORACLES["replica_phase"] = """
SELECT cluster, shard, ordinal, phase, state, phase = 'Normal' AS counts_ready FROM fx_phases
"""
ORACLES["replica_status"] = """
SELECT r.inst, r.cluster, r.shard, r.ordinal, r.replica_name, p.phase, p.state
FROM fx_replicas r LEFT JOIN fx_phases p USING (cluster, shard, ordinal)
"""
ORACLES["shard_phase"] = """
SELECT a.inst, a.cluster, a.shard, a.replica_count, coalesce(o.n, 0)::INT AS observed_count, o.n IS NULL AS is_new,
       CASE WHEN o.n = a.replica_count THEN 'Normal' ELSE 'Scale' END AS phase,
       coalesce(o.n = a.replica_count, FALSE) AS healthy
FROM fx_allocated a LEFT JOIN (SELECT cluster, shard, count(*) AS n FROM fx_observed GROUP BY ALL) o USING (cluster, shard)
"""
_HEALTH = """
shard_health AS (SELECT cluster, shard, bool_and(phase = 'Normal') AS ok FROM fx_phases GROUP BY ALL),
cluster_health AS (SELECT l.inst, l.cluster, coalesce(bool_and(s.ok), TRUE) AS ok, count(s.shard) AS shards,
                          count(*) FILTER (WHERE s.ok) AS healthy_shards
                   FROM fx_layout l LEFT JOIN shard_health s USING (cluster) GROUP BY ALL)
"""
ORACLES["health_rollup"] = f"""
WITH {_HEALTH}
SELECT inst, bool_and(ok) AS healthy, count(*) AS clusters, count(*) FILTER (WHERE ok) AS healthy_clusters,
       sum(shards)::BIGINT AS shards, sum(healthy_shards)::BIGINT AS healthy_shards
FROM cluster_health GROUP BY inst
"""
ORACLES["previous_state"] = """
SELECT o.cluster, o.shard, o.ordinal, o.prev_state, b.prev_state AS before
FROM fx_observed o LEFT JOIN fx_observed b
  ON b.cluster = o.cluster AND b.shard = o.shard AND b.ordinal = o.ordinal - 1
"""
_STATE = """
totals AS (SELECT inst, count(*) AS total FROM fx_replicas GROUP BY inst),
readies AS (SELECT d.inst, count(*) AS ready FROM fx_desired d JOIN fx_phases p USING (cluster, shard, ordinal)
            WHERE p.phase IN ('Normal', 'Ready') GROUP BY d.inst),
states AS (
  SELECT inst, coalesce(total, 0) AS total, coalesce(ready, 0) AS ready,
         CASE WHEN inst IN (SELECT inst FROM fx_deleted) THEN 'Terminating'
              WHEN coalesce(ready, 0) = coalesce(total, 0) THEN 'Completed' ELSE 'InProgress' END AS state
  FROM fx_installations LEFT JOIN totals USING (inst) LEFT JOIN readies USING (inst)
)
"""
ORACLES["installation_state"] = f"WITH {_STATE} SELECT * FROM states"
ORACLES["fleet_status"] = f"""
WITH {_STATE},
actions AS (SELECT inst, count(*) FILTER (WHERE action = 'Add') AS added, count(*) FILTER (WHERE action = 'Update') AS updated,
                   count(*) FILTER (WHERE action = 'Delete') AS deleted FROM fx_plan GROUP BY inst),
wanted AS (SELECT cluster, shard, count(*) AS replicas, count(p.cluster) AS normal
           FROM fx_desired d LEFT JOIN (SELECT * FROM fx_phases WHERE phase = 'Normal') p USING (cluster, shard, ordinal) GROUP BY cluster, shard),
there AS (SELECT cluster, shard, count(*) AS replicas FROM fx_phases GROUP BY cluster, shard),
sick AS (SELECT DISTINCT w.cluster FROM wanted w LEFT JOIN there t USING (cluster, shard)
         WHERE w.normal < w.replicas OR t.replicas IS DISTINCT FROM w.replicas),
health AS (SELECT inst, bool_and(cluster NOT IN (SELECT cluster FROM sick)) AS healthy, count(*) AS clusters FROM fx_layout GROUP BY inst)
SELECT s.inst, coalesce(clusters, 0) AS clusters, total, ready, coalesce(added, 0) AS added, coalesce(updated, 0) AS updated,
       coalesce(deleted, 0) AS deleted, coalesce(healthy, TRUE) AS healthy, state
FROM states s LEFT JOIN actions USING (inst) LEFT JOIN health USING (inst)
"""
