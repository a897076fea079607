"""Expected results: storage, logs and text."""

ORACLES: dict[str, str] = {}

ORACLES["claim_validation"] = """
WITH classes AS (SELECT class, allow_expansion FROM fx_classes
                 UNION ALL SELECT '', arg_min(allow_expansion, class) FROM fx_classes WHERE is_default)
SELECT object, claim, old_bytes, new_bytes,
       CASE WHEN old_size IS NULL THEN 'new claim'
            WHEN old_bytes > 0 AND new_bytes > 0 AND new_bytes > old_bytes THEN
              CASE WHEN allow_expansion IS NULL THEN 'no storage class' WHEN NOT allow_expansion THEN 'class forbids expansion'
                   ELSE 'grow' END
            WHEN old_bytes > 0 AND new_bytes > 0 AND new_bytes < old_bytes THEN 'decrease' ELSE 'accepted' END AS verdict
FROM fx_claims LEFT JOIN classes USING (class)
"""
ORACLES["volume_resize_plan"] = """
WITH classes AS (SELECT class, allow_expansion FROM fx_classes
                 UNION ALL SELECT '', arg_min(allow_expansion, class) FROM fx_classes WHERE is_default),
refused AS (SELECT object FROM fx_claims LEFT JOIN classes USING (class)
            WHERE old_size IS NULL OR (old_bytes > 0 AND new_bytes > 0 AND new_bytes < old_bytes)
               OR (old_bytes > 0 AND new_bytes > old_bytes AND allow_expansion IS NOT TRUE)),
claims AS (SELECT *, old_bytes > 0 AND new_bytes > old_bytes AS grew FROM fx_claims
           WHERE old_size IS NOT NULL AND object NOT IN (SELECT object FROM refused)),
recreate AS (SELECT object, bool_or(grew) AS recreate FROM claims GROUP BY object),
expected AS (SELECT object, claim, new_size, new_bytes, claim || '-' || object || '-' || o AS volume
             FROM claims, (VALUES (0), (1)) p(o))
SELECT e.object, e.claim, e.volume, v.size AS old_size, e.new_size, r.recreate
FROM expected e JOIN fx_volumes v USING (object, volume) JOIN recreate r USING (object)
WHERE v.bytes > 0 AND e.new_bytes > v.bytes
"""
ORACLES["orphan_volumes"] = """
SELECT object, volume, size FROM fx_volumes v WHERE NOT EXISTS (
  SELECT 1 FROM fx_claims c, (VALUES (0), (1)) p(o)
  WHERE c.object = v.object AND v.volume = c.claim || '-' || c.object || '-' || o)
"""
ORACLES["resolve_mounts"] = """
WITH s AS (
  SELECT "set", data_claim, log_claim, data_claim IN ('data', 'log', 'extra')
           AND NOT EXISTS (SELECT 1 FROM fx_mounts m WHERE m."set" = d."set" AND (m.mount = d.data_claim OR m.path = '/data')) AS data,
         log_claim IN ('data', 'log', 'extra') AS log_known,
         NOT EXISTS (SELECT 1 FROM fx_mounts m WHERE m."set" = d."set" AND (m.mount = d.log_claim OR m.path = '/log')) AS log_free
  FROM fx_mount_sets d
)
SELECT "set", 'claim' AS item, mount AS name, '' AS path FROM fx_mounts WHERE mount IN ('data', 'log', 'extra')
UNION SELECT "set", 'claim', data_claim, '' FROM s WHERE data
UNION SELECT "set", 'mount', data_claim, '/data' FROM s WHERE data
UNION SELECT "set", 'claim', log_claim, '' FROM s WHERE log_known AND log_free
UNION SELECT "set", 'mount', log_claim, '/log' FROM s WHERE log_known AND log_free
UNION SELECT "set", 'container', 'log', '' FROM s WHERE log_known
"""
ORACLES["admission_report"] = """
WITH insts AS (SELECT inst, 'data2' AS data_claim, CASE WHEN inst % 2 <> 0 THEN 'log1' WHEN inst % 4 = 0 THEN '' ELSE 'log9' END
                 AS log_claim FROM fx_installations),
owned AS (SELECT l.inst, c.claim, c.object, c.old_size, c.old_bytes, c.new_bytes FROM fx_claims c JOIN fx_layout l ON l.cluster = c.object),
new_claims AS (SELECT inst, claim, arg_min(new_bytes, object) AS bytes FROM owned GROUP BY ALL),
old_claims AS (SELECT inst, claim, arg_min(old_bytes, object) AS bytes FROM owned WHERE old_size IS NOT NULL GROUP BY ALL),
declared AS (SELECT DISTINCT inst FROM new_claims),
wanted AS (SELECT inst, 'data' AS volume, data_claim AS claim, '1Gi' AS floor, 1073741824 AS least FROM insts
           UNION ALL SELECT inst, 'log', log_claim, '100Mi', 104857600 FROM insts),
old_c AS (SELECT inst, cluster, prev_shards AS s, prev_replicas AS r FROM fx_layout WHERE cluster % 13 <> 0),
new_c AS (SELECT inst, cluster, shards_raw AS s, replicas_raw AS r FROM fx_layout WHERE cluster % 11 <> 0),
errors AS (
  SELECT w.inst, CASE WHEN n.bytes IS NULL THEN volume || ' volume ' || w.claim || ' is not declared'
                      ELSE volume || ' volume is below ' || floor END AS error
  FROM wanted w JOIN declared USING (inst) LEFT JOIN new_claims n ON n.inst = w.inst AND n.claim = w.claim
  WHERE w.claim <> '' AND (n.bytes IS NULL OR n.bytes < least)
  UNION
  SELECT inst, 'clusters are removed' FROM declared
  WHERE (SELECT count(*) FROM new_c WHERE new_c.inst = declared.inst) < (SELECT count(*) FROM old_c WHERE old_c.inst = declared.inst)
  UNION
  SELECT inst, 'shards or replicas are removed' FROM declared WHERE inst IN (
    SELECT n.inst FROM new_c n JOIN old_c o USING (inst, cluster) WHERE n.s < o.s OR n.r < o.r)
  UNION
  SELECT o.inst, 'a claim becomes smaller' FROM old_claims o JOIN new_claims n USING (inst, claim)
  WHERE o.bytes > 0 AND n.bytes > 0 AND n.bytes < o.bytes
)
SELECT i.inst, count(e.error) = 0 AS accepted, count(e.error)::INT AS error_count,
       coalesce(string_agg(e.error, '; ' ORDER BY e.error), '') AS errors
FROM insts i LEFT JOIN errors e USING (inst) GROUP BY i.inst
"""
ORACLES["log_retention"] = "SELECT * FROM fx_log WHERE event_date + INTERVAL 30 DAY > DATE '2024-02-10'"
ORACLES["log_expiry"] = "SELECT DISTINCT event_date FROM fx_log WHERE event_date <= DATE '2024-02-10' - INTERVAL 30 DAY"
ORACLES["short_id_collisions"] = """
SELECT right(sha1(inst_name), 3) AS short_id, count(DISTINCT inst_name) AS names
FROM fx_installations GROUP BY 1 HAVING count(DISTINCT inst_name) > 1
"""
ORACLES["bucket_sizes"] = """
SELECT (h % 16)::INT AS bucket, count(*) AS rows FROM (
  SELECT list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(inst_name, ''), lambda c: ascii(c)::BIGINT)),
                     lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS h
  FROM fx_installations) GROUP BY 1
"""
ORACLES["masked_endpoints"] = """
WITH e AS (
  SELECT namespace, 'host-' || (inst % 50) || ':8123/' AS place,
         CASE inst % 3 WHEN 0 THEN '' WHEN 1 THEN 'u' || (inst % 10) || '@' ELSE 'u' || (inst % 10) || ':p' || inst || '@' END AS who
  FROM fx_installations
)
SELECT namespace, 'http://***:***@' || place AS endpoint, count(*) AS installations, max('http://' || who || place) AS last_url
FROM e GROUP BY ALL
"""
