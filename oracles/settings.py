"""Expected results: settings."""

from oracles.views import normalized

ORACLES: dict[str, str] = {}

_VECTOR = "is_scalar, scalar, array_to_string(vector, ',') AS vector"


def _number(x: str) -> str:
    return f"CASE WHEN {x} - trunc({x}) > 0.001 THEN printf('%.6f', {x}) ELSE trunc({x})::BIGINT::VARCHAR END"


ORACLES["ingest_settings"] = f"""
WITH parsed AS (
  SELECT user_id AS owner, event_id AS seq, event_type, json_extract_string(props, '$.k') AS k,
         printf('%.3f', value - 50)::DOUBLE AS num, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag
  FROM events
)
SELECT owner, seq, m.path, m.scalar IS NOT NULL AS is_scalar, m.scalar, m.vector FROM (
  SELECT owner, seq, unnest([
    {{'path': 'k', 'scalar': k, 'vector': NULL}},
    {{'path': 'value', 'scalar': {_number("num")}, 'vector': NULL}},
    {{'path': 'flag', 'scalar': flag, 'vector': NULL}},
    {{'path': 'list', 'scalar': NULL, 'vector': event_type || ',1.500000,' || k}},
    {{'path': 'kind', 'scalar': event_type, 'vector': NULL}}]) AS m FROM parsed)
"""
ORACLES["merge_settings"] = f"SELECT owner, path, seq, {_VECTOR} FROM fx_merged"
ORACLES["normalize_paths"] = f"SELECT owner, path, seq, {_VECTOR} FROM fx_effective"
ORACLES["settings_filter"] = f"""
SELECT owner, path, section, {_VECTOR} FROM fx_sections WHERE section IN ('none', 'COMMON', 'HOST')
"""
_FIELDS = """
arg_max(scalar, {order}) FILTER (WHERE scalar IS NOT NULL AND scalar NOT IN ('', '_removed_')) AS scalar,
arg_max(trunc(num / 10)::INT, {order}) FILTER (WHERE trunc(num / 10)::INT > 0) AS timeout
"""
ORACLES["merge_override"] = f"""
SELECT owner, path, {_FIELDS.format(order="(layer, seq)")} FROM fx_settings GROUP BY owner, path
"""
ORACLES["effective_config"] = f"""
SELECT owner, coalesce(scalar, 'default') AS scalar, coalesce(timeout, 300)::INT AS timeout FROM (
  SELECT owner, {_FIELDS.format(order="(layer > 0, CASE WHEN layer > 0 THEN 'cr-' || (seq % 10) ELSE '' END, seq)")}
  FROM fx_settings GROUP BY owner)
"""
ORACLES["merge_where"] = f"""
WITH rows AS ({normalized("fx_settings", "owner, layer")}),
ranked AS (SELECT * FROM rows WHERE layer = 0 OR (layer > 0 AND contains(path, '/')
                                                   AND lower(string_split(path, '/')[1]) IN ('host', 'conf.d')))
SELECT owner, path, seq, {_VECTOR} FROM ranked
QUALIFY row_number() OVER (PARTITION BY owner, path ORDER BY layer DESC) = 1
"""
ORACLES["inherit_settings"] = f"SELECT replica_name, kind, path, {_VECTOR} FROM fx_inherited"
ORACLES["user_defaults"] = f"SELECT owner, path, {_VECTOR} FROM fx_user_final"
ORACLES["section_files"] = """
SELECT owner, string_split(path, '/')[-1] AS file, arg_max(scalar, path) AS content
FROM fx_sections WHERE is_scalar AND section IN ('none', 'COMMON') GROUP BY ALL
"""
ORACLES["fingerprint"] = """
WITH pairs AS (SELECT owner, sha1(path || chr(1) || CASE WHEN is_scalar THEN scalar ELSE array_to_string(vector, ',') END) AS d
               FROM fx_effective)
SELECT owner, n AS settings, sha1(n || ':' || a || ':' || b) AS fingerprint FROM (
  SELECT owner, count(*) AS n, bit_xor(('0x' || d[1:15])::BIGINT) AS a, bit_xor(('0x' || d[16:30])::BIGINT) AS b
  FROM pairs GROUP BY owner)
"""
ORACLES["sorted_settings"] = """
SELECT owner, path, CASE WHEN is_scalar THEN scalar ELSE array_to_string(vector, ',') END AS value FROM fx_effective
"""
ORACLES["bool_settings_tally"] = """
SELECT owner, CASE WHEN lower(scalar) IN ('1', 'true', 'yes', 'on', 'enabled') THEN 'true' ELSE 'false' END AS value,
       count(*) AS settings
FROM fx_effective WHERE is_scalar GROUP BY ALL
"""
ORACLES["port_inventory"] = """
WITH kinds(kind, path) AS (VALUES ('tcp_port', 'COMMON/f0'), ('http_port', 'COMMON/f1'), ('interserver_http_port', 'HOST/f2'))
SELECT kind, coalesce(try_cast(s.scalar AS INT), 0) AS port, count(*) AS owners
FROM fx_installations i CROSS JOIN kinds k
LEFT JOIN fx_effective s ON s.owner = i.inst AND s.path = k.path AND s.is_scalar
GROUP BY ALL
"""
