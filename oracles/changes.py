"""Expected results: change feed and the streams over it."""

ORACLES: dict[str, str] = {}

_LATEST = """
latest AS (SELECT key, kind, ts, event_id, phase FROM fx_changes
           QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1)
"""
ORACLES["latest_state"] = f"WITH {_LATEST} SELECT * FROM latest WHERE kind <> 'DELETED'"
ORACLES["backlog"] = f"WITH {_LATEST} SELECT * FROM latest WHERE kind <> 'DELETED' AND phase <> 2"
ORACLES["tombstones"] = f"""
WITH {_LATEST}
SELECT key, ts AS deleted_at, event_id,
       key NOT IN (SELECT inst FROM fx_layout WHERE cluster % 8 = 0) AS purge
FROM latest WHERE kind = 'DELETED'
"""
ORACLES["phase_transitions"] = """
WITH lagged AS (SELECT *, lag(phase) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM fx_changes)
SELECT key, arg_max(phase, (ts, event_id)) AS phase, max(ts) FILTER (WHERE phase IS DISTINCT FROM before) AS last_transition,
       count(*) FILTER (WHERE phase IS DISTINCT FROM before) AS transitions, max(ts) AS last_seen
FROM lagged GROUP BY key
"""


def _queue(now: str) -> str:
    return f"""
WITH {_LATEST},
clock AS (SELECT {now} AS now),
waiting AS (SELECT latest.*, len(list_filter(range(1, 11), lambda n: ts + to_seconds((n * (n + 1) * 5 // 2)) <= now))::INT AS tries
            FROM latest, clock WHERE kind <> 'DELETED' AND phase <> 2)
SELECT *, CASE WHEN tries < 10 THEN ts + to_seconds(((tries + 1) * (tries + 2) * 5 // 2)) END AS due FROM waiting
"""


ORACLES["retry_queue"] = _queue("TIMESTAMP '2024-01-30 12:00:00'")
ORACLES["stream_backlog"] = _queue("(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM fx_changes)")
for _name in ("latest_state", "phase_transitions", "tombstones"):
    ORACLES[f"stream_{_name}"] = ORACLES[_name]
ORACLES["stream_log_sink"] = "SELECT * FROM fx_log WHERE event_date + INTERVAL 30 DAY > DATE '2024-02-10'"
ORACLES["log_lifecycle"] = """
SELECT event_date, count(*) AS rows, min(event_time) AS first_time, max(event_time) AS last_time
FROM fx_log WHERE event_date + INTERVAL 30 DAY > DATE '2024-02-10' GROUP BY event_date
"""
