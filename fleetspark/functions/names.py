"""Names of shards, replicas, pods, volumes and shared objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Object name patterns.
COMMON_CONFIG_NAME = "di-{di}-common-configd"
COMMON_USERS_NAME = "di-{di}-common-usersd"
REPLICA_CONFIG_NAME = "di-{di}-deploy-confd-{replica}"
HOST_REGEXP = r"{di}-[^.]+\d+-\d+\.{namespace}\.svc\.cluster\.local$"

# Names of the two generated routing clusters.
ALL_REPLICATED = "all-replicated"
ALL_SHARDED = "all-sharded"


def shard_name(installation: Column, cluster: Column, index: Column) -> Column:
    return F.concat_ws("-", installation, cluster, index.cast("string"))


def replica_name(shard: Column, ordinal: Column) -> Column:
    return F.concat_ws("-", shard, ordinal.cast("string"))


def pod_name(set_name: Column, ordinal: Column) -> Column:
    return F.concat_ws("-", set_name, ordinal.cast("string"))


def volume_name(claim: Column, pod: Column) -> Column:
    return F.concat_ws("-", claim, pod)


def host_address(host: Column, namespace: Column) -> Column:
    return F.concat_ws(".", host, namespace)


def instance_name(label: Column, name: Column) -> Column:
    """The instance label if present, else the object's own name."""
    return F.coalesce(label, name)


def fill_pattern(pattern: str, **values: Column) -> Column:
    """Put columns into the ``{macro}`` places of a pattern in a single pass.

    The pattern is cut at its macros once, so text that comes from a value is
    never scanned again.
    """
    parts: list[Column] = []
    rest = pattern
    while rest:
        places = [(rest.index("{%s}" % key), key) for key in values if "{%s}" % key in rest]
        if not places:
            parts.append(F.lit(rest))
            break
        at, key = min(places)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[key].cast("string"))
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts)


def last_ordinal(name: Column) -> Column:
    """The number after the last dash: -1 below three parts, 0 if it is no number."""
    last = F.substring_index(name, "-", -1)
    return F.when(
        F.size(F.split(name, "-")) >= 3,
        F.coalesce(F.when(last.rlike(r"^\+?[0-9]+$"), last.try_cast("int")), F.lit(0)),
    ).otherwise(F.lit(-1))


def name_prefix(name: Column) -> Column:
    """Everything before the last dash."""
    return F.regexp_replace(name, "-[^-]*$", "")
