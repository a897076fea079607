"""Layered settings as long rows: ``(owner, path, is_scalar, scalar, vector)``.

Three merges with opposite precedence are kept apart under three names:
``merge_fill`` (first writer wins), ``merge_override`` (last non-empty value
wins) and ``merge_where`` (chosen source rows overwrite).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions import hashes, text

VALUE = ["is_scalar", "scalar", "vector"]


def merge_fill(layers: DataFrame, keys: Sequence[str] = ("owner", "path"), order: Sequence[str] = ("layer", "seq")) -> DataFrame:
    """The first layer to set a path keeps it."""
    first = F.min_by(F.struct("seq", *VALUE), F.struct(*order)).alias("_first")
    return layers.groupBy(*keys).agg(first).select(*keys, "_first.*")


def merge_override(layers: DataFrame, keys: Sequence[str], present: dict[str, Column], order: Sequence[str]) -> DataFrame:
    """The last layer with a value sets a field.

    ``present`` tells for each field when a layer counts as having a value.
    """
    fields = [F.max_by(F.when(has, F.col(name)), F.when(has, F.struct(*order))).alias(name) for name, has in present.items()]
    return layers.groupBy(*keys).agg(*fields)


def merge_where(base: DataFrame, source: DataFrame, accept: Column, keys: Sequence[str] = ("owner", "path")) -> DataFrame:
    """Source rows that are accepted overwrite those of the base."""
    both = base.withColumn("_rank", F.lit(0)).unionByName(source.filter(accept).withColumn("_rank", F.lit(1)))
    kept = [c for c in base.columns if c not in keys]
    last = F.max_by(F.struct(*kept), F.col("_rank")).alias("_last")
    return both.groupBy(*keys).agg(last).select(*keys, "_last.*")


def merge_accepted(layers: DataFrame, accept: Column, keys: Sequence[str] = ("owner", "path")) -> DataFrame:
    """Layer 0, overwritten by the accepted rows of the layers above it in their order: merge_where applied layer by layer, in one grouping."""
    kept = [c for c in layers.columns if c not in (*keys, "layer")]
    last = F.max_by(F.struct(*kept), F.col("layer")).alias("_last")
    return layers.filter((F.col("layer") == 0) | accept).groupBy(*keys).agg(last).select(*keys, "_last.*")


def normalize_paths(settings: DataFrame, keys: Sequence[str] = ("owner",)) -> DataFrame:
    """Paths with single slashes.

    Where two rows meet on one path, the one whose path had to be changed
    overwrites the clean one; among several, the latest.
    """
    clean = text.normalize_path(F.col("path"))
    priority = F.struct((F.col("path") != clean).alias("_changed"), F.col("seq"))
    last = F.max_by(F.struct("seq", *VALUE), priority).alias("_last")
    return settings.groupBy(*keys, clean.alias("path")).agg(last).select(*keys, "path", "_last.*")


def effective_settings(layers: DataFrame) -> DataFrame:
    """Layers merged on their raw paths, then normalized."""
    return normalize_paths(merge_fill(layers))


def filter_sections(
    settings: DataFrame,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    include_unspecified: bool = True,
) -> DataFrame:
    """Rows of the wanted sections.

    Paths without a section follow the flag; an unknown section is dropped.
    """
    named = text.SECTION_ALIASES if include is None else include
    kept = [section for section in named if section not in (exclude or ())]
    kept += ["none"] if include_unspecified else []
    return settings.withColumn("section", text.path_section(F.col("path"))).filter(F.col("section").isin(kept))


def section_files(settings: DataFrame, section: str, include_unspecified: bool, owner: str = "owner") -> DataFrame:
    """Files of one section: the last path segment names the file, the scalar is its content.

    Vectors are skipped.  If two paths end in the same name, the greater path wins.
    """
    wanted = filter_sections(settings.filter("is_scalar"), [section], None, include_unspecified)
    return (
        wanted.withColumn("file", text.last_segment(F.col("path")))
        .filter("file <> ''")
        .groupBy(owner, "file")
        .agg(F.max_by("scalar", "path").alias("content"))
    )


def inherit_settings(
    replicas: DataFrame, installation: DataFrame, cluster: DataFrame, shard: DataFrame, replica: DataFrame
) -> DataFrame:
    """Settings and files each replica ends up with.

    Rows carry ``kind`` ('files' or 'settings').  Only HOST files pass from an
    installation to its clusters, and those overwrite the cluster's own.
    Below, the nearer level wins.  Everything is resolved per shard first and
    only then spread over the replicas.
    """
    shards = replicas.select("inst", "cluster", "shard_name").distinct()
    row = ["kind", "path", *VALUE]

    def ranked(df: DataFrame, on: str, rank: int) -> DataFrame:
        return df.join(shards, on).select("shard_name", *row, F.lit(rank).alias("_rank"))

    host_files = installation.filter((F.col("kind") == "files") & (text.path_section(F.col("path")) == "HOST"))
    levels = (
        shard.select("shard_name", *row, F.lit(0).alias("_rank"))
        .unionByName(ranked(host_files.select("inst", *row), "inst", 1))
        .unionByName(ranked(cluster.select("cluster", *row), "cluster", 2))
    )
    per_shard = (
        levels.groupBy("shard_name", "kind", "path")
        .agg(F.min_by(F.struct(*VALUE), F.col("_rank")).alias("_first"))
        .select("shard_name", "kind", "path", "_first.*")
    )
    inherited = (
        replicas.select("replica_name", "shard_name")
        .join(per_shard, "shard_name")
        .join(replica.select("replica_name", "kind", "path"), ["replica_name", "kind", "path"], "left_anti")
    )
    own = replica.join(replicas.select("replica_name"), "replica_name", "left_semi")
    return own.select("replica_name", *row).unionByName(inherited.select("replica_name", *row))


def fold_configs(configs: DataFrame, keys: Sequence[str], present: dict[str, Column], defaults: dict[str, object]) -> DataFrame:
    """Base file, then custom configs by name, then defaults for what is still empty.

    ``configs`` has ``is_custom``, ``name`` and ``seq``.
    """
    folded = merge_override(configs, keys, present, ["is_custom", "name", "seq"])
    filled = [F.coalesce(F.col(name), F.lit(defaults[name])).alias(name) for name in present]
    return folded.select(*keys, *filled)


def fingerprint(settings: DataFrame) -> DataFrame:
    """One digest per owner over all (path, value) pairs.

    Paths are unique per owner, so the pairs form a set and can be folded in
    any order: each pair is hashed and the words are XORed.  An owner with very
    many settings is folded on the map side like any other.
    """
    pair = F.concat("path", F.lit("\u0001"), text.setting_text(F.col("is_scalar"), F.col("scalar"), F.col("vector")))
    first, second = hashes.row_words(pair)
    return (
        settings.groupBy("owner")
        .agg(F.count(F.lit(1)).alias("settings"), F.bit_xor(first).alias("_a"), F.bit_xor(second).alias("_b"))
        .select(
            "owner", "settings", hashes.folded_fingerprint(F.col("settings"), F.col("_a"), F.col("_b")).alias("fingerprint")
        )
    )


def sorted_settings(settings: DataFrame) -> DataFrame:
    """Settings as (path, value text), sorted by path within each owner."""
    value = text.setting_text(F.col("is_scalar"), F.col("scalar"), F.col("vector"))
    return settings.select("owner", "path", value.alias("value")).orderBy("owner", "path")


def bool_tally(settings: DataFrame, default: bool = False) -> DataFrame:
    value = text.flag_text(F.col("scalar"), default)
    return settings.filter("is_scalar").groupBy("owner", value.alias("value")).agg(F.count(F.lit(1)).alias("settings"))


def port_inventory(owners: DataFrame, settings: DataFrame, ports: dict[str, str]) -> DataFrame:
    """Owners per resolved port; 0 stands for a port that is unset or no number."""
    known = settings.filter(F.col("is_scalar") & F.col("path").isin(list(ports.values())))
    found = known.groupBy("owner").agg(*[F.max(F.when(F.col("path") == path, F.col("scalar"))).alias(f"_{name}") for name, path in ports.items()])
    resolved = F.array(
        *[F.struct(F.lit(name).alias("kind"), F.coalesce(text.int_or_zero(F.col(f"_{name}")), F.lit(0)).alias("port")) for name in ports]
    )
    return (
        owners.select("owner")
        .join(found, "owner", "left")
        .select(F.inline(resolved))
        .groupBy("kind", "port")
        .agg(F.count(F.lit(1)).alias("owners"))
    )


# What a user gets who lacks it.
DEFAULT_USER = "default"
DEFAULT_PROFILE = "default"
DEFAULT_QUOTA = "default"
DEFAULT_NETWORKS = ["::/0"]
DEFAULT_PASSWORD = "default"
REMOVED = "_removed_"


def user_defaults(settings: DataFrame, owners: DataFrame) -> DataFrame:
    """User settings with everything a user must have.

    ``settings`` has unique paths ``user/key`` per owner; ``owners`` is
    ``(owner, host_regexp)``.  Every owner gets the default user.  A password
    turns into its digest and goes away, for the default user as a removal
    mark.  The users' keys are folded into one row per user, so the missing
    ones are found without a join per key.
    """
    has_user = F.col("path").contains("/")
    user = F.substring_index("path", "/", 1)
    key = F.expr("substring(path, length(substring_index(path, '/', 1)) + 2)")
    split = settings.select("owner", "path", *VALUE, F.when(has_user, user).alias("user"), F.when(has_user, key).alias("key"))

    named = split.filter("user IS NOT NULL").select("owner", "user", "key", F.struct(*VALUE).alias("value"))
    blank = F.lit(None).cast(named.schema["value"].dataType)
    default_users = owners.select("owner", F.lit(DEFAULT_USER).alias("user"), F.lit("").alias("key"), blank.alias("value"))
    has = lambda name: F.max(F.col("key") == name)
    users = (
        named.unionByName(default_users)
        .groupBy("owner", "user")
        .agg(
            has("profile").alias("_profile"),
            has("quota").alias("_quota"),
            has("networks/ip").alias("_ip"),
            has("networks/host_regexp").alias("_regexp"),
            has("password").alias("_password"),
            has("password_sha256_hex").alias("_digest"),
            F.max(F.when(F.col("key") == "password", F.col("value"))).alias("_old"),
        )
        .join(owners.select("owner", "host_regexp"), "owner", "left")
    )
    is_default = F.col("user") == DEFAULT_USER
    password = F.when(
        F.col("_password"), text.setting_text(F.col("_old.is_scalar"), F.col("_old.scalar"), F.col("_old.vector"))
    ).otherwise(F.when(is_default, F.lit("")).otherwise(F.lit(DEFAULT_PASSWORD)))
    users = users.withColumn("_pass", password).withColumn("_make", (F.col("_pass") != "") & ~F.col("_digest"))
    digested = F.col("_digest") | F.col("_make")

    no_vector = F.lit(None).cast("array<string>")

    def row(name: str, scalar: Column | None = None, vector: Column | None = None) -> Column:
        return F.struct(
            F.concat("user", F.lit("/" + name)).alias("path"),
            F.lit(vector is None).alias("is_scalar"),
            (F.lit(None).cast("string") if scalar is None else scalar).alias("scalar"),
            (no_vector if vector is None else vector).alias("vector"),
        )

    kept_password = F.struct(
        F.concat("user", F.lit("/password")).alias("path"), *[F.col(f"_old.{c}").alias(c) for c in VALUE]
    )
    made = F.array(
        F.when(~F.col("_profile"), row("profile", F.lit(DEFAULT_PROFILE))),
        F.when(~F.col("_quota"), row("quota", F.lit(DEFAULT_QUOTA))),
        F.when(~F.col("_ip"), row("networks/ip", vector=F.array(*[F.lit(n) for n in DEFAULT_NETWORKS]))),
        F.when(~F.col("_regexp"), row("networks/host_regexp", F.col("host_regexp"))),
        F.when(F.col("_make"), row("password_sha256_hex", hashes.password_digest(F.col("_pass")))),
        F.when(digested & is_default, row("password", F.lit(REMOVED))),
        F.when(~digested & F.col("_password"), kept_password),
    )
    generated = users.select("owner", F.inline(F.filter(made, lambda r: r.isNotNull())))
    kept = split.filter("key IS NULL OR key <> 'password'").select("owner", "path", *VALUE)
    return kept.unionByName(generated)
