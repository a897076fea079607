"""Text expressions on statements, paths, numbers and flags (all built-in, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that read the target of a distributed table out of its
# engine text, and the statement kinds that take IF NOT EXISTS.
TARGET_DATABASE = r"Distributed\([^,]+, *'?([^,']+)'?, *[^,]+"
TARGET_TABLE = r"Distributed\([^,]+, [^,]+, *'?([^,')]+)"
CREATE_KIND = r"CREATE (TABLE|VIEW|MATERIALIZED VIEW)"

# Spellings of a flag.
TRUE_WORDS = ["1", "true", "yes", "on", "enabled"]
FALSE_WORDS = ["0", "false", "no", "off", "disabled"]

# Configuration sections and the folder names that mean the same.
SECTION_ALIASES = {
    "COMMON": ["common", "config.d"],
    "USERS": ["users", "users.d"],
    "HOST": ["host", "conf.d"],
}

# Fixed value: a fraction up to this size is dropped when a number becomes text.
FRACTION_THRESHOLD = 0.001


def target_database(engine_full: Column) -> Column:
    return F.regexp_extract(engine_full, TARGET_DATABASE, 1)


def target_table(engine_full: Column) -> Column:
    return F.regexp_extract(engine_full, TARGET_TABLE, 1)


def if_not_exists(statement: Column) -> Column:
    """Add IF NOT EXISTS to the first CREATE only.

    ``regexp_replace`` replaces every match, so the pattern is anchored and
    takes the shortest text before the first CREATE.
    """
    return F.regexp_replace(statement, rf"(?s)^(.*?){CREATE_KIND}", "$1CREATE $2 IF NOT EXISTS")


def create_database(database: Column) -> Column:
    return F.concat(F.lit('CREATE DATABASE IF NOT EXISTS "'), database, F.lit('"'))


def drop_table(database: Column, name: Column) -> Column:
    return F.concat(F.lit('DROP TABLE IF EXISTS "'), database, F.lit('"."'), name, F.lit('"'))


def attach_on_conflict(statement: Column, error_code: Column) -> Column:
    """A CREATE TABLE refused with code 253 is tried again as ATTACH TABLE."""
    refused = (error_code == 253) & statement.contains("CREATE TABLE")
    return F.when(refused, F.replace(statement, F.lit("CREATE TABLE"), F.lit("ATTACH TABLE"))).otherwise(statement)


def normalize_path(path: Column) -> Column:
    """Single slashes, none at either end."""
    return F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "^/|/$", "")


def path_section(path: Column) -> Column:
    """COMMON, USERS or HOST; 'none' below two segments; 'unknown' otherwise."""
    known = F.create_map(*[F.lit(part) for name, words in SECTION_ALIASES.items() for word in words for part in (word, name)])
    head = F.lower(F.substring_index(path, "/", 1))
    return F.when(path.contains("/"), F.coalesce(F.element_at(known, head), F.lit("unknown"))).otherwise("none")


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def number_text(number: Column) -> Column:
    """A number as a settings value: whole numbers have no fraction part.

    The test on the fraction is signed, so a negative fraction is cut off.  A
    number beyond 64 bits is written out in whole digits.
    """
    x = number.cast("double")
    whole = x.try_cast("bigint")
    return F.when(x - whole > FRACTION_THRESHOLD, F.format_string("%.6f", x)).otherwise(
        F.coalesce(whole.cast("string"), F.when(x.isNotNull(), F.format_string("%.0f", x)))
    )


def flag_text(text: Column, default: Column | bool, true: str = "true", false: str = "false") -> Column:
    """Cast the spellings of a flag to one pair of words; unknown text gives the default."""
    default = default if isinstance(default, Column) else F.lit(default)
    word = F.lower(text)
    return (
        F.when(word.isin(TRUE_WORDS), F.lit(true))
        .when(word.isin(FALSE_WORDS), F.lit(false))
        .otherwise(F.when(default, F.lit(true)).otherwise(F.lit(false)))
    )


def setting_text(is_scalar: Column, scalar: Column, vector: Column) -> Column:
    """A setting as one string; a vector is joined by commas."""
    return F.when(is_scalar, scalar).otherwise(F.array_join(vector, ","))


def int_or_zero(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int")), F.lit(0))


def endpoint(user: Column, password: Column, host: Column, port: Column) -> Column:
    credentials = (
        F.when((user == "") & (password == ""), F.lit(""))
        .when(password == "", F.concat(user, F.lit("@")))
        .otherwise(F.concat(user, F.lit(":"), password, F.lit("@")))
    )
    return F.concat(F.lit("http://"), credentials, host, F.lit(":"), port.cast("string"), F.lit("/"))


def masked_endpoint(url: Column) -> Column:
    """Credentials hidden; the masked form carries the pair even where none was given."""
    return F.regexp_replace(url, "^http://([^/]*@)?", "http://***:***@")


def split_namespaces(text: str) -> list[str]:
    """A namespace list written with ':' or ','; empty parts are dropped."""
    return [part for part in text.replace(":", ",").split(",") if part]
