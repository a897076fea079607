"""Configuration files of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions read from the configuration and template folders.
CONFIG_EXTENSIONS = (".xml",)
TEMPLATE_EXTENSIONS = (".yaml", ".json")


def scan_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = CONFIG_EXTENSIONS) -> DataFrame:
    """``(file, content)`` of the folder's own files with an accepted extension.

    The extension is compared in lower case, so it is tested on the column and
    not by a glob.  Empty files are dropped; a missing folder gives no rows.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], "file string, content string")
    accepted = F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1)).isin(*extensions)
    return (
        spark.read.text(folder, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
        .filter(accepted & (F.col("content") != ""))
    )
