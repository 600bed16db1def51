"""The journal of writes and the catalogue of runs, as JSON lines in a folder per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "seq bigint, book_id bigint, title string, status string, before map<string,string>, after map<string,string>, actual map<string,string>, expected map<string,string>, withheld map<string,string>, error string"
RUN = "run_id string, dry_run boolean, status string, passes array<string>, writes map<string,bigint>"


def append(records: DataFrame, folder: str) -> None:
    """Add records to a journal; what they lack of RECORD is NULL."""
    wanted = [f.split(" ")[0] for f in RECORD.split(", ")]
    kinds = dict(f.split(" ", 1) for f in RECORD.split(", "))
    cols = [F.col(c).cast(kinds[c]).alias(c) if c in records.columns else F.lit(None).cast(kinds[c]).alias(c) for c in wanted]
    records.select(*cols).write.mode("append").json(folder)


def read(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """Records of a journal. A line that is no record is passed over, or raises if strict (as an undo wants)."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(folder).where("book_id is not null")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, kind, status, passes, written) of every run whose description can be read, the oldest first. folder: holds one folder per run."""
    meta = spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(f"{folder}/*/meta.json").where("run_id is not null")
    kind = F.when(F.coalesce("dry_run", F.lit(False)), "dry run").otherwise("write")
    return meta.select("run_id", kind.alias("kind"), F.coalesce("status", F.lit("?")).alias("status"), F.array_join("passes", ",").alias("passes"), F.coalesce(F.col("writes")["applied"], F.lit(0)).alias("written")).orderBy("run_id")
