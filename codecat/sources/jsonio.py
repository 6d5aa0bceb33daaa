"""JSON sink (S6) and run-log source.

``omitempty``: empty strings become NULL first and ``to_json`` drops NULL
fields (``ignoreNullFields`` is the default), so a record prints exactly
the keys a Go ``json:",omitempty"`` tag would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecat.functions.text import empty_to_null
from codecat.operators.runstats import parse_run_logs
from codecat.schemas import RUN_LOG


def omitempty_struct(df: DataFrame, cols: list[str], omit: set[str], nested: dict[str, list[str]] | None = None
                     ) -> Column:
    """struct(...) for JSON output; ``omit`` columns drop when NULL or ''."""
    fields = []
    for c in cols:
        if nested and c in nested:
            fields.append(F.struct(*[F.col(x) for x in nested[c]]).alias(c))
        elif c in omit:
            fields.append(empty_to_null(F.col(c)).alias(c))
        else:
            fields.append(F.col(c))
    return F.struct(*fields)


def to_json_rows(df: DataFrame, cols: list[str], omit: set[str], nested: dict[str, list[str]] | None = None,
                 out: str = "json") -> DataFrame:
    """One JSON text per row."""
    return df.select("*", F.to_json(omitempty_struct(df, cols, omit, nested)).alias(out))


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """One run log per file below ``path``, in sub-folders as well -> parsed token columns with a status.

    Whole files are read (``binaryFile``: exactly one row per file) so that an
    empty file or a document spread over lines is judged as one record.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    full = raw.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("json"))
    return parse_run_logs(full.unionByName(_zero_length(raw)), "json")


def _zero_length(raw: DataFrame) -> DataFrame:
    """(file, json) of the zero-byte files under ``raw``: a run that wrote nothing is still a run (status ``empty``).

    Spark lists them, a job per level of folders where there are many, but gives no row for them.  So they are what
    its listing holds beside the rows; the listing turns into a table without passing through Python.
    """
    spark = raw.sparkSession
    jvm = spark.sparkContext._jvm
    names = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(raw._jdf.inputFiles())
    listed = spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING())
    rows = raw.select(F.input_file_name().alias("value"))
    plain = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))
    return (DataFrame(listed.toDF(), spark).join(rows, "value", "left_anti")
            .select(F.regexp_replace(plain, "^([a-z]+):///", "$1:/").alias("file"), F.lit("").alias("json")))


__all__ = ["RUN_LOG", "omitempty_struct", "to_json_rows", "read_run_logs", "parse_run_logs"]


# ----------------------------------------------------------- result documents

def _loc() -> "F.Column":
    return F.struct(F.col("file"), F.col("line").cast("int").alias("line")).alias("location")


def func_info_json(df: DataFrame, out: str = "json") -> DataFrame:
    """FuncInfo documents: name, package, receiver?, signature, is_promoted?, doc?, body?, location."""
    s = F.struct(F.col("name"), F.col("package"), empty_to_null(F.col("receiver")).alias("receiver"),
                 F.col("signature"),
                 F.when(F.coalesce(F.col("is_promoted"), F.lit(False)), F.lit(True)).alias("is_promoted")
                 if "is_promoted" in df.columns else F.lit(None).cast("boolean").alias("is_promoted"),
                 empty_to_null(F.col("doc")).alias("doc"),
                 empty_to_null(F.col("body")).alias("body") if "body" in df.columns
                 else F.lit(None).cast("string").alias("body"),
                 _loc())
    return df.select("*", F.to_json(s).alias(out))


def type_info_json(df: DataFrame, out: str = "json") -> DataFrame:
    """TypeInfo documents from ``lookup.get_type`` rows (fields / methods / embeds arrays).

    Empty arrays and empty strings are omitted, as with ``omitempty``.
    """
    def nz(c):
        return F.when(F.size(F.col(c)) > 0, F.col(c)) if c in df.columns else F.lit(None)
    fields = F.transform(nz("fields"), lambda f: F.struct(
        f["name"].alias("name"), f["type"].alias("type"),
        F.nullif(f["tag"], F.lit("")).alias("tag"), F.nullif(f["comment"], F.lit("")).alias("comment")))
    methods = F.transform(nz("methods"), lambda m: F.struct(
        m["name"].alias("name"), F.col("package").alias("package"), F.nullif(m["receiver"], F.lit("")).alias("receiver"),
        m["signature"].alias("signature"), F.when(m["is_promoted"], F.lit(True)).alias("is_promoted"),
        F.nullif(m["doc"], F.lit("")).alias("doc"),
        (F.nullif(m["body"], F.lit("")) if "body" in [f.name for f in df.schema["methods"].dataType.elementType.fields]
         else F.lit(None).cast("string")).alias("body"),
        F.struct(m["file"].alias("file"), m["line"].cast("int").alias("line")).alias("location")))
    s = F.struct(F.col("name"), F.col("package"), F.col("kind"), fields.alias("fields"), methods.alias("methods"),
                 nz("embeds").alias("embeds"), empty_to_null(F.col("doc")).alias("doc"), _loc())
    return df.select("*", F.to_json(s).alias(out))
