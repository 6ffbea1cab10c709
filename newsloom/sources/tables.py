"""File sources and sinks: evaluation tables, reports, manifests. Paths go to Spark's readers and writers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of evaluation tables that are text; all others are numbers.
TEXT_COLUMNS = ("run_name", "model", "model_scope", "model_family", "language", "xlsum_subset", "split", "sample_id")
DROPPED_TEXTS = ("title", "source_text", "reference_summary", "generated_summary")
DETAIL_ROWS = 100_000


def read_scores(spark: SparkSession, path: str, drop: tuple[str, ...] = DROPPED_TEXTS) -> DataFrame:
    """A CSV with a header; long texts aren't read, what isn't text becomes a number or null."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    return df.select(*[F.col(c) if c in TEXT_COLUMNS else F.col(c).try_cast("double").alias(c) for c in df.columns if c not in drop])


def discover_runs(spark: SparkSession, root: str, needed: tuple[str, ...], ignored: tuple[str, ...] = ()) -> list[str]:
    """Folders under ``root`` that hold all needed files, by name; ignored folder names are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    names: dict[str, set[str]] = {}
    while files.hasNext():
        p = files.next().getPath()
        names.setdefault(p.getParent().toString(), set()).add(p.getName())
    return sorted(d for d, have in names.items() if set(needed) <= have and not set(d.split("/")) & set(ignored))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def gated_keys(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Source keys that the newest validation report marks as not passed; the first path that has any wins."""
    for path in paths:
        rows = spark.read.schema("source_key string, pass boolean").option("multiLine", True).json(path).select("source_key", "pass", F.col("_metadata.file_modification_time").alias("at"))
        newest = rows.withColumn("__last", F.max("at").over(Window.partitionBy())).where("at = __last and not coalesce(pass, false)").select("source_key").distinct()
        if not newest.isEmpty():
            return newest
    return spark.createDataFrame([], "source_key string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """S16."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def write_scores(df: DataFrame, path: str, formats: tuple[str, ...] = ("csv", "json")) -> None:
    """K4, K6: the same rows in each format, in a folder of its own."""
    for f in formats:
        writer = df.write.mode("overwrite")
        (writer.option("header", True).option("escape", '"').csv if f == "csv" else getattr(writer, f))(f"{path}/{f}")


def detail_sheet(df: DataFrame, order: list[str]) -> DataFrame:
    """K5: what a workbook's detail sheet may hold, in a fixed order."""
    return df.orderBy(*order).limit(DETAIL_ROWS)


def markdown(df: DataFrame, most: int = 25) -> str:
    """The first rows as a Markdown table; null and NaN are a dash."""
    show = lambda v: "-" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *([show(v) for v in r] for r in df.take(most))]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def appendix(manifest: DataFrame) -> DataFrame:
    """K9: run, category and their figures in order, as one block of LaTeX for each category; paths that aren't images are listed."""
    special = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    escapes = F.create_map(*[F.lit(v) for kv in special.items() for v in kv])
    chars = lambda c: F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), ""), lambda x: F.coalesce(F.try_element_at(escapes, x), x)), "")
    line = F.when(F.col("path").endswith(".png"), F.concat(F.lit(r"\includegraphics{"), F.col("path"), F.lit(r"}\caption{"), chars(F.col("title")), F.lit("}"))).otherwise(F.concat(F.lit(r"\item "), chars(F.col("title")), F.lit(": "), chars(F.col("path"))))
    return manifest.withColumn("line", line).groupBy("run", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda x: x["line"]), "\n").alias("latex"))
