"""Sources around the tables: plan files, delimited metadata, fetched API replies, upserts and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemiciclo.functions import text as T


def plan_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each text file below folder: path, party, doc_id, text. Summaries are left out."""
    raw = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    kept = raw.where(F.col("path").rlike(r"(?i)\.txt$") & ~F.col("path").rlike(r"(?i)resumen\.txt$")).withColumn("path", F.url_decode("path"))
    name = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"(?i)\.txt$", "")
    return kept.select("path", T.leading_part(F.col("path")).alias("party"), T.doc_id(name).alias("doc_id"), "text")


def series_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A metadata table of the kind central banks publish: semicolons, Latin-1."""
    return spark.read.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)


def delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """A delimited file with a header, its types inferred unless a schema is given; quoted fields may hold line ends, broken ones are null."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def monthly_snapshot(replies: DataFrame, code: str, body: str, prefer_year: int) -> DataFrame:
    """code, series, period, year and value: the last value of a year up to prefer_year, else the last.

    A reply that can't be read, or has no value, gives one row of nulls.
    """
    shape = "config struct<series: array<struct<name: string>>>, periods array<struct<name: string, values: array<string>>>"
    parsed = replies.select(F.col(code).alias("code"), F.from_json(body, shape).alias("j"))
    points = parsed.select("code", F.get(F.col("j.config.series"), F.lit(0))["name"].alias("series"), F.posexplode_outer("j.periods").alias("pos", "p"))
    year = F.coalesce(F.nullif(F.regexp_extract("p.name", r"((?:19|20)\d{2})", 1), F.lit("")), F.concat(F.lit("20"), F.nullif(F.regexp_extract("p.name", r"\.(\d{2})$", 1), F.lit("")))).try_cast("int")
    points = points.select("code", "series", "pos", F.col("p.name").alias("period"), year.alias("year"), F.get(F.col("p.values"), F.lit(0)).try_cast("double").alias("value"))
    order = F.struct(F.col("value").isNotNull(), F.coalesce(F.col("year") <= prefer_year, F.lit(False)), F.col("pos"))
    best = points.groupBy("code").agg(F.max_by(F.struct("series", "period", "year", "value"), order).alias("b"))
    return best.select("code", "b.*")


def yearly_latest(replies: DataFrame, code: str, body: str) -> DataFrame:
    """code, indicator, year and value: the newest year with a value of a [meta, rows] reply."""
    rows = F.from_json(F.get_json_object(body, "$[1]"), "array<struct<date: string, value: double, indicator: struct<value: string>>>")
    points = replies.select(F.col(code).alias("code"), F.explode_outer(rows).alias("x"))
    return points.groupBy("code").agg(F.max_by(F.struct(F.col("x.indicator.value").alias("indicator"), F.col("x.date").try_cast("int").alias("year"), F.col("x.value").alias("value")), F.when(F.col("x.value").isNotNull(), F.col("x.date").try_cast("int"))).alias("b")).select("code", "b.*")


def upserted(keys: list[str], *sources: DataFrame) -> DataFrame:
    """The rows of all sources by name; of equal keys the row of the last source. Missing columns are null."""
    parts = [s.withColumn("__src", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = [c for c in rows.columns if c not in (*keys, "__src")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "__src").alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in columns))


def with_contract(df: DataFrame, required: list[str], fallback: DataFrame) -> DataFrame:
    """df if it has all required columns, else fallback."""
    return df if set(required) <= set(df.columns) else fallback


def write_rows(df: DataFrame, path: str, kind: str = "parquet", once: bool = False) -> None:
    """Parquet, JSON (nulls kept) or CSV; `once` leaves what is there."""
    w = df.write.mode("ignore" if once else "overwrite")
    {"parquet": lambda: w.parquet(path), "json": lambda: w.option("ignoreNullFields", "false").json(path), "csv": lambda: w.option("header", True).csv(path), "text": lambda: w.text(path)}[kind]()


def extracted_pages(files: DataFrame, extractor, key: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Pages (path, page_no, text) and errors (path, error) of binary files.

    extractor takes bytes and gives a list of page texts; it is shipped to the executors, since no
    reader of page formats is part of the engine. A file that fails, has no pages or only blank
    ones gives one error row, and the others go on. Files are read once for either result.
    """
    import pandas as pd

    def run(batches):
        for table in batches:
            rows = []
            for path, data in zip(table[key], table[content]):
                try:
                    pages = list(extractor(bytes(data)))
                    problem = "no pages" if not pages else "no text" if not any((p or "").strip() for p in pages) else None
                except Exception as e:  # noqa: BLE001 - any failure of a file is a row of its own
                    pages, problem = [], f"{type(e).__name__}: {e}"
                rows += [(path, None, None, problem)] if problem else [(path, i, p, None) for i, p in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=[key, "page_no", "text", "error"]).astype({"page_no": "Int32"})

    both = files.select(key, content).mapInPandas(run, f"{key} string, page_no int, text string, error string")
    return both.where("error IS NULL").drop("error"), both.where("error IS NOT NULL").select(key, "error")


def built_baseline(spec: DataFrame, snapshots: DataFrame, metadata: DataFrame, code: str, digits: int = 6) -> DataFrame:
    """The specified series with their snapshot and metadata; a series without either keeps nulls."""
    values = snapshots.withColumn("value", F.round("value", digits))
    return spec.join(values, code, "left").join(metadata.dropDuplicates([code]), code, "left")


def replaced(base: DataFrame, fresh: DataFrame, keys: list[str], stale) -> DataFrame:
    """base without its stale rows, with the fresh ones upserted: the same at every repetition."""
    return upserted(keys, base.where(~F.coalesce(stale, F.lit(False))), fresh)


def missing_values(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNull()).select(key)
