"""Reading and writing rows: JSON lines with bad rows beside, mappers, intake filters, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import written

ROW = "id string, text string, lang string, context string, sender string, student string, ts string, history array<struct<id:string,text:string>>, historyProfile string"
LEAST_CHARS = 20


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, problem of whole files; a file that isn't UTF-8 has a problem and no text. Spark passes over empty files."""
    files = spark.read.format("binaryFile").load(path)
    good = F.call_function("is_valid_utf8", F.col("content").cast("string"))
    return files.select("path", F.when(good, F.col("content").cast("string")).alias("text"), F.when(~good, "not UTF-8").alias("problem"))


def read_lines(spark: SparkSession, path: str, schema: str = ROW) -> DataFrame:
    """The rows of JSON lines with _error for those that don't parse or have no text; blank lines go.

    _file and _line keep the order of a file's rows where Spark reads it as one piece.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line")).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    error = F.when(F.col("r._corrupt").isNotNull(), "not JSON").when(F.col("r.text").isNull(), "no text")
    return parsed.select("r.*", "_file", "_line", error.alias("_error")).drop("_corrupt").withColumn("author", F.coalesce("sender", "student"))


def write_reports(reports: DataFrame, bad: DataFrame, path: str) -> None:
    """JSON lines: a report for each good row and {id, error} for each bad one, by _line within a file."""
    good = reports.select("_file", "_line", F.to_json(F.struct(*(c for c in reports.columns if not c.startswith("_")))).alias("value"))
    rest = bad.select("_file", "_line", F.to_json(F.struct("id", F.col("_error").alias("error"))).alias("value"))
    good.unionByName(rest).repartitionByRange("_file", "_line").sortWithinPartitions("_file", "_line").select("value").write.text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    """A JSON document (weights, markers, a profile); raises ValueError on what isn't one."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is not JSON: {e}") from None


def mapped(rows: DataFrame, text: Column, labels: dict, label: str, keep: Column | None = None, generator: Column | None = None) -> DataFrame:
    """text, label, generator of a source's rows: labels maps the source's label values to ours; other values go."""
    value = F.coalesce(*(F.when(F.col(label) == k, F.lit(v)) for k, v in labels.items()), F.lit(None).cast("string"))
    out = rows.where(keep) if keep is not None else rows
    return out.withColumns({"text": text, "label": value, "generator": generator if generator is not None else F.lit(None).cast("string")}).where(F.col("label").isNotNull())


def expanded(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A row for each of several text columns or arrays of texts; columns: column to label."""
    each = [_labelled(rows, c, v) for c, v in columns.items()]
    return rows.withColumn("_e", F.explode(F.concat(*each))).select(*(c for c in rows.columns if c not in columns), "_e.text", "_e.label")


def _labelled(rows: DataFrame, column: str, label: str) -> Column:
    texts = F.col(column) if rows.schema[column].dataType.typeName() == "array" else F.array(column)
    return F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(label).alias("label")))


def intake(rows: DataFrame, source: str, label: str, order: str, cap: int | None = None, dedup: bool = True, least: int = LEAST_CHARS) -> DataFrame:
    """Trimmed texts of enough length, the first of each key within a source if dedup, the first `cap` (if any) for each source and label."""
    from ..operators.evaluation import norm_key

    t = rows.withColumn("text", F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+", ""), r"\s+$", "")).where(F.char_length("text") >= least)
    if dedup:  # the least row of a key, summed before the shuffle: a hot key is no hot task
        rest = [c for c in t.columns if c not in (source, order)]
        t = t.groupBy(source, F.md5(norm_key(F.col("text")).cast("binary")).alias("_k")).agg(F.min(F.struct(order, *rest)).alias("_r")).select(source, "_r.*").select(*t.columns)
    if cap is None:
        return t
    return t.withColumn("_n", F.row_number().over(Window.partitionBy(source, label).orderBy(order))).where(F.col("_n") <= cap).drop("_n")


def pair_problems(rows: DataFrame, pair: str, audit: str, label: str) -> DataFrame:
    """Pairs that name more than one thing, or that lack a side; a pair key that has any is not used."""
    p = rows.groupBy(pair).agg(F.count_distinct(audit).alias("audits"), F.count_distinct(label).alias("sides"))
    return p.where((F.col("audits") > 1) | (F.col("sides") < 2))


def inconsistent(rows: DataFrame, holds: Column) -> DataFrame:
    """Rows whose label contradicts a second field; a source with any is refused."""
    return rows.where(~F.coalesce(holds, F.lit(False)))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with _i, their place in the order from 0: sorted in ranges and counted by range, never all in one task."""
    placed = written(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    met = placed.join(F.broadcast(offsets), part == F.col("_part"))
    return met.withColumn("_i", F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_o")


def strided(rows: DataFrame, order: str, pages: int, size: int) -> DataFrame:
    """`pages` evenly spaced pages of rows."""
    n = rows.count()
    step = max(size, n // max(1, pages))
    return numbered(rows, order).where((F.col("_i") % step < size) & (F.col("_i") < step * pages)).drop("_i")


def manifest(rows: DataFrame, text: str) -> DataFrame:
    """rows, characters and an order-free digest of a table's texts: the sum of their hashes, in which repeated rows count."""
    h = F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.char_length(text)), F.lit(0)).alias("chars"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def pseudonym(ident: Column, salt: str) -> Column:
    """A stable name for an id, which the salt alone doesn't give back."""
    return F.concat(F.lit("p"), F.substring(F.sha2(F.concat(F.lit(salt + " "), ident.cast("string")).cast("binary"), 256), 1, 12))


def without_numbers(text: Column) -> Column:
    """Long digit runs as [NUM]."""
    return F.regexp_replace(text, r"\d{10,15}", "[NUM]")


def read_stdin(spark: SparkSession, stream=None) -> DataFrame:  # noqa: ANN001
    """id, text of what stands on the standard input, one row; an empty input raises."""
    import sys

    text = (stream or sys.stdin).read()
    if not text:
        raise ValueError("no text on the standard input")
    return spark.createDataFrame([("stdin", text)], "id string, text string")


def pretty(reports: DataFrame, key: str, signals: str | None = None, most: int = 12) -> DataFrame:
    """key, report: a few lines for people: verdict, score, channels, rules, warnings and the first signals (of scoring.signals())."""
    number = lambda c: F.coalesce(F.format_number(F.col(c).cast("double"), 3), F.lit("-"))
    names = F.array_join(F.transform("rules", lambda r: F.concat(r["name"], F.lit(" ("), F.coalesce(r["matched"], F.lit("")), F.lit(")"))), ", ")
    lines = [F.concat(F.lit("verdict: "), "verdict"), F.concat(F.lit("score: "), number("score")), F.concat(F.lit("channels: machine "), number("llm_channel"), F.lit(", human "), number("human_channel")), F.concat(F.lit("rules: "), names), F.concat(F.lit("warnings: "), F.array_join("warnings", ", "))]
    if signals:
        lines += [F.array_join(F.transform(F.slice(signals, 1, most), lambda s: F.concat(F.lit("  "), s["feature"], F.lit(" "), F.format_number(s["contribution"], 3))), "\n")]
    return reports.select(key, F.concat_ws("\n", *lines).alias("report"))
