"""Separation of delimited rows that don't parse, with the reason, from rows that do.

Every line is cut into cells, the cells are exploded into (row, column, value), a rule table is joined
by column, and only the cells that break a rule are aggregated into one error per row.  Clean rows are
what an anti join with the errors leaves.  All of it are built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

QUOTING, COLUMNS, VALUE = "quoting", "columns", "value"
_PROTECTED = "\ue000"  # stands for a comma inside quotes while a line is split; never valid itself, as fields are ASCII


@dataclass(frozen=True)
class Rule:
    """``pattern``: a regular expression for the whole value; ``timestamp``: a format the value must also parse by;
    ``cast``: the type of the loaded column."""

    name: str
    pattern: str
    timestamp: str | None = None
    cast: str = "string"


#: The seven metadata fields and their formats.
METADATA_RULES = (
    Rule("warc_trec_id", r"xc12-[0-9]{4}[a-z]{2}-[0-9]{2}-[0-9]{5}"),
    Rule("warc_date", r"(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z", "yyyy-MM-dd'T'HH:mm:ss'Z'", "timestamp"),
    Rule("warc_target_uri", r"https?://[^\s\x1c-\x1f]+"),
    Rule("content_type", r"(?:[A-Za-z0-9.+-]+/[A-Za-z0-9.+-]+(?:;[\s\S]*)?)?"),
    Rule("content_length", r"[0-9]+", cast="bigint"),
    Rule("http_status", r"[1-5][0-9]{2}", cast="int"),
    Rule("warc_payload_digest", r"(?:sha1:[A-Z2-7]{32})?"),
)


def split_cells(line: Column) -> Column:
    """The raw cells of a line: it is cut at the commas with an even number of quotes before them.

    On a line that keeps the quoting rules these are its fields, quotes included.  A null line has no cells.
    """
    inside = F.transform(F.split(line, '"', -1), lambda s, i: F.when(i % 2 == 1, F.replace(s, F.lit(","), F.lit(_PROTECTED))).otherwise(s))
    return F.transform(F.split(F.array_join(inside, '"'), ",", -1), lambda c: F.replace(c, F.lit(_PROTECTED), F.lit(",")))


def _inner(cell: Column) -> Column:
    return cell.substr(F.lit(2), F.greatest(F.length(cell) - 2, F.lit(0)))


def badly_quoted(cell: Column) -> Column:
    """True if the cell breaks a quoting rule."""
    closed = (F.length(cell) >= 2) & cell.endswith('"') & ~F.replace(_inner(cell), F.lit('""'), F.lit("")).contains('"')
    return F.when(cell.startswith('"'), ~closed).otherwise(cell.contains('"'))


def unquote(cell: Column) -> Column:
    return F.when(cell.startswith('"'), F.replace(_inner(cell), F.lit('""'), F.lit('"'))).otherwise(cell)


def rule_table(spark, rules=METADATA_RULES) -> DataFrame:
    """(col, name, pattern, ts_format): a row for each column; its size is that of the format."""
    rows = [(i, r.name, f"^(?:{r.pattern})\\z", r.timestamp) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "col int, name string, pattern string, ts_format string")


def find_errors(df: DataFrame, key: str, line: str = "line", rules=METADATA_RULES) -> DataFrame:
    """(key, reason) of each row that doesn't parse, with the first of ``quoting``, ``columns``, ``value`` that applies.

    A null line has no fields: ``columns``; an empty one has a single field.  Characters beyond ASCII break ``value``.
    ``key`` identifies a row: rows with the same key count as one, which has the first reason of any of them.
    Other columns of ``df`` are ignored, whatever their names.
    """
    n = len(rules)
    base = df.select(F.col(key).alias("_key"), F.col(line).alias("_line")).withColumn("_cells", split_cells(F.col("_line")))
    row_level = F.when(F.col("_line").isNull(), 2).when(F.exists("_cells", badly_quoted), 1).when(F.size("_cells") != n, 2)
    base = base.withColumn("_row", row_level)
    cells = base.select("_key", "_row", F.col("_line").rlike(r"[^\x00-\x7f]").alias("_wide"), F.posexplode_outer(F.when(F.col("_row").isNull(), F.transform("_cells", unquote))).alias("col", "value"))
    spark = df.sparkSession
    checked = cells.join(F.broadcast(rule_table(spark, rules)), "col", "left")  # as many rows as a line has fields
    ok = F.expr("value rlike pattern")
    stamp = F.coalesce(*[F.when(F.col("ts_format") == f, F.expr(f"try_to_timestamp(value, \"{f}\")").isNotNull()) for f in {r.timestamp for r in rules if r.timestamp}], F.lit(True))
    bad_cell = F.when(F.col("_row").isNull() & (F.col("_wide") | ~ok | ~stamp), 3)
    errors = checked.withColumn("_bad", F.coalesce("_row", bad_cell)).where(F.col("_bad").isNotNull())
    code = errors.groupBy("_key").agg(F.min("_bad").alias("_bad"))
    return code.select(F.col("_key").alias(key), F.element_at(F.array(F.lit(QUOTING), F.lit(COLUMNS), F.lit(VALUE)), F.col("_bad")).alias("reason"))


def load_rows(df: DataFrame, key: str, line: str = "line", rules=METADATA_RULES) -> tuple[DataFrame, DataFrame]:
    """(valid, errors): the rows that parse, with one typed column for each rule, and ``find_errors``.

    Columns of ``df`` other than ``key`` and ``line`` are kept, but one named like a rule's column gets an underscore
    before its name.  Empty values load as null in typed columns and as empty strings elsewhere.
    """
    errors = find_errors(df, key, line, rules)
    names = {r.name for r in rules}
    kept = [F.col(c).alias(f"_{c}" if c in names else c) for c in df.columns if c != line]
    clean = df.join(errors.select(key), key, "left_anti")
    cells = clean.withColumn("_cells", F.transform(split_cells(F.col(line)), unquote))
    typed = []
    for i, r in enumerate(rules):
        raw = F.col("_cells")[i]
        if r.timestamp:
            typed.append(F.to_timestamp(raw, r.timestamp).alias(r.name))
        else:
            typed.append((raw if r.cast == "string" else F.expr(f"try_cast(_cells[{i}] AS {r.cast})")).alias(r.name))
    return cells.select(*kept, *typed), errors
