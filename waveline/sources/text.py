"""Key lists and pairs as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tokens(line: Column) -> Column:
    """Integers of a line, split at commas and white space; other tokens raise an error."""
    return F.transform(F.filter(F.split(F.regexp_replace(line, "[()]", ""), r"[,\s]+"), lambda x: F.length(x) > 0), lambda x: x.cast("long"))


def keys_of_lines(lines: DataFrame, levels: int | None = None) -> DataFrame:
    """(node, pos, key) of (node, value) lines; ``levels`` checks that keys lie in the domain."""
    keys = lines.select("node", F.posexplode(tokens(F.col("value"))).alias("pos", "key")).withColumn("pos", F.col("pos").cast("long"))
    if levels is None:
        return keys
    inside = F.col("key").between(1, 1 << levels)
    return keys.withColumn("key", F.when(inside, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("key outside the domain: "), F.col("key").cast("string"))).cast("long")))


def node_id(*columns: Column | str) -> Column:
    """A node's name: the sha1 of some columns, joined by a bar."""
    return F.sha1(F.concat_ws("|", *columns).cast("binary"))


def read_keys(spark: SparkSession, path: str, levels: int | None = None, glob: str | None = None) -> DataFrame:
    """Keys of text files; a line is a node, named by the sha1 of its file and content."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.text(path).select("value", node_id(F.col("_metadata.file_path"), "value").alias("node"))
    return keys_of_lines(lines, levels)


def lines_of_keys(keys: DataFrame, by: tuple[str, ...] = (), per_line: int = 1000) -> DataFrame:
    """(by, value): comma-joined keys, at most ``per_line`` to a line, in no order."""
    dealt = keys.select(*by, "key", F.floor(F.monotonically_increasing_id() / per_line).alias("_line"))
    return dealt.groupBy(*by, "_line").agg(F.array_join(F.collect_list(F.col("key").cast("string")), ",").alias("value")).drop("_line")


def write_keys(keys: DataFrame, path: str, mode: str = "overwrite", per_line: int = 1000) -> None:
    """Comma-joined keys, at most ``per_line`` to a line, in no order."""
    lines_of_keys(keys, per_line=per_line).write.mode(mode).text(path)


_NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
_PAIR = rf"^\s*\(?\s*(-?\d+)\s*,\s*{_NUMBER}\s*\)?\s*$"


def parse_pairs(lines: DataFrame, names: tuple[str, str], value_type: str) -> DataFrame:
    """Two columns of ``(k,v)`` lines, parentheses optional, signs kept."""
    part = lambda n: F.regexp_extract("value", _PAIR, n)
    return lines.where(F.length(F.trim("value")) > 0).select(part(1).cast("long").alias(names[0]), part(2).cast(value_type).alias(names[1]))


def format_pairs(df: DataFrame) -> DataFrame:
    """One ``(k,v)`` line for each row of two columns."""
    a, b = df.columns
    return df.select(F.concat(F.lit("("), F.col(a).cast("string"), F.lit(","), F.col(b).cast("string"), F.lit(")")).alias("value"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return parse_pairs(spark.read.text(path), ("key", "freq"), "long")


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """The last of several lines of one index isn't defined in files; indexes are expected once."""
    return parse_pairs(spark.read.text(path), ("idx", "coef"), "double")


def write_pairs(df: DataFrame, path: str, mode: str = "overwrite", single: bool = True) -> None:
    """``(k,v)`` lines; ``single`` gathers them in one file (meant for small results)."""
    lines = format_pairs(df)
    (lines.coalesce(1) if single else lines).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single: bool = True) -> None:
    (df.coalesce(1) if single else df).write.mode(mode).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path)


def write_listing(freq: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``key,freq`` lines in order of the key; files follow each other in their names' order."""
    freq.orderBy("key").select(F.concat_ws(",", F.col("key").cast("string"), F.col("freq").cast("string")).alias("value")).write.mode(mode).text(path)


def write_ranks(listing: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``rank,key,probability`` lines in order of the rank."""
    listing.orderBy("rank").select(F.concat_ws(",", *(F.col(c).cast("string") for c in ("rank", "key", "p"))).alias("value")).write.mode(mode).text(path)
