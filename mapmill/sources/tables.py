"""CSV tables, whole texts and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapmill.functions.text import squeeze
from mapmill.functions.years import has_year
from mapmill.operators.ranking import first_n, rank_by_key


def read_csv(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """A CSV table with a header; doubled quotes are one quote; a byte-order mark is dropped; blanks are null."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("nullValue", "").option("multiLine", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def with_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Exactly the given columns, in order: others are dropped, absent ones are null."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "overwrite") -> None:
    with_fields(df, fields).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def decoded(content: Column) -> Column:
    """The text of bytes; those that are no UTF-8 are left out, a replacement character that stands there stays."""
    aside = F.replace(content.cast("string"), F.lit("\ufffd"), F.lit("\ufdd0"))
    return F.replace(F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit("")), F.lit("\ufdd0"), F.lit("\ufffd"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file; bytes that are no text are left out."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def year_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): lines without white space that hold a year of 1800 to 2099."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return lines.withColumn("line", squeeze(F.col("line"))).where(has_year(F.col("line")))


def read_words(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """Words of a recogniser's TSV table (level 5 of enough confidence), with their boxes."""
    from mapmill.schemas import TESSERACT

    t = spark.read.schema(TESSERACT).option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return words_of(t, least)


def words_of(t: DataFrame, least: float = 0.0) -> DataFrame:
    box = F.array(*[F.col(c).cast("double") for c in ("left", "top")], (F.col("left") + F.col("width")).cast("double"), (F.col("top") + F.col("height")).cast("double"))
    return t.where((F.col("level") == 5) & (F.col("conf") >= least)).withColumn("bbox_pixel", box)


def summary(df: DataFrame, counts: dict[str, Column], groups: list[str] = ()) -> DataFrame:
    """(section, key, n): all rows (``total``), conditional totals by their names, and the count of each value of each grouping column (``by_`` and its name).

    All of it comes from one scan, grouped by sets, and stays rows however many values a column has. Missing values count as the empty text.
    An empty table gives no row.
    """
    marks = [F.coalesce(c, F.lit(False)).cast("long").alias(f"_c{i}") for i, c in enumerate(counts.values())]
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"_g{i}") for i, g in enumerate(groups)]
    flat = df.select(F.lit(1).cast("long").alias("_all"), *marks, *keys)
    names = [f"_g{i}" for i in range(len(groups))]
    sums = [F.sum("_all").alias("_n"), *[F.sum(f"_c{i}").alias(f"_s{i}") for i in range(len(counts))]]
    if groups:
        sets = flat.groupingSets([[], *[[F.col(n)] for n in names]], *[F.col(n) for n in names]).agg(*sums, *[F.grouping(n).alias(f"_no{n}") for n in names])
    else:
        sets = flat.agg(*sums)
    entry = lambda section, key, n: F.struct(section.alias("section"), key.alias("key"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    totals = F.array(*[entry(F.lit(name), F.lit(""), F.col(f"_s{i}")) for i, name in enumerate(counts)], entry(F.lit("total"), F.lit(""), F.col("_n")))
    rows = totals
    for n, g in zip(names, groups, strict=True):
        rows = F.when(F.col(f"_no{n}") == 0, F.array(entry(F.lit(f"by_{g}"), F.col(n), F.col("_n")))).otherwise(rows)
    return sets.select(F.inline(rows))


def sample_report(sample: DataFrame, title: str, columns: list[str], order: list[Column], group: str | None = None) -> DataFrame:
    """(line_no, line) of a Markdown report of a sample: how many rows of each ``group`` it has, and all its rows in ``order``."""
    spark = sample.sparkSession
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("/"))
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    top = spark.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "line_no long, line string")
    rows = rank_by_key(sample, [], order, "_no").select(F.col("_no").alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))
    out = top.unionByName(rows)
    if group is None:
        return out
    counts = rank_by_key(sample.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g")).count(), [], [F.col("_g")], "_no")
    return out.unionByName(counts.select((F.col("_no") - 1_000_000_000).alias("line_no"), F.concat(F.lit("- "), "_g", F.lit(": "), "count").alias("line")))


def write_json(df: DataFrame, path: str) -> None:
    """A small frame as one JSON file of one object a line."""
    df.coalesce(1).write.mode("overwrite").json(path)


def ranked_report(df: DataFrame, title: str, columns: list[str], order: str, n: int) -> DataFrame:
    """(line_no, line) of a Markdown table of the first ``n`` rows by ``order``."""
    spark = df.sparkSession
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    top = spark.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "line_no long, line string")
    body = df.orderBy(order).limit(n)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    return top.unionByName(body.select(F.col(order).cast("long").alias("line_no"), row.alias("line")))


def grouped_index(df: DataFrame, group: str, name: str, order: list[Column], n: int = 80) -> DataFrame:
    """(group, total, line): the first ``n`` names of each group in one line."""
    total = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    some = first_n(df.withColumn("_o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])), [group], [F.col("_o")], n)
    line = some.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", name))), lambda x: x[name]), "、").alias("line"))
    return total.join(line, group)


def write_lines(lines: DataFrame, path: str) -> None:
    """Report lines in order, as one text file."""
    lines.repartitionByRange(1, "line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_layers(df: DataFrame, path: str, layer: str = "target_layer") -> None:
    """One folder a layer; a rerun replaces only the layers that it writes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(layer).parquet(path)
