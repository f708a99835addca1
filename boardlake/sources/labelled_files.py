"""Labelled file trees (dataset / category / file), CSV with unknown delimiter, hashes."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = [",", ";", "\t", "|"]
RESERVED_FOLDERS = ["preparations", "artifacts", "training-jobs"]
SAMPLE_CHARACTERS = 8192
MAX_COLUMNS = 200_000
WHITE_SPACE = " \t\n\x0b\x0c\r"
BYTE_ORDER_MARK = "\ufeff"


def scan_tree(spark: SparkSession, root: str, extensions: list[str], with_content: bool = False) -> DataFrame:
    """One row per file of a dataset or of one of its categories; hidden names and reserved folders are left out.

    Extensions match in either case. Files directly below a dataset have a null category; files
    in no dataset, and those in folders below a category, belong to none. Without ``with_content``
    only file metadata is read. Spark's file sources never list names that start with ``_``, which the name
    rules allow: if there are any, this is an error rather than a loss.
    """
    refuse_unlisted(spark, root, extensions)
    either_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(either_case) + "}")
        .load(root)
    )
    relative = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    parts = F.split(relative, "/")
    files = raw.select(
        F.element_at(parts, 1).alias("dataset"),
        F.when(F.size(parts) > 2, F.element_at(parts, 2)).alias("category"),
        F.element_at(parts, -1).alias("filename"),
        relative.alias("relative_path"),
        F.col("length").alias("byte_length"),
        "modificationTime",
        *(["content"] if with_content else []),
    )
    files = files.where(F.size(F.split("relative_path", "/")).between(2, 3))
    folder = F.coalesce("category", F.lit(""))
    hidden = F.col("filename").startswith(".") | folder.startswith(".") | F.col("dataset").startswith(".")
    return files.where(~hidden & ~folder.isin(RESERVED_FOLDERS))


def refuse_unlisted(spark: SparkSession, root: str, extensions: list[str]) -> None:
    """Raise an error if the tree has files whose names, or whose folders' names, Spark never lists."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kinds = "{" + ",".join(sorted({x for e in extensions for x in (e.lower(), e.upper())})) + "}"
    base = root.rstrip("/")
    for pattern in (f"*/_*.{kinds}", f"*/*/_*.{kinds}", f"_*/*.{kinds}", f"_*/*/*.{kinds}", f"*/_*/*.{kinds}"):
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{base}/{pattern}"))
        # Spark does list names of the form _key=value.
        names = [] if found is None else [found[i].getPath().toString() for i in range(min(len(found), 20))]
        lost = [n for n in names if any(p.startswith("_") and "=" not in p for p in n[n.index(base.split(":")[-1]) + len(base.split(":")[-1]):].split("/"))]
        if lost:
            raise ValueError(f"Spark does not list names that start with an underscore, such as {lost[0]}; rename them.")


def file_digests(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    files = scan_tree(spark, root, extensions, with_content=True)
    return files.select("relative_path", "byte_length", F.sha2("content", 256).alias("sha256"))


def detect_delimiter(sample: str) -> str:
    """The delimiter that occurs most often; the first of the list among equals."""
    best = max(DELIMITERS, key=sample.count)
    if best not in sample:
        raise ValueError(f"None of {DELIMITERS} occurs at the start of the input.")
    return best


def _start_of(lines: DataFrame, size: int = SAMPLE_CHARACTERS) -> str:
    """The first ``size`` characters; few lines do unless they are very short."""
    head = lines.select(F.substring("value", 1, size).alias("value"))
    for count in (64, size):
        text = "\n".join(r["value"] for r in head.limit(count).collect())
        if len(text) >= size:
            break
    return text.lstrip(BYTE_ORDER_MARK)[:size]


def _csv_reader(spark: SparkSession, lines: DataFrame, delimiter: str) -> DataFrameReader:
    """A reader of text columns. Only a record that goes over several lines makes a line with an
    odd number of quotes; without such lines files are split among tasks, with them each file
    is one task, as its quotes have to be followed from the start."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    over_lines, broken = lines.select(F.max(quotes % 2 == 1), F.max(~F.is_valid_utf8("value"))).first()
    if broken:
        raise ValueError("The input has bytes that are not UTF-8.")
    return (
        spark.read.option("sep", delimiter).option("escape", '"').option("maxColumns", MAX_COLUMNS)
        .option("maxCharsPerColumn", -1).option("multiLine", bool(over_lines))
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the delimiter found in its first characters; every column is text.

    Names come from the whole first record, however wide. With several files, each has to begin with the
    same record; another one is an error when the rows are read. Cells are stripped, missing ones are
    empty, surplus ones are left out, and so are rows without any content.
    """
    lines = spark.read.text(path)
    reader = _csv_reader(spark, lines, detect_delimiter(_start_of(lines)))
    first = reader.csv(path).first()
    names = [(cell or "").lstrip(BYTE_ORDER_MARK).strip() for cell in first]
    unusable = [name for name, times in Counter(names).items() if times > 1 or not name]
    if unusable:
        raise ValueError(f"Column names that are empty or repeated: {unusable}.")
    schema = T.StructType([T.StructField(cell, T.StringType()) for cell in first])
    columns = [f"_{i}" for i in range(len(names))]
    # Without enforceSchema Spark compares the first record of each file with the schema's names.
    rows = reader.option("header", True).option("enforceSchema", False).schema(schema).csv(path).toDF(*columns)
    rows = rows.select(*[F.coalesce(F.trim(c, F.lit(WHITE_SPACE)), F.lit("")).alias(c) for c in columns])
    filled = F.exists(F.array(*rows.columns), lambda cell: cell != "")
    return rows.where(filled).toDF(*names)


def csv_shape(spark: SparkSession, path: str, delimiter: str, width: int) -> DataFrame:
    """Rows, blank rows and ragged rows (of another width) of CSV files without a header.

    Empty lines, which Spark's reader skips, are blank rows too, unless records go over several
    lines: there an empty line may be part of a record.
    """
    names = [f"_{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_ragged"]])
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    skipped = lines.agg(F.when(F.max(quotes % 2) == 1, 0).otherwise(F.count_if(F.trim("value", F.lit(WHITE_SPACE)) == ""))).scalar()
    reader = _csv_reader(spark, lines, delimiter)
    rows = reader.schema(schema).option("columnNameOfCorruptRecord", "_ragged").csv(path)
    filled = F.exists(F.array(*names), lambda cell: F.trim(cell, F.lit(WHITE_SPACE)) != "")
    surplus = F.replace(F.coalesce("_ragged", F.lit("")), F.lit(delimiter), F.lit(""))
    blank = ~F.coalesce(filled, F.lit(False)) & (F.trim(surplus, F.lit(WHITE_SPACE + '"')) == "")
    return rows.select(blank.alias("blank"), F.col("_ragged").isNotNull().alias("ragged")).agg(
        F.count_if(~F.col("blank")).alias("row_count"),
        (F.count_if("blank") + F.coalesce(skipped, F.lit(0))).alias("blank_count"),
        F.count_if(~F.col("blank") & F.col("ragged")).alias("ragged_count"),
    )
