"""Strict readers. Every schema is explicit, nothing is inferred, and a bad row raises instead of being dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.session import staged

#: The header of a transfer file; one name comes twice.
TRANSFER_HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
TRANSFER_NAMES = ["timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering"]
NEVER_BLANK = [0, 1, 2, 3, 4, 6, 8, 9]


def fail_if(bad: Column, value: Column, message: str) -> Column:
    """value; a row of which bad holds raises."""
    return F.when(~bad, value).otherwise(F.raise_error(F.lit(message)))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value): the lines of text files with their place in the file.

    A file is read in blocks like any text, so a large one is many tasks. A line's place is the number of lines in the blocks before its own, from one
    row a block, and its number inside the block.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    made = staged(raw, "lines")
    blocks = made.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    order = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    return made.join(before, ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("place"), F.regexp_replace("value", "\r$", "").alias("value"))


def csv_fields(line: Column, width: int) -> Column:
    """The fields of a line of CSV, quoted ones without their quotes; null if the quotes aren't closed or the number of fields is another."""
    names = [f"_{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_more"]])
    # A field too many is read into _more, with a mark behind the line that shows which field is the last.
    row = F.from_csv(F.concat(line, F.lit(",\u0001")), schema.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"', "nullValue": "\u0002", "emptyValue": "", "maxCharsPerColumn": "-1"})
    whole = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 0
    return F.transform(F.array(row), lambda r: F.when(whole & (r["_more"] == "\u0001"), F.array(*(F.coalesce(r[n], F.lit("")) for n in names))))[0]  # the line is read once


def amount(text: Column) -> Column:
    return F.regexp_replace(text, "[$,]", "").try_cast("double")


def transfer_columns(fields: Column, strip: bool = True) -> tuple[Column, list[Column]]:
    """(whether the fields are a valid transfer, its columns)."""
    get = lambda i: F.trim(F.get(fields, F.lit(i)))
    money = amount if strip else (lambda c: c.try_cast("double"))
    paid = [money(get(i)) for i in (5, 7)]
    good = F.coalesce(F.size(fields) == len(TRANSFER_NAMES), F.lit(False))
    for i in NEVER_BLANK:
        good = good & (get(i) != "")
    for x in paid:
        good = good & x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))
    good = F.coalesce(good & get(10).isin("0", "1"), F.lit(False))
    columns = [paid[0] if i == 5 else paid[1] if i == 7 else get(10).try_cast("int") if i == 10 else get(i) for i in range(11)]
    return good, [c.alias(n) for c, n in zip(columns, TRANSFER_NAMES, strict=True)]


def transfers(spark: SparkSession, path: str) -> DataFrame:
    """Bank transfers from CSV files with the exact header, with tx_id by the row's place in its file. Read by position, as a name comes twice."""
    rows = lines(spark, path)
    rows = rows.withColumn("_fields", csv_fields(F.col("value"), len(TRANSFER_NAMES)))
    fields = F.col("_fields")
    first = F.col("place") == 0
    checked = rows.withColumn("value", fail_if(first & (F.col("value") != TRANSFER_HEADER), F.col("value"), "the header isn't that of a transfer file")).where(~(F.col("place") == 0) | F.col("value").isNull())
    good, columns = transfer_columns(fields)
    valid = checked.withColumn("_fields", fail_if(~good, fields, "a transfer isn't valid"))
    return valid.select(F.concat(F.lit("tx_"), F.lpad((F.col("place") - 1).cast("string"), 8, "0")).alias("tx_id"), *columns, F.concat_ws("_", F.trim(fields[1]), F.trim(fields[2])).alias("sender"), F.concat_ws("_", F.trim(fields[3]), F.trim(fields[4])).alias("receiver"))


def typology(raw: Column) -> Column:
    """A typology's name in small letters, everything but letters and digits as one underscore."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(raw), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def patterns(spark: SparkSession, path: str, prefix: str = "AML_PATTERN") -> tuple[DataFrame, DataFrame]:
    """(blocks, malformed) from pattern files. A block runs from BEGIN to END LAUNDERING ATTEMPT of one family, or to the next BEGIN or the file's end, which are malformed; its transfers are an array, empty if it has none. Lines outside a block, an END without one or of another family, and invalid transfers are malformed too. Blocks are numbered in their file, so a file is one window; there may be many."""
    rows = lines(spark, path).withColumn("value", F.trim("value")).where("value <> ''")
    mark = lambda word: F.nullif(F.trim(F.regexp_extract("value", rf"(?i)^{word}\s+LAUNDERING\s+ATTEMPT\s*-\s*(.+)$", 1)), F.lit(""))
    order = Window.partitionBy("file").orderBy("place")
    marked = rows.withColumns({"begin": mark("BEGIN"), "end": mark("END")})
    edge = F.col("begin").isNotNull() | F.col("end").isNotNull()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_b", F.when(edge, F.col("begin").isNotNull())).withColumn("open", F.coalesce(F.last("_b", ignorenulls=True).over(before), F.lit(False)))
    marked = marked.withColumn("block", F.sum(F.when(F.col("begin").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("raw", F.first("begin", ignorenulls=True).over(Window.partitionBy("file", "block")))
    marked = marked.withColumn("_fields", csv_fields(F.col("value"), len(TRANSFER_NAMES)))
    good, columns = transfer_columns(F.col("_fields"), strip=False)
    last = F.max(F.when(edge, F.col("place"))).over(Window.partitionBy("file"))
    reason = (
        F.when(F.col("begin").isNotNull() & F.col("open"), "BEGIN inside a block")
        .when(F.col("end").isNotNull() & ~F.col("open"), "END without a block")
        .when(F.col("end").isNotNull() & (typology(F.col("end")) != typology(F.substring_index("raw", ":", 1))), "END of another family")
        .when(~edge & ~F.col("open"), "line outside a block")
        .when(~edge & ~good, "invalid transfer")
        .when(F.col("begin").isNotNull() & (F.col("place") == last), "block without END")
    )
    marked = marked.withColumn("reason", reason)
    inside = F.when(~edge & F.col("reason").isNull(), F.struct("place", *columns))
    blocks = marked.where("raw IS NOT NULL").groupBy("file", "block", "raw").agg(F.sort_array(F.collect_list(inside)).alias("transfers"))
    ids = F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("block").cast("string"), 5, "0"), F.lit("_"), typology(F.col("raw")))
    return blocks.select(ids.alias("pattern_id"), "file", "block", "raw", typology(F.col("raw")).alias("typology"), "transfers"), marked.where("reason IS NOT NULL").select("file", "place", "value", "reason")


def wallet_edges(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(src, dst, edge_key): an edge list, parallel rows kept; the first `most` rows of each file if given."""
    rows = lines(spark, path)
    ok = fail_if((F.col("place") == 0) & (F.col("value") != "input_address,output_address"), F.col("value"), "the header isn't that of an edge list")
    f = F.col("_fields")
    rows = rows.withColumn("_fields", csv_fields(F.col("value"), 2))
    kept = rows.withColumn("value", ok).where("place > 0 OR value IS NULL")
    kept = kept if most is None else kept.where(F.col("place") <= most)
    both = fail_if(f.isNull() | (F.trim(f[0]) == "") | (F.trim(f[1]) == ""), F.trim(f[0]), "an edge isn't valid")
    return kept.select(both.alias("src"), F.trim(f[1]).alias("dst"), F.concat(F.lit("source_row_"), (F.col("place") - 1).cast("string")).alias("edge_key"))


def unique(df: DataFrame, key: str, message: str) -> DataFrame:
    """df; a key that comes twice raises. Keys are counted with partial sums, so one that comes very often gathers nowhere; a null key counts like any other."""
    n = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").limit(1)
    twice = n.agg(F.count("*").alias("_twice"))
    return df.join(F.broadcast(twice)).withColumn(key, fail_if(F.col("_twice") > 0, F.col(key), message)).drop("_twice")


def wallet_classes(spark: SparkSession, path: str) -> DataFrame:
    """(address, class) with class 1, 2 or 3, an address once."""
    schema = T.StructType([T.StructField("address", T.StringType()), T.StructField("class", T.StringType())])
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")
    return unique(rows.withColumn("class", fail_if(~F.coalesce(F.col("class").isin("1", "2", "3"), F.lit(False)), F.col("class"), "a class isn't 1, 2 or 3")), "address", "an address comes twice")


def wallet_features(spark: SparkSession, path: str) -> DataFrame:
    """(address, f): an address and two or more finite numbers, an address once. The width is that of the header."""
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")
    if raw.columns[0] != "address" or len(raw.columns) < 3:
        raise ValueError("features need an address and two columns at least")
    x = F.array(*(F.col(f"`{c}`").try_cast("double") for c in raw.columns[1:]))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return unique(raw.select("address", fail_if(bad, x, "a feature isn't finite").alias("f")), "address", "an address comes twice")


def strict_json(text: Column, schema: str) -> Column:
    """text as a struct; twice the same key, NaN or an infinite number raises. try_parse_json refuses the former, a scan of the text outside strings finds the others."""
    bare = F.regexp_replace(text, r'"(\\.|[^"\\])*"', '""')
    bad = F.try_parse_json(text).isNull() | bare.rlike(r"NaN|Infinity") | F.exists(F.regexp_extract_all(bare, F.lit(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"), F.lit(0)), lambda x: F.abs(x.try_cast("double")) == float("inf"))
    return F.from_json(F.when(~F.coalesce(bad, F.lit(False)) | text.isNull(), text).otherwise(F.raise_error(F.lit("not strict JSON"))), schema)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines; blank ones are skipped."""
    return lines(spark, path).where(F.trim("value") != "").select(strict_json(F.col("value"), schema).alias("x")).select("x.*")


def side_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema, not strict: what doesn't fit is null."""
    return spark.read.schema(schema).json(path)


def written_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value): the lines that aren't blank, numbered in their file. Each block of a file counts its own; what comes before a block is a number for each block."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("value"))
    made = staged(raw.where(F.trim("value") != ""), "lines")
    inside = Window.partitionBy("file", "_block").orderBy("_id")  # the lines of one block
    counts = made.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("file", "_block", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    return made.withColumn("_at", F.row_number().over(inside)).join(before, ["file", "_block"]).select("file", (F.col("_before") + F.col("_at") - 1).alias("place"), "value")


def placed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines with their place in the file; blank lines have no place."""
    return written_lines(spark, path).select("place", strict_json(F.col("value"), schema).alias("x")).select("place", "x.*")


def json_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key, n): the names of the fields of JSON lines as they stand in the file, whatever a schema keeps of them."""
    return lines(spark, path).where(F.trim("value") != "").select(F.explode(F.json_object_keys("value")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def native_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with the exact header and types of a schema; a row that doesn't fit raises."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
