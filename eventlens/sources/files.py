"""Readers and writers (A1-A9) and folder-derived columns.

All readers are lazy DataFrame scans; a folder of files with differing
headers is one scan, never a per-file driver loop over data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.operators.schema import TSV_TEXT_COLUMNS, resolve_column
from eventlens.session import materialize

# The tokens pandas reads as missing by default (its STR_NA_VALUES).
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Column names of the headerless sentiment CSV.
HEADERLESS_POST_COLUMNS = ("sentiment", "tweet_id", "date", "query", "user", "text")
HEADERLESS_POST_TYPES = (T.IntegerType(), T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.StringType())


def na_to_null(col, tokens: Sequence[str] = PANDAS_NA_TOKENS) -> Column:
    """pandas' default missing-value tokens become null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def event_name_from_path(path_col) -> Column:
    """Name of a path's parent folder (basename of dirname), '' when there is none."""
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    return F.regexp_extract(c, "([^/]*)/+[^/]*$", 1)


def event_name_from_file(path_col="_metadata.file_path") -> Column:
    """A6 on a scanned file: the scan path is URL-encoded, so decode the folder name."""
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    return F.try_url_decode(F.replace(event_name_from_path(c), F.lit("+"), F.lit("%2B")))


def _holds_newlines(spark: SparkSession, path: str, encoding: str) -> bool:
    """Some line of the files leaves a quote open, so a field may hold a newline. One pass over split files."""
    lines = spark.read.schema("line string").option("sep", _NO_SEPARATOR).option("quote", "").option("encoding", encoding).csv(path)
    return not lines.where("line is not null").where(_open_quote(F.col("line"))).isEmpty()


def read_posts_csv(
    spark: SparkSession,
    path: str,
    header: bool = True,
    names: Sequence[str] | None = None,
    types: Sequence[T.DataType] | None = None,
    encoding: str = "UTF-8",
    schema: T.StructType | None = None,
    multi_line: bool | None = None,
    infer: bool = False,
) -> DataFrame:
    """A1/A2: CSV with header or headerless with names; strings, unless a schema is given or types are inferred.

    ``multi_line``: whether fields may hold newlines, in which case a file is read by one task; by default
    a pass over the lines finds out, so files without such fields are split. ``infer``: see ``typed``.
    """
    if multi_line is None:
        multi_line = _holds_newlines(spark, path, encoding)
    reader = (
        spark.read.option("header", header).option("multiLine", multi_line).option("escape", '"')
        .option("encoding", encoding).option("mode", "PERMISSIVE")
    )
    if schema is None and names is not None:
        types = types or [T.StringType()] * len(names)
        schema = T.StructType([T.StructField(n, t, True) for n, t in zip(names, types)])
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    read = df.select(*[na_to_null(f"`{c}`").alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    return typed(read) if infer else read


# The lattice of inferred types: a column is of the first one that reads all its values, else a string.
_INTEGER = r"^[+-]?\d{1,19}$"
_DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$|^[+-]?inf$"
_STAMP = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"
TRUE_WORDS, FALSE_WORDS = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def _as(kind: str, c: Column) -> Column:
    """A text value as one of the types; null if it is none."""
    if kind == "boolean":
        return F.when(c.isin(*TRUE_WORDS), True).when(c.isin(*FALSE_WORDS), False)
    if kind == "bigint":
        return F.when(c.rlike(_INTEGER), c.try_cast("bigint"))
    if kind == "double":
        return F.when(c.rlike(_DECIMAL), F.replace(c, F.lit("inf"), F.lit("Infinity")).try_cast("double"))
    if kind == "timestamp_ntz":
        return F.when(c.rlike(_STAMP), c.try_cast("timestamp_ntz"))
    return c


LATTICE = ("boolean", "bigint", "double", "timestamp_ntz", "string")


def inferred_types(df: DataFrame) -> dict[str, str]:
    """The type of every text column from all its values, by one mergeable aggregate: per column and type, whether any value is not of it.

    A column without a value is a string. Integers stay integers beside nulls (pandas makes them floats),
    and ISO dates are timestamps (pandas leaves them text until they are parsed).
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return {}
    unread = []
    for i, name in enumerate(texts):
        c = F.trim(F.col(f"`{name}`"))
        there = c.isNotNull()
        unread.append(F.max(there).alias(f"there{i}"))
        unread += [F.max(there & _as(kind, c).isNull()).alias(f"{kind}{i}") for kind in LATTICE[:-1]]
    row = df.agg(*unread).first()
    return {name: next((k for k in LATTICE[:-1] if row[f"there{i}"] and not row[f"{k}{i}"]), "string") for i, name in enumerate(texts)}


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its text columns as their inferred (or given) types."""
    types = inferred_types(df) if types is None else types
    out = []
    for name, have in df.dtypes:
        kind = types.get(name, "string") if have == "string" else have
        c = F.col(f"`{name}`")
        out.append((c if kind == have else _as(kind, F.trim(c))).alias(name))
    return df.select(*out)


def read_headerless_posts(spark: SparkSession, path: str) -> DataFrame:
    """A2: the headerless Latin-1 posts file with its six named columns."""
    return read_posts_csv(
        spark, path, header=False, names=HEADERLESS_POST_COLUMNS, types=HEADERLESS_POST_TYPES,
        encoding="ISO-8859-1",
    )


def with_row_numbers(scan: DataFrame, out: str = "row_no") -> DataFrame:
    """Rows of a file scan with their place in file order: by path, then by place in the file, from 0 without gaps.

    Rows are written once with the numbers that their split gives them; a table of one row per split says where
    each split begins. Nothing is sorted.
    """
    at = materialize(
        scan.select(
            "*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at")
        ),
        "numbered-rows",
    )
    splits = at.groupBy("__path", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__path", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("__path", "__block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return at.join(starts, ["__path", "__block"]).select(*scan.columns, (F.col("__at") + F.col("__shift")).alias(out))


# No Latin-1 text holds these: a separator that never splits, and a mark for separators outside quotes.
_NO_SEPARATOR, _CUT = "\ue000", "\uffff"


def _fields(record: Column, sep: str = "\t") -> Column:
    """The fields of a delimited record: separators count outside quoted sections, '""' in one is a quote."""
    outside = F.transform(F.split(record, '"'), lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(sep), F.lit(_CUT))).otherwise(part))
    pieces = F.split(F.array_join(outside, '"'), _CUT)
    plain = F.transform(pieces, lambda f: F.when(f.startswith('"'), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f))
    return F.when(F.contains(record, F.lit('"')), plain).otherwise(F.split(record, sep))


def _open_quote(line: Column) -> Column:
    """The line holds an odd number of quotes, so a record goes on in the next line (or came from the last)."""
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def _reader(spark: SparkSession, glob: str, encoding: str):
    return (
        spark.read.option("header", False).option("encoding", encoding).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True)
    )


def _lines(spark: SparkSession, root: str, glob: str, encoding: str) -> DataFrame:
    """(path, at, line) of every non-empty line; files are split. ``at`` orders the lines of a file."""
    lines = _reader(spark, glob, encoding).schema("line string").option("sep", _NO_SEPARATOR).option("quote", "").csv(root)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return lines.select(F.col("_metadata.file_path").alias("path"), at.alias("at"), "line").where("line is not null")


def _records(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """(path, at, line) of every record of files whose records may hold newlines; a file is read by one task."""
    schema = T.StructType([T.StructField("_f", T.StringType(), True), T.StructField("_raw", T.StringType(), True)])
    rows = (
        _reader(spark, "*", encoding).schema(schema).option("sep", "\t").option("multiLine", True).option("escape", '"')
        .option("columnNameOfCorruptRecord", "_raw").option("maxColumns", 1_000_000).csv(list(paths))
    )
    # no raw text: the record is one field
    alone = F.when(F.contains("_f", F.lit('"')) | F.contains("_f", F.lit("\t")), F.concat(F.lit('"'), F.replace("_f", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("_f"))
    at = F.struct(F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("n"))
    return rows.select(F.col("_metadata.file_path").alias("path"), at.alias("at"), F.coalesce("_raw", alone).alias("line"))


@dataclass
class FolderScan:
    """What a scan of event folders gives: the posts, and the files and lines it left out, counted by reason."""

    posts: DataFrame   # path, folder, row_no, raw_tweet
    ledger: DataFrame  # path, folder, reason, rows


# Reasons of the ledger.
NO_TEXT_COLUMN, EMPTY_FILE, TOO_MANY_FIELDS, MISSING_TEXT = "no text column", "empty file", "too many fields", "missing text"


def scan_event_folders(
    spark: SparkSession, root: str, text_candidates: Sequence[str] = TSV_TEXT_COLUMNS, glob: str = "*.tsv", encoding: str = "ISO-8859-1",
) -> FolderScan:
    """Every TSV under ``root``, files of any header, in one split scan, with a ledger of what was left out.

    A pass over the lines, split across tasks, finds the files with a line whose quotes do not close: these
    may hold newlines in their fields and are read whole by the CSV reader, the others by lines. Records are
    cut into fields by built-in functions and written once. Each file's first record is its header; the text
    column is picked per file by priority. pandas-like rules: more fields than the header -> left out (an empty
    extra field counts), fewer -> kept, null-padded; missing-value tokens are null.

    Posts hold null texts (``MISSING_TEXT`` counts them in the ledger), so that a folder's rows can be
    counted. A file that has no text column or no record at all is in the ledger with its rows.
    """
    lines = _lines(spark, root, glob, encoding)
    odd = lines.where(_open_quote(F.col("line"))).select("path").distinct()
    paths = [r["path"] for r in odd.toLocalIterator()]  # some of the file names that the driver has listed for the scan
    found = []
    if paths:
        found.append(_records(spark, paths, encoding))
        lines = lines.join(F.broadcast(spark.createDataFrame([(p,) for p in paths], "path string")), "path", "left_anti")
    if not paths or len(_listing(spark, root, glob)) > len(paths):
        found.append(lines)
    found = reduce(DataFrame.unionByName, [f.select("path", "at", _fields(F.col("line")).alias("fields")) for f in found])
    found = materialize(found, "tsv-records")
    # a row per file, broadcast: rows meet their file's header where they are, however many a file has
    first = found.where("at.block = 0").groupBy("path").agg(F.min("at.n").alias("_n"))
    heads = found.where("at.block = 0").join(F.broadcast(first), "path").where("at.n = _n").withColumnRenamed("at", "_head")
    names = F.transform("fields", lambda f: F.trim(f))
    place = F.coalesce(*[F.nullif(F.array_position(names, c), F.lit(0).cast("long")) for c in text_candidates], F.lit(0).cast("long"))
    per_file = materialize(heads.select("path", "_head", F.size("fields").alias("_width"), place.cast("int").alias("_place")), "tsv-headers")
    rows = found.join(F.broadcast(per_file), "path").where(F.col("at") > F.col("_head"))
    text = na_to_null(F.when((F.col("_place") > 0) & (F.col("_place") <= F.size("fields")), F.element_at("fields", F.col("_place"))))
    wide = F.size("fields") > F.col("_width")
    told = rows.select("path", F.col("at").alias("row_no"), wide.alias("_wide"), F.col("_place"), text.alias("raw_tweet"))
    folder = event_name_from_file(F.col("path")).alias("folder")
    posts = told.where("not _wide").select("path", folder, "row_no", "raw_tweet")
    reason = F.when(F.col("_place") == 0, NO_TEXT_COLUMN).when(F.col("_wide"), TOO_MANY_FIELDS).when(F.col("raw_tweet").isNull(), MISSING_TEXT)
    counted = told.select("path", reason.alias("reason")).where("reason is not null").groupBy("path", "reason").agg(F.count(F.lit(1)).alias("rows"))
    no_rows = F.lit(0).cast("long").alias("rows")
    # files without a data row have no counts
    textless = per_file.where("_place = 0").select("path", F.lit(NO_TEXT_COLUMN).alias("reason"), no_rows).join(counted.select("path"), "path", "left_anti")
    # a listing writes file:/x where a scan writes file:///x
    place_of = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/")
    empty = list_files(spark, root, glob).withColumn("_at", place_of("path")).join(per_file.select(place_of("path").alias("_at")), "_at", "left_anti")
    empty = empty.select("path", F.lit(EMPTY_FILE).alias("reason"), no_rows)
    ledger = counted.unionByName(textless).unionByName(empty).select("path", folder, "reason", "rows")
    return FolderScan(posts, ledger)


def read_event_folders(
    spark: SparkSession,
    root: str,
    text_candidates: Sequence[str] = TSV_TEXT_COLUMNS,
    glob: str = "*.tsv",
) -> DataFrame:
    """The posts of ``scan_event_folders`` as (path, folder, row_no, raw_tweet)."""
    return scan_event_folders(spark, root, text_candidates, glob).posts


def _listing(spark: SparkSession, root: str, glob: str) -> Sequence[str]:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).inputFiles()


def list_files(spark: SparkSession, root: str, glob: str = "*.tsv") -> DataFrame:
    """(path) of every matching file, from the scan's file listing, which the driver holds anyway: a scan itself leaves empty files out."""
    return spark.createDataFrame([(path,) for path in _listing(spark, root, glob)], "path string")


def list_event_folders(spark: SparkSession, root: str, glob: str = "*.tsv") -> DataFrame:
    """Every folder holding a matching file (files that are empty or without a text column included)."""
    return list_files(spark, root, glob).select(event_name_from_file(F.col("path")).alias("folder")).distinct()


def write_events(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a whole table (parquet by default; CSV with header and quoting)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)
