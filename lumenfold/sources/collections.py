"""Collections on storage: a folder with ``collection.json`` (or ``config.json``) and a JSON file for each item.

Schemas are given, never inferred; open-ended metadata stays JSON text.  Files are listed and read by Spark, so any file system
it knows will do, and a file that is no JSON becomes a row with ``_corrupt_record``.
"""

from __future__ import annotations

import fnmatch
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLLECTION = "domain string, source string, created string, num_items int, total_documents int, description string, items array<string>, split_distribution map<string,int>, _corrupt_record string"
ITEM = "item_metadata string, documents array<struct<content:string,doc_id:string,chunks:array<string>,summaries:array<string>,metadata:string>>, _corrupt_record string"
CLAIMS = "item_id string, summary_index int, claims array<string>, summary_text string, domain string, _corrupt_record string"
USAGE = "ts string, model string, input_tokens long, output_tokens long, total_tokens long, input_cost double, output_cost double, total_cost double"


class CollectionError(ValueError):
    """A folder that is no collection, or an item that it doesn't have."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def list_datasets(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders with a collection file, sorted."""
    return [n for n in names_in(spark, root) if exists(spark, f"{root}/{n}/collection.json")]


def read_json(spark: SparkSession, path: str | list[str], schema: str | T.StructType, *, required: bool = True) -> DataFrame:
    """JSON files, a document each; absent optional ones have no rows."""
    if isinstance(path, str) and not any(c in path for c in "*?{[") and not exists(spark, path):
        if required:
            raise CollectionError(f"{path} isn't there")
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def stem(path: Column | None = None) -> Column:
    return F.regexp_extract(path if path is not None else F.input_file_name(), r"([^/]+)\.json$", 1)


def collection(spark: SparkSession, path: str) -> DataFrame:
    """The collection's own row: of ``collection.json``, else of ``config.json``."""
    for name in ("collection.json", "config.json"):
        if exists(spark, f"{path}/{name}"):
            return read_json(spark, f"{path}/{name}", COLLECTION)
    raise CollectionError(f"{path} has neither collection.json nor config.json")


def items(spark: SparkSession, path: str, *, in_collection_order: bool = False) -> DataFrame:
    """``item_id, position, item_metadata, documents``: position in the collection's list, or else in the order of file names.

    Without :data:`in_collection_order` position is null and rows have no order: sort by ``item_id``.
    """
    found = read_json(spark, f"{path}/items/*.json", ITEM).withColumn("item_id", F.url_decode(stem()))
    if not in_collection_order:
        return found.select("item_id", F.lit(None).cast("int").alias("position"), "item_metadata", "documents", "_corrupt_record")
    listed = collection(spark, path).select(F.posexplode("items").alias("position", "item_id"))
    return listed.join(found, "item_id", "left").select("item_id", "position", "item_metadata", "documents", "_corrupt_record")


def load_item(spark: SparkSession, path: str, item_id: str) -> DataFrame:
    """One item: only its own file is read."""
    at = f"{path}/items/{item_id}.json"
    if not exists(spark, at):
        raise CollectionError(f"no item {item_id!r}")
    return read_json(spark, at, ITEM).withColumn("item_id", F.lit(item_id))


def documents(item_rows: DataFrame) -> DataFrame:
    """A row for each document: ``item_id, doc_index, doc_id, content, chunks, summaries, metadata``."""
    return item_rows.select("item_id", F.posexplode("documents").alias("doc_index", "d")).select("item_id", "doc_index", "d.doc_id", "d.content", "d.chunks", "d.summaries", "d.metadata")


def flat_chunks(docs: str = "documents") -> Column:
    return F.flatten(F.filter(F.transform(docs, lambda d: d["chunks"]), lambda c: c.isNotNull()))


def flat_summaries(docs: str = "documents") -> Column:
    return F.flatten(F.filter(F.transform(docs, lambda d: d["summaries"]), lambda c: c.isNotNull()))


def segments(docs: str = "documents") -> Column:
    """The first document's chunks, or else its summaries."""
    first = F.get(docs, F.lit(0))
    return F.coalesce(first["chunks"], first["summaries"])


def chunks_of(index: int, docs: str = "documents") -> Column:
    """The chunks of one document (from 0); a number beyond the item's documents is an error."""
    d = F.get(docs, F.lit(index))
    return F.when(d.isNull(), F.raise_error(F.lit(f"no document {index}")).cast("array<string>")).otherwise(d["chunks"])


def without_keys(values: str | Column, *keys: str) -> Column:
    """A map without some keys."""
    return F.map_filter(values, lambda k, _: ~k.isin(*keys))


def complete(item_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items whose first document has content and summaries, and the others with what they lack."""
    first = F.get("documents", F.lit(0))
    lacks = F.when(F.coalesce(F.size("documents"), F.lit(0)) < 1, "documents").when(F.coalesce(F.size(first["summaries"]), F.lit(0)) < 1, "summaries").when(F.coalesce(first["content"], F.lit("")) == "", "content")
    marked = item_rows.withColumn("lacks", lacks)
    return marked.where("lacks is null").drop("lacks"), marked.where("lacks is not null")


def input_type(item_rows: DataFrame) -> str:
    """``chunks`` or ``summaries``, as the first item that has either says."""
    first = F.get("documents", F.lit(0))
    row = item_rows.where(first["chunks"].isNotNull() | first["summaries"].isNotNull()).select(first["chunks"].isNotNull().alias("c")).head()
    if row is None:
        raise CollectionError("no item has chunks or summaries")
    return "chunks" if row.c else "summaries"


def get(json_text: str | Column, path: str, default: str | None = None) -> Column:
    """A value deep in JSON text, or a default."""
    found = F.get_json_object(json_text, "$." + path)
    return found if default is None else F.coalesce(found, F.lit(default))


#: Where each collection keeps the reveal, for the chunker and for evaluators.
REVEAL = {
    "chunker": {"bmds": "detection.reveal_segment", "true-detective": "original_metadata.puzzle_data.outcome", "detectiveqa": "detection.reveal_segment"},
    "evaluator": {"bmds": "detection.reveal_segment", "true-detective": "original_metadata.reveal_text", "detectiveqa": "detection.reveal_segment"},
}


def reveal(dataset: str, metadata: str | Column = "metadata", *, consumer: str = "evaluator") -> Column:
    """The reveal text; null where it is absent or empty.  Unknown collections are errors."""
    if dataset not in REVEAL[consumer]:
        raise CollectionError(f"no reveal is known for {dataset!r}")
    return F.nullif(get(metadata, REVEAL[consumer][dataset]), F.lit(""))


def source_text(content: str | Column, reveal_text: Column, *, add_reveal: bool = False, reveal_only: bool = False) -> Column:
    """The content, with the reveal after an empty line, or the reveal alone."""
    if add_reveal and reveal_only:
        raise ValueError("add_reveal and reveal_only exclude each other")
    own = F.col(content) if isinstance(content, str) else content
    return reveal_text if reveal_only else F.concat(own, F.lit("\n\n"), reveal_text) if add_reveal else own


def claim_files(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, summary_index, claims`` of ``items/ITEM/N.json``; N is a number and sorts as one."""
    found = spark.read.schema(CLAIMS).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{path}/items/*/*.json")
    name = F.input_file_name()
    return found.select(F.url_decode(F.regexp_extract(name, r"([^/]+)/[^/]+\.json$", 1)).alias("item_id"), stem(name).try_cast("int").alias("summary_index"), "claims", "_corrupt_record").where("summary_index is not null")


def evaluation_files(spark: SparkSession, path: str, schema: str, *, by_range: bool = False, last_only: bool = False) -> DataFrame:
    """Rows of ``items/*.json`` or, by range, ``items/ITEM/N.json`` (only the highest N of each item if asked for)."""
    found = spark.read.schema(schema).option("multiLine", True).json(f"{path}/items/*/*.json" if by_range else f"{path}/items/*.json")
    name = F.input_file_name()
    if not by_range:
        return found.withColumn("item_id", F.url_decode(stem(name)))
    out = found.withColumn("item_id", F.url_decode(F.regexp_extract(name, r"([^/]+)/[^/]+\.json$", 1))).withColumn("range_num", stem(name).try_cast("int"))
    if last_only:
        from ..operators.analysis import last_of

        out = last_of(out, ["item_id"], [F.col("range_num").desc()])
    return out


def without_backups(df: DataFrame, path_col: str) -> DataFrame:
    return df.where(~F.contains(F.col(path_col), F.lit(".bak")))


def spending(spark: SparkSession, path: str) -> DataFrame:
    """The spending log: eight columns without a header; blank, short and malformed lines are dropped."""
    return spark.read.schema(USAGE).option("mode", "DROPMALFORMED").csv(path).where("total_cost is not null")  # pruned columns aren't checked


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header; cells stay text and ``N/A`` isn't null."""
    return spark.read.option("header", True).option("nullValue", "").option("inferSchema", False).csv(path)


def prompts(spark: SparkSession, path: str) -> dict[str, str]:
    """Prompt texts by file stem (a handful of small files)."""
    rows = spark.read.text(f"{path}/*.txt", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("k"), "value").collect()
    return {x.k: x.value for x in rows}


def novels(spark: SparkSession, path: str) -> DataFrame:
    """``novel_id, title, text`` of files named ``ID-TITLE.txt``."""
    name = F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1))
    return spark.read.text(f"{path}/*-*.txt", wholetext=True).select(F.substring_index(name, "-", 1).try_cast("int").alias("novel_id"), F.regexp_replace(name, r"^[^-]*-", "").alias("title"), F.col("value").alias("text"))


def annotations(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Annotation files (an object or an array each) of several folders, one after the other."""
    out = None
    for p in paths:
        df = spark.read.schema(schema).option("multiLine", True).json(f"{p}/*.json")
        out = df if out is None else out.unionByName(df)
    return out


def splits(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Snapshots of a dataset's splits (Parquet or JSON lines) with a ``split`` column."""
    out = None
    for name, p in paths.items():
        df = (spark.read.schema(schema).json(p) if p.endswith((".json", ".jsonl")) else spark.read.schema(schema).parquet(p)).withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def dictionary(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """``title, text`` of a dictionary that the caller has loaded from a source that it trusts."""
    return spark.createDataFrame(list(texts.items()), "title string, text string")


def matching(names: list[str], pattern: str) -> list[str]:
    """Names by a shell pattern: runs to evaluate together."""
    return [n for n in names if fnmatch.fnmatch(n, pattern)]


def params_of(text: str) -> dict:
    return json.loads(text)
