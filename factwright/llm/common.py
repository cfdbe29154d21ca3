"""Helpers that several operators share."""

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factwright.session import cut, shared_folder

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Java and Python spell the class of word characters alike.
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


def id_text(c: str = "doc_id") -> Column:
    """A document id as text; a null one counts as empty text."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row by its content. Rows of equal content share it, and every result here is a
    function of the content, so that they share the result too."""
    return F.xxhash64(*cols)


def carry(docs: DataFrame, **columns: Column) -> DataFrame:
    """Rows as one struct, ``row``, beside what an operator works out of them, so that no name can clash. ``select("row.*")`` gives
    them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose ``row_key`` is not in the column ``key``."""
    return carry(docs, key=row_key("doc_id", "text")).join(keys.select("key").distinct(), "key", "left_anti").select("row.*")


def in_arrow(df: DataFrame, schema: str, each: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | pa.Table]]) -> DataFrame:
    """``df`` through a function of record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in each(batch):
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of 64-bit nodes: (node, component), the component being its least
    node. Labels spread along edges and then jump to their own labels, so that a chain of n nodes takes about
    log(n) rounds; each round is written to the shared folder."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        step = cut(least.join(jump, "next", "left").select(
            "node", F.least("next", F.coalesce("beyond", "next")).alias("component"), F.col("component").alias("before")))
        labels = step.select("node", "component")
        if step.where("component <> before").isEmpty():
            return labels
