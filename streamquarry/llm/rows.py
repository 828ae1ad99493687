"""What the training-data operators share: stored steps, addresses of rows, the law of words."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamquarry.plans.workspace import materialize, shared_dir

FILE, ROW = "_sq_file", "_sq_row"

# The white space of all contracts: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder of the session."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    return materialize(df, label)


def _place(docs: DataFrame) -> Column:
    """What Spark knows of a row's file, also where the table has a column of that name."""
    return docs.metadataColumn("_metadata")


def landed(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows come straight from files, else written to the shared folder and read."""
    try:
        docs.select(_place(docs)["row_index"])
        return docs
    except AnalysisException:
        return stored(docs, "landed")


def addressed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` of ``docs`` with the address of each row: hash of its file, place in the file.

    The address tells repeated rows and rows without an id apart and stays the same when a
    task is run again.  To use addresses of one table twice, land it first.
    """
    docs = landed(docs)
    return docs.select(
        *columns, F.xxhash64(_place(docs)["file_path"]).alias(FILE), _place(docs)["row_index"].alias(ROW))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas of ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def text_of(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))
