"""Running a Python function over batches of a DataFrame's rows inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.session import landed, ship_package

#: Rows, and about how many bytes of text, a function sees at once.
ROWS, BYTES = 2_000, 2 << 20
#: Bytes of an Arrow batch on its way to Python, of which a task holds some on both sides, unless the session has its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_KEPT: list[dict] = []
_STAGE: list[int] = []


def of_a_stage() -> dict:
    """A dictionary that a Python process keeps from task to task, and that is empty again in another stage."""
    _KEPT.append({})
    return _KEPT[-1]


def enter_stage() -> None:
    """Let go of what another stage's tasks have left in this process; it serves all stages one after the other."""
    now = [TaskContext.get().stageId()]
    if now != _STAGE:
        _STAGE[:] = now
        for held in _KEPT:
            held.clear()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` in a session that says nothing of their size."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def by_batches(
    df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str
) -> DataFrame:
    """``function`` over the columns of small batches; result columns as in ``schema``.

    Batches are cut by rows and by bytes, so one task holds a few texts at a time.
    """
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_stage()
        for batch in batches:
            step = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
            for begin in range(0, batch.num_rows, step):
                columns = batch.slice(begin, step).to_pydict()
                result = function(columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(result[f.name], f.type) for f in kind], schema=kind
                )

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))


def text_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only what the operators read: the key, and the text with a missing one as empty."""
    return docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )


def one_row_per_id(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each id: the one with the smallest text, then the smallest row as JSON.

    Only rows of ids that repeat are aggregated, and they are landed; rows without an id are all kept.
    """
    ident = F.col(f"`{id_column}`")
    again = docs.filter(ident.isNotNull()).groupBy(ident.alias("_again")).count().filter("count > 1")
    again = landed(again.select("_again"), "repeated-ids")
    if again.isEmpty():
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, text = (names[docs.columns.index(c)] for c in (id_column, text_column))
    row = F.struct(*names)
    met = plain.join(again, plain[key] == again["_again"], "left_semi")
    single = met.groupBy(key).agg(F.min_by(row, F.struct(F.coalesce(F.col(text), F.lit("")), F.to_json(row))).alias("row"))
    others = plain.join(again, plain[key] == again["_again"], "left_anti")
    return others.unionByName(landed(single.select("row.*"), "single-rows")).toDF(*docs.columns)


def each_text(
    docs: DataFrame,
    function: Callable[[list[str]], tuple[list[str | None] | None, list[bool] | None]],
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with all its columns after ``function`` over the texts of small batches.

    The function gets texts with a missing one as empty, and returns new texts (None: as they were) and
    which rows stay (None: all).  Columns may have any names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = names[docs.columns.index(text_column)]

    def run(rows: dict[str, list]) -> dict[str, list]:
        texts, stays = function([t or "" for t in rows[place]])
        if texts is not None:
            rows = {**rows, place: [n if t is not None else None for n, t in zip(texts, rows[place], strict=True)]}
        if stays is not None:
            rows = {k: [x for x, s in zip(v, stays, strict=True) if s] for k, v in rows.items()}
        return rows

    plain = docs.toDF(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return by_batches(plain, run, schema).toDF(*docs.columns)
