"""Token totals by source, language and tokenizer version, kept by signed deltas.

A batch of changes inserts, revises or deletes the counts of documents. Against the counts that are
known so far every change becomes signed records: the old count with a minus, the new one with a
plus. The records of a batch and their sums by group are written to folders of the batch; totals
are the sum over all committed batches, so nothing is ever rewritten.

A batch is committed when the last of its folders is complete (Spark's ``_SUCCESS`` mark). Committing
it again changes nothing; a batch that broke off is written anew from the start.

A document is known by its id and the tokenizer version. A change without id cannot be found again
and is left out. Of several changes of one document in a batch a count wins over a delete, and of
counts the largest. Deleting an unknown document changes nothing, inserting a known one revises it.

Where ids are null or repeat, a batch names the column that tells the rows apart (``row_digest``),
and the key is the id, that column and the version. Null ids then count like others, and rows that
are equal in the whole key count as often as they occur: a batch with counts sets how many there
are, a delete takes away one. Such rows must have equal counts.

Null sources and languages are groups of their own. A document without count holds no tokens. An
empty batch is committed and adds nothing. Other columns may have any name.
"""

from __future__ import annotations

import base64
from functools import reduce
from operator import and_

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.tiktoken"
KEY = ["doc_id", "row", "version"]
GROUP = ["source", "lang", "version"]
RECORD = "doc_id long, row string, version string, source string, lang string, docs long, tokens long"

_encodings: dict[str, object] = {}


def _encoding(path: str):
    """The tokenizer of a rank file, once for each worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encodings[path]


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a whole text; null and empty texts have none."""
    path = path or public_tokenizers.path(TOKENIZER)

    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(path)
        return pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")(text)


class TokenRollup:
    """The totals kept under a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, kind: str, batch: str) -> str:
        return f"{self.root}/{kind}/batch={batch}"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Names of the committed batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/deltas/batch=*/_SUCCESS")
        return sorted(s.getPath().getParent().getName().removeprefix("batch=") for s in self._files().globStatus(path) or [])

    def _read(self, kind: str, schema: str) -> DataFrame:
        batches = self.committed()
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._path(kind, b) for b in batches])

    def known(self) -> DataFrame:
        """The counts in force, one row per document and version."""
        records = self._read("records", RECORD)
        sums = records.groupBy(*KEY, "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0")

    def commit(self, batch: str, changes: DataFrame, row_col: str | None = None) -> bool:
        """Apply ``changes`` (op, doc_id, source, lang, version, tokens) once; False if it already was.

        ``op`` is ``insert``, ``revise`` or ``delete``. ``row_col`` tells rows of one id apart.
        """
        if batch in self.committed():
            return False
        given = changes if row_col else changes.where("doc_id is not null")
        row = F.col(f"`{row_col}`") if row_col else F.lit(None)
        stays = F.col("op") != "delete"
        put = F.count_if(stays)
        wanted = (
            given.select("op", "doc_id", row.cast("string").alias("row"), "version", "source", "lang", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
            .groupBy(*KEY)
            .agg(
                F.max(F.struct(stays.alias("stays"), "tokens", "source", "lang")).alias("new"),
                (put if row_col else F.least(put, F.lit(1))).alias("put"),
                F.count_if(~stays).alias("cut"),
            )
        )
        old = self.known().select(*[F.col(k).alias(f"old_{k}") for k in KEY], F.struct("source", "lang", "docs", "tokens").alias("old"))
        met = wanted.join(old, reduce(and_, [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in KEY]), "left")
        left = F.col("old.docs") - F.col("cut")

        def record(of: str, docs: Column, tokens: Column) -> Column:
            return F.struct(F.col(f"{of}.source").alias("source"), F.col(f"{of}.lang").alias("lang"), docs.alias("docs"), tokens.alias("tokens"))

        plus = F.when(F.col("new.stays"), record("new", F.col("put"), F.col("put") * F.col("new.tokens"))).when(
            left > 0, record("old", left, left * F.expr("old.tokens div old.docs"))
        )
        minus = F.when(F.col("old").isNotNull(), record("old", -F.col("old.docs"), -F.col("old.tokens")))
        signed = met.select(*KEY, F.explode(F.array(plus, minus)).alias("r")).where("r is not null").select(*KEY, "r.*")
        signed.write.mode("overwrite").parquet(self._path("records", batch))
        written = self.spark.read.schema(RECORD).parquet(self._path("records", batch))
        deltas = written.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.mode("overwrite").parquet(self._path("deltas", batch))
        return True

    def totals(self) -> DataFrame:
        """``n_docs`` and ``n_tokens`` by source, language and version, and subtotals.

        ``level`` is 0 for a full group, 1 without version, 3 without language, 7 for all.
        """
        deltas = self._read("deltas", "source string, lang string, version string, docs long, tokens long")
        return (
            deltas.rollup(*GROUP)
            .agg(F.grouping_id().cast("int").alias("level"), F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
            .where("n_docs <> 0")
        )


def row_digest(text: Column, *others: Column) -> Column:
    """Tells rows of one id apart by their text as it is and ``others``; rows equal in all of them have one digest."""
    parts = [F.sha2(text.cast("binary"), 256), *others]
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])).cast("binary"), 256)


def insert_of(docs: DataFrame, version: str, tokens: Column, row: Column | None = None) -> DataFrame:
    """Changes that insert or revise the counts of ``docs`` (doc_id, source, lang), with ``row`` if given."""
    rows = [] if row is None else [row.alias("row")]
    return docs.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", F.lit(version).alias("version"), tokens.alias("tokens"), *rows)


def delete_of(docs: DataFrame, version: str, row: Column | None = None) -> DataFrame:
    """Changes that delete the counts of ``docs`` (doc_id), with ``row`` if given."""
    none = F.lit(None)
    rows = [] if row is None else [row.alias("row")]
    return docs.select(F.lit("delete").alias("op"), "doc_id", none.cast("string").alias("source"), none.cast("string").alias("lang"), F.lit(version).alias("version"), none.cast("long").alias("tokens"), *rows)
