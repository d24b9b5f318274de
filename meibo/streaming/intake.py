"""The folder job for files that keep arriving: every run handles the files that are new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meibo.functions.names import cols
from meibo.operators.staging import discarding
from meibo.sources.csv import read_csv, writer_options

# New files that one step of a run takes at most; a run takes as many steps as it needs.
FILES_PER_STEP = 1000


def process_new_files(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    columns: list[str],
    op: Callable[[DataFrame], DataFrame],
    progress_dir: str,
    encoding: str = "UTF-8",
    multi_line: bool = False,
    bad_rows: str | None = None,
    files_per_step: int = FILES_PER_STEP,
) -> None:
    """Apply ``op`` to the rows of files that earlier runs have not handled, and add them to ``out_dir``.

    The stream finds the new files; ``progress_dir`` remembers them. Every step reads its files as
    the batch job does, so ``op`` may be any operator, with tables of any size, and the files need
    ``columns`` in any order. A step writes a folder of its own, anew when it is repeated after a
    failure, so its rows count once. ``out_dir`` is read with :func:`meibo.sources.csv.read_csv`.
    """

    def step(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().collect()]
        if not paths:
            return
        with discarding(batch.sparkSession):
            rows = read_csv(batch.sparkSession, sorted(paths), encoding, multi_line, bad_rows=bad_rows)
            odd = set(rows.columns) ^ {*columns, *filter(None, [bad_rows])}
            if odd:
                raise ValueError(f"the files have other columns: {', '.join(sorted(odd))}")
            done = op(rows.select(*cols([*columns, *filter(None, [bad_rows])])))
            writer = done.write.mode("overwrite").options(**writer_options(encoding))
            writer.csv(f"{out_dir}/step={number}")

    # Of the files only the paths are asked for, so their content is not read here.
    found = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(found)
    files = files.option("maxFilesPerTrigger", files_per_step)
    stream = (
        files.load(in_dir)
        .select("path")
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", progress_dir)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
