"""A recruiter index that is kept between runs and grows by deltas.

Every batch of job data becomes a delta: its different (key, value) pairs, signed and counted. The index in
force is the sum of all deltas, so batches may come in any order, and one may be taken back. Compaction
sums them into a new base, bucketed by key, from which later fills read without shuffling the index.

The folder holds ``deltas/<batch>`` and ``base/<number>``. A delta or a base counts when Spark's
``_SUCCESS`` mark is there, so a job that broke off is repeated under the same name, and adding a batch again
changes nothing. A base names the batches it is made of; older files are never changed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.operators.fill import distinct_values, index_pairs
from meibo.operators.staging import children, exists

PAIR = "key string, value string, n long"
ENTRY = "key string, n_values long, value string"
#: Marks the delta that takes a batch back.
TAKEN_BACK = ".taken-back"


class KeptIndex:
    """The index below ``root``. ``tiers`` and ``value`` are as in :func:`~meibo.operators.fill.build_index`."""

    def __init__(
        self, spark: SparkSession, root: str, tiers: list[dict[str, Callable[[Column], Column]]], value: str, buckets: int = 64
    ) -> None:
        self.spark, self.root, self.tiers, self.value, self.buckets = spark, root.rstrip("/"), tiers, value, buckets

    def _done(self, kind: str) -> list[str]:
        """The names of the finished deltas or bases."""
        return [x for x in children(self.spark, f"{self.root}/{kind}/*") if exists(self.spark, f"{self.root}/{kind}/{x}/_SUCCESS")]

    def batches(self) -> list[str]:
        """The batches in force."""
        done = set(self._done("deltas"))
        return sorted(b for b in done if not b.endswith(TAKEN_BACK) and b + TAKEN_BACK not in done)

    def add(self, batch: str, jobs: DataFrame) -> bool:
        """Add the job data of a batch once; False if it was added before."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"not a name of a batch: {batch!r}")
        pairs = index_pairs(jobs, self.tiers, self.value).groupBy("key", "value").agg(F.count("*").alias("n"))
        return self._write(batch, pairs)

    def take_back(self, batch: str) -> bool:
        """Undo a batch, compacted or not; False if it is not in force."""
        if batch not in self.batches():
            return False
        return self._write(batch + TAKEN_BACK, self._pairs([batch]).withColumn("n", -F.col("n")))

    def _write(self, batch: str, pairs: DataFrame) -> bool:
        if batch in self._done("deltas"):
            return False
        pairs.write.mode("overwrite").parquet(f"{self.root}/deltas/{batch}")
        return True

    def _pairs(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], PAIR)
        return self.spark.read.schema(PAIR).parquet(*[f"{self.root}/deltas/{b}" for b in batches])

    def _base(self) -> tuple[int, list[str]]:
        """The number of the newest base and the deltas that it is made of; 0 when there is none."""
        numbers = [int(x) for x in children(self.spark, f"{self.root}/base/*") if exists(self.spark, f"{self.root}/base/{x}/deltas/_SUCCESS")]
        if not numbers:
            return 0, []
        rows = self.spark.read.schema("delta string").parquet(f"{self.root}/base/{max(numbers)}/deltas")
        return max(numbers), sorted(r["delta"] for r in rows.collect())

    def _table(self, number: int, part: str, schema: str) -> DataFrame:
        """A bucketed table of a base; the session learns of it when it is first read."""
        name = f"meibo_index_{abs(hash((self.root, number))):x}_{part}"
        path = f"{self.root}/base/{number}/{part}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"create table {name} ({schema}) using parquet clustered by (key) sorted by (key) into {self.buckets} buckets location '{path}'"
            )
        return self.spark.table(name)

    def _summed(self) -> tuple[DataFrame, bool]:
        """The pairs in force, and whether all lie in the base."""
        number, merged = self._base()
        late = [b for b in self._done("deltas") if b not in merged]
        late_pairs = self._pairs(late)
        if not number:
            both = late_pairs
        else:
            both = self._table(number, "pairs", PAIR)
            if not late:
                return both, True
            both = both.unionByName(late_pairs)
        return both.groupBy("key", "value").agg(F.sum("n").alias("n")).where("n > 0"), False

    def compact(self) -> None:
        """Sum base and deltas into a new base. Nothing happens when there is no new delta."""
        number, merged = self._base()
        done = self._done("deltas")
        if number and done == merged:
            return
        pairs, _ = self._summed()
        new = number + 1
        self._write_bucketed(pairs, new, "pairs", PAIR)
        self._write_bucketed(distinct_values(self._table(new, "pairs", PAIR)), new, "index", ENTRY)
        deltas = self.spark.createDataFrame([(b,) for b in done], "delta string")
        deltas.write.mode("overwrite").parquet(f"{self.root}/base/{new}/deltas")

    def _write_bucketed(self, rows: DataFrame, number: int, part: str, schema: str) -> None:
        # A base that broke off may have left files, which the new ones replace.
        self._table(number, part, schema)
        name = f"meibo_index_{abs(hash((self.root, number))):x}_{part}"
        # One file for each bucket.
        dealt = rows.repartition(self.buckets, "key")
        dealt.createOrReplaceTempView(f"{name}_rows")
        self.spark.sql(f"insert overwrite table {name} select {', '.join(c.split()[0] for c in schema.split(', '))} from {name}_rows")
        self.spark.catalog.refreshTable(name)

    def table(self) -> DataFrame:
        """The index in force, as :func:`~meibo.operators.fill.build_index` gives it."""
        pairs, whole = self._summed()
        if whole:
            return self._table(self._base()[0], "index", ENTRY)
        return distinct_values(pairs)
