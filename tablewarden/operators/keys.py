"""Key checks: primary keys, references, and key sets to look references up in."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract.model import Contract
from ..functions.keys import key_hash
from ..functions.typed import as_text, nested_kind
from ..plans.planner import name_of


@dataclass(frozen=True)
class KeySet:
    """Distinct complete keys of a dataset, as text columns ``k0, k1, ...``."""

    columns: tuple[str, ...]
    keys: DataFrame

    def hashes(self) -> DataFrame:
        """One stable 64-bit hash per key (as unsigned decimal text), ascending."""
        h = self.keys.select(key_hash([F.col(c) for c in self.keys.columns]).alias("key_hash"))
        return h.distinct().orderBy(F.col("key_hash").cast("decimal(20,0)"))


def key_texts(frame: DataFrame, columns: list[str] | tuple[str, ...]) -> list[Column]:
    types = {f.name: f.dataType for f in frame.schema.fields}
    for c in columns:
        if c not in types:
            raise ValueError(f"the key column `{c}` is absent")
        if kind := nested_kind(types[c]):
            raise ValueError(f"the key column `{c}` holds {kind} values")
    return [as_text(name_of(c), types[c]).alias(f"k{i}") for i, c in enumerate(columns)]


def collect_key_set(frame: DataFrame, columns: list[str] | tuple[str, ...]) -> KeySet:
    """The distinct keys of which no part is null."""
    return KeySet(tuple(columns), frame.select(*key_texts(frame, columns)).dropna().distinct())


def references_of(contract: Contract, datasets: dict[str, DataFrame]) -> dict[str, KeySet]:
    """Key sets for a contract's reference checks, from the datasets they name."""
    wanted: dict[str, list[str]] = {}
    for check in contract.dataset_checks:
        if check.kind == "references":
            if wanted.setdefault(check["dataset"], check["to"]) != check["to"]:
                raise ValueError(f"references to `{check['dataset']}` ask for different keys")
    return {name: collect_key_set(datasets[name], to) for name, to in wanted.items() if name in datasets}


def _complete(n: int) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"k{i}").isNotNull() for i in range(n)])


def primary_key_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``rows, null_key_rows, distinct_keys, duplicate_rows``: rows of one key are counted before they
    are dealt out, so a hot key is one row per task."""
    complete = _complete(len(columns))
    keyed = frame.select(*key_texts(frame, columns)).withColumn("whole", complete)
    names = [f"k{i}" for i in range(len(columns))]
    blank = keyed.select("whole", *(F.when(F.col("whole"), F.col(c)).alias(c) for c in names))
    each = blank.groupBy("whole", *names).agg(F.count(F.lit(1)).alias("n"))
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return each.agg(
        some(F.sum("n")).alias("rows"),
        some(F.sum(F.when(~F.col("whole"), F.col("n")))).alias("null_key_rows"),
        F.count(F.when(F.col("whole"), 1)).alias("distinct_keys"),
        some(F.sum(F.when(F.col("whole"), F.col("n") - 1))).alias("duplicate_rows"),
    )


def reference_counts(frame: DataFrame, columns: list[str], keys: KeySet) -> DataFrame:
    """``rows_evaluated, rows_failed, rows_skipped_null, referenced_keys``. The referring rows are counted
    by key first, so the join sees every distinct key once, however hot."""
    names = [f"k{i}" for i in range(len(columns))]
    keyed = frame.select(*key_texts(frame, columns))
    each = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).withColumn("whole", _complete(len(columns)))
    there = keys.keys.withColumn("there", F.lit(True))
    met = each.join(there, names, "left")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    counts = met.agg(some(F.col("whole")).alias("rows_evaluated"), some(F.col("whole") & F.col("there").isNull()).alias("rows_failed"), some(~F.col("whole")).alias("rows_skipped_null"))
    total = keys.keys.agg(F.count(F.lit(1)).alias("referenced_keys"))
    return counts.join(F.broadcast(total))  # one row each


def orphans(frame: DataFrame, columns: list[str], keys: KeySet) -> DataFrame:
    """The rows whose complete key is not in the key set."""
    names = [f"k{i}" for i in range(len(columns))]
    marked = frame.select("*", *key_texts(frame, columns))
    return marked.where(_complete(len(columns))).join(keys.keys, names, "left_anti")
