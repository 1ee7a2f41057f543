"""The validation of a table pair from settings: chunks, drill-down, aggregates, partitions, types, reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.config import Settings, TableProfile, Validation
from tallyframe.operators import aggregates as A
from tallyframe.operators import chunks as K
from tallyframe.operators import diff, lob
from tallyframe.operators import partitions as P
from tallyframe.operators import recommend as R
from tallyframe.operators.pair import TablePair
from tallyframe.plans import report
from tallyframe.sources.catalog import KeyRegistry


@dataclass
class Outcome:
    """What a run found. Its frames are kept once they are computed, so reports, verdict and files read the tables once; ``release`` lets them go."""

    schema: str
    table: str
    pair: TablePair
    chunks: DataFrame
    differences: DataFrame
    aggregates: DataFrame
    columns: DataFrame
    keys: DataFrame | None = None
    partitions: DataFrame | None = None
    lobs: DataFrame | None = None
    alters: DataFrame | None = None
    candidates: DataFrame | None = None
    changeable: DataFrame | None = None
    files: list[str] = field(default_factory=list)
    _reports: tuple[dict, dict] | None = None

    def keep(self) -> Outcome:
        """Those that more than one report reads."""
        for d in (self.chunks, self.differences, self.aggregates, self.partitions):
            if d is not None:
                d.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def release(self) -> None:
        for d in (self.chunks, self.differences, self.aggregates, self.partitions, self.keys):
            if d is not None:
                d.unpersist()

    def reports(self) -> tuple[dict, dict]:
        if self._reports is None:
            run = report.run_summary(self.chunks, self.differences, self.partitions, columns=self.columns, keys=self.keys, lobs=self.lobs)
            self._reports = run, report.aggregate_summary(self.aggregates)
        return self._reports

    @property
    def identical(self) -> bool:
        return report.final_verdict(*self.reports())

    def save(self, folder: str, at: datetime | None = None, frames: str | None = None) -> list[str]:
        """The run's and the aggregates' JSON, the text summary and, if types were looked at, the statements. The JSON holds the first rows of each
        list and how many there are; frames is a folder that executors reach, to which all rows go as JSON lines."""
        at = at or datetime.now()
        run, aggregates = self.reports()
        name = lambda kind, ending: report.file_name(self.schema, self.table, kind, ending, at)
        files = [(name("", "json"), run), (name("aggregate", "json"), aggregates), (name("summary", "txt"), report.readable(self.schema, self.table, run, aggregates, at))]
        if self.alters is not None and self.candidates is not None:
            lists = [[r.asDict() for r in d.orderBy("column_name").collect()] if d is not None else [] for d in (self.alters, self.candidates, self.changeable)]  # a row for each column
            files += [(name("ddl", "sql"), report.ddl_script(self.schema, self.table, *lists, at=at)), (name("ddl", "json"), dict(zip(("alters", "candidates", "changeable"), lists, strict=True)))]
        self.files = [report.save(folder, *f) for f in files]
        if frames:
            for kind in ("chunks", "differences", "aggregates", "partitions"):
                if (d := getattr(self, kind)) is not None:
                    d.write.mode("overwrite").json(f"{frames}/{name(kind, 'jsonl')}")
        return self.files


class Engine:
    def __init__(self, settings: Settings | None = None, keys: KeyRegistry | None = None):
        self.settings = settings or Settings()
        self.keys = keys or KeyRegistry()

    def pair(self, schema: str, table: str, source: DataFrame, target: DataFrame, pk: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None, where: str | None = None) -> TablePair:
        """Both sides with the table's key (that of the caller, the profile or the registry, in this order) and columns, under a condition."""
        profile = self.settings.profile(schema, table)
        key = self.keys.pk(table, pk, profile.pk_columns)
        wanted = columns or (None if profile.all_columns else profile.columns)
        here = {c.lower() for c in source.columns}
        missing = [k for k in (*key, *(wanted or ())) if k.lower() not in here]
        if missing:
            raise ValueError(f"{schema}.{table} has no column {', '.join(missing)}")
        lacking = [k for k in key if k.lower() not in {c.lower() for c in target.columns}]
        if lacking:
            raise ValueError(f"the target of {schema}.{table} has no key column {', '.join(lacking)}")
        return TablePair(source, target, key, wanted).where(where)

    def validate(self, schema: str, table: str, source: DataFrame, target: DataFrame, pk: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None, where: str | None = None, partitions: DataFrame | None = None, types: bool = False, force_keyset: bool | None = None, lobs: tuple[str, ...] = ()) -> Outcome:
        """Chunk digests of all columns that both sides have, differences within failed chunks, aggregates, and the columns that one side lacks.

        partitions (partition_name, range_start, range_end) with a profile of mode partition_aware: chunks by partition; light ones get no drill-down, rows in no
        partition do. lobs are large objects: chunks digest their lengths and prefixes, and they are compared by samples of their ends.
        """
        v, profile = self.settings.validation, self.settings.profile(schema, table)
        pair = self.pair(schema, table, source, target, pk, columns, where)
        missing = pair.schema_diff()
        size = v.size_for(f"{schema}.{table}")
        how = K.strategy(pair.source, pair.keys, v.force_keyset if force_keyset is None else force_keyset)
        values = pair.values
        plain = [c for c in values if c.lower() not in {x.lower() for x in lobs}]
        ranges, by = None, ()
        if partitions is not None and profile.partition_key:
            ranges = P.with_strategy(partitions, profile.immutable_before or v.immutable_before).persist()
            pair = TablePair(*(P.assigned(d, profile.partition_key, ranges) for d in (pair.source, pair.target)), pair.keys, tuple(values))
            by = ("partition_name",)
        compared_pair = TablePair(pair.source, pair.target, pair.keys, tuple(values))
        keys = None
        if not pair.keys:
            differences = diff.multiset_diff(compared_pair).withColumn("chunk_id", F.lit(0).cast("long"))
            from tallyframe.sources.migrate import whole_table_digests

            chunks = whole_table_digests(compared_pair).withColumn("chunk_id", F.lit(0).cast("long"))
        else:
            keys = K.key_problems(compared_pair).persist() if v.check_keys else None
            unique = keys is not None and not keys.where("repeated_keys > 0").count()  # two rows
            chunked = K.with_chunks(compared_pair, size, how)
            groups = [*by, "chunk_id"]
            digests = (K.digests(d, values, groups, v.null_empty_policy, tuple(x.lower() for x in lobs), v.strict_rows, v.lob_prefix) for d in (chunked.source, chunked.target))
            chunks = K.compare_digests(*digests, groups).persist()
            failed = chunks.where("not match")
            if ranges is not None:
                light = ranges.where(F.col("strategy") == P.LIGHT).select(F.lower("partition_name").alias("__light"))
                failed = failed.join(light, F.lower("partition_name") == F.col("__light"), "left_anti")
            differences = diff.drill_down(chunked, failed, v.decimal_tolerance, v.sample_size, v.max_diffs_per_chunk, v.tolerance_by_column, v.null_empty_policy, by, unique)
        summary = None
        if ranges is not None:
            if "partition_name" not in chunks.columns:
                raise ValueError(f"{schema}.{table} has no key, so it can't be validated by partition")
            summary = P.summary(chunks.join(F.broadcast(ranges.select("partition_name", "strategy")) if ranges.count() <= P.BROADCAST else ranges.select("partition_name", "strategy"), "partition_name", "left"), P.drilled())
        compared = A.compare_aggregates(compared_pair, [*pair.keys, *plain], by, v.float_scale, v.tolerance_by_column)
        out = Outcome(schema, table, pair, chunks, differences, compared, missing, keys, summary)
        if lobs:
            parts = [lob.compare_lob(compared_pair, c, by, v.lob_sample_size).withColumn("column_name", F.lit(c)) for c in values if c not in plain]
            out.lobs = reduce(DataFrame.unionByName, parts) if parts else None
        if types:
            held = R.Keys(pair.keys, self.keys.fk(table), self.keys.indexed(table))
            numbers = [c for c in (*pair.keys, *plain) if A.numeric(pair.source.schema[c].dataType)]
            out.alters = R.alter_ddl(compared_pair, schema, table, None, held) if not by else None
            out.candidates = R.candidates(compared_pair, schema, table, chunks, numbers, held, v.decimal_tolerance, v.tolerance_by_column) if numbers else None
            out.changeable = R.changeable(compared_pair, None, held)
        return out.keep()

    def full_compare(self, schema: str, table: str, source: DataFrame, target: DataFrame, pk: tuple[str, ...] | None = None, pairs: bool = False) -> DataFrame:
        """Every difference of every row, without chunks. Rows whose key repeats are compared as multisets or, with pairs, as a join on the key does: each with
        every row of that key on the other side."""
        pair, v = self.pair(schema, table, source, target, pk), self.settings.validation
        if not pair.keys:
            return diff.multiset_diff(pair)
        return (diff.row_diff if pairs else diff.keyed_diff)(pair, v.decimal_tolerance, v.tolerance_by_column, v.null_empty_policy)


def with_fallback(engine: Engine, schema: str, table: str, source: DataFrame, target: DataFrame, **options) -> Outcome:
    """Validate by key width; if so many chunks fail that their rows differ in number, once more with chunks of equal row counts."""
    first = engine.validate(schema, table, source, target, **options)
    v: Validation = engine.settings.validation
    uneven = first.chunks.where("not match and source_rows <> target_rows").limit(v.fallback_mismatches).count()
    if first.pair.keys and K.should_fall_back(uneven, v.fallback_mismatches):
        first.release()
        return engine.validate(schema, table, source, target, force_keyset=True, **options)
    return first


__all__ = ["Engine", "Outcome", "TableProfile", "with_fallback"]
