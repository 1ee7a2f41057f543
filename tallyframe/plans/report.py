"""Reports: run summaries as DataFrames, and small JSON, text and SQL files on the driver."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.diff import ROW_COUNT

#: Rows that the JSON and the text show of differences, of columns that don't match, and of partitions and metrics; beside each list stands how many there are.
DETAILS, COLUMNS, LISTED = 10, 5, 1000


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """total_chunks, matched_chunks, mismatched_chunks, match_rate, source_rows, target_rows of compare_chunks; without a chunk the rate is null."""
    ok = F.count_if("match")
    total = F.count(F.lit(1))
    rows = [F.coalesce(F.sum(f"{s}_rows"), F.lit(0).cast("long")).alias(f"{s}_rows") for s in ("source", "target")] if "source_rows" in chunks.columns else []
    return chunks.agg(total.alias("total_chunks"), ok.alias("matched_chunks"), F.count_if(~F.col("match")).alias("mismatched_chunks"), (ok / F.nullif(total, F.lit(0))).alias("match_rate"), *rows)


def _rows(df: DataFrame, order: list[str], most: int) -> list[dict]:
    return [r.asDict() for r in df.orderBy(*order).limit(most).collect()]


def run_summary(chunks: DataFrame, drilled: DataFrame | None = None, partitions: DataFrame | None = None, errors: int = 0, columns: DataFrame | None = None, keys: DataFrame | None = None, lobs: DataFrame | None = None) -> dict:
    """What a run found, with the first DETAILS differences and LISTED partitions; no chunk at all counts as an error."""
    totals = chunk_totals(chunks).first()
    out = {
        "total_chunks": totals.total_chunks,
        "matched_chunks": totals.matched_chunks,
        "mismatched_chunks": totals.mismatched_chunks,
        "error_chunks": errors + (totals.total_chunks == 0),
        "match_rate": totals.match_rate or 0.0,
        "row_counts": {"source": totals.source_rows, "target": totals.target_rows, "reason": ROW_COUNT if totals.source_rows != totals.target_rows else None},
        "mismatch_details": _rows(drilled, ["chunk_id"], DETAILS) if drilled is not None else [],
        "column_mismatches": [r.asDict() for r in columns.collect()] if columns is not None else [],  # a row for each column
        "key_problems": [r.asDict() for r in keys.collect()] if keys is not None else [],  # two rows
        "lob_mismatches": [r.asDict() for r in lobs.where("not match").orderBy("column_name").limit(LISTED).collect()] if lobs is not None else [],
    }
    if partitions is not None:
        from tallyframe.operators.partitions import totals as partition_totals

        out["partition_summary"] = partition_totals(partitions).first().asDict() | {"partition_results": _rows(partitions, ["partition_name"], LISTED)}
    return out


def aggregate_summary(compared: DataFrame) -> dict:
    """The verdict, how many metrics don't match and the first LISTED of them."""
    from tallyframe.operators.aggregates import verdict

    v = verdict(compared).first()
    failed = compared.where("not match")
    return {"summary": {"match": v.match, "total_columns": v.total_columns, "matched_columns": v.matched_columns, "mismatched_metrics": failed.count()}, "mismatches": _rows(failed, ["column_name", "metric"], LISTED)}


def final_verdict(run: dict, aggregates: dict | None = None) -> bool:
    """Identical: every chunk, aggregate and large object matches and both sides have the same columns."""
    whole = run["match_rate"] == 1.0 and not run["error_chunks"] and not run.get("column_mismatches") and not run.get("lob_mismatches")
    return whole and (aggregates is None or bool(aggregates["summary"]["match"]))


def readable(schema: str, table: str, run: dict, aggregates: dict | None = None, at: datetime | None = None) -> str:
    lines = [f"Validation of {schema}.{table}" + (f" at {at:%Y-%m-%d %H:%M:%S}" if at else ""), ""]
    lines += [f"chunks: {run['total_chunks']}, matched {run['matched_chunks']}, mismatched {run['mismatched_chunks']}, errors {run['error_chunks']}, match rate {run['match_rate']:.2%}"]
    if "partition_summary" in run:
        p = run["partition_summary"]
        lines.append(f"partitions: {p['total_partitions']}, fully verified {p['fully_verified']}, light {p['light_verified']}, failed {p['failed']}")
    if run.get("row_counts", {}).get("reason"):
        lines.append(f"{ROW_COUNT}: {run['row_counts']['source']} rows in the source, {run['row_counts']['target']} in the target")
    lines += [f"column {c['column_name']}: {c['reason']}" for c in run.get("column_mismatches", [])]
    lines += [f"keys of the {k['side']}: {k['null_key_rows']} rows with a null, {k['repeated_keys']} keys that repeat" for k in run.get("key_problems", []) if k["null_key_rows"] or k["repeated_keys"]]
    lines += [f"large object {x['column_name']}: samples differ" for x in run.get("lob_mismatches", [])]
    if run["mismatch_details"]:
        lines += ["", "first differences:"]
        lines += ["  " + ", ".join(f"{k}={v}" for k, v in d.items() if v is not None) for d in run["mismatch_details"]]
    if aggregates is not None:
        s = aggregates["summary"]
        lines += ["", f"aggregates: {s['matched_columns']} of {s['total_columns']} columns match"]
        names = list(dict.fromkeys(m["column_name"] for m in aggregates["mismatches"]))
        lines += [f"  {n}: " + ", ".join(f"{m['metric']} {m['source_value']} / {m['target_value']}" for m in aggregates["mismatches"] if m["column_name"] == n) for n in names[:COLUMNS]]
        if (more := s["total_columns"] - s["matched_columns"] - min(COLUMNS, len(names))) > 0:
            lines.append(f"  and {more} more columns")
    lines += ["", "VERDICT: " + ("identical" if final_verdict(run, aggregates) else "NOT identical")]
    return "\n".join(lines) + "\n"


def ddl_script(schema: str, table: str, alters: list, candidates: list, changeable: list | None = None, table_bytes: int | None = None, at: datetime | None = None) -> str:
    """A transaction of the proposed changes; the candidates with their reasons and a summary of the changeable columns as comments."""
    out = [f"-- Type changes for {schema}.{table}" + (f", {at:%Y-%m-%d %H:%M:%S}" if at else ""), "BEGIN;", ""]
    out += [a["ddl"] for a in alters] or ["-- no column needs a change"]
    out += ["", "-- Candidates"]
    for c in candidates:
        out.append(f"-- {c['column_name']}: {c['current_type']} -> {c['target_type']}: {'yes' if c['can_downcast'] else 'no'} ({', '.join(c['reasons'])}); rows that a cast would change: {c['dry_run_loss_count']}")
        out += [f"--   {c['message']}"] * bool(c.get("message")) + [f"--   {c['ddl']}"] * bool(c.get("ddl"))
    if changeable:
        out += ["", "-- Changeable columns"]
        out += [f"-- size of the table: {table_bytes / 2**20:.2f} MB"] if table_bytes is not None else []
    for c in changeable or []:
        out.append(f"-- {c['column_name']}: {c['source_type']}, now {c['current_type']}, recommended {c['recommended_type']}")
        out.append(f"--   in an index: {'Y' if c['in_index'] else 'N'}; distinct ratio {c['distinct_ratio']:.4f}, null ratio {c['null_ratio']:.4f}" + (f" ({c['hint']})" if c["hint"] else ""))
        out += [f"--   {c['time_profile']}"] * bool(c.get("time_profile"))
        out.append(f"--   HAS_FRACTION: {'Y' if c.get('fractions') else 'N'}" + (f" ({c['fractions']} rows)" if c.get("fractions") else ""))
    out += ["", "COMMIT;", "-- In case of an error: ROLLBACK;"]
    return "\n".join(out) + "\n"


def file_name(schema: str, table: str, kind: str, ending: str, at: datetime) -> str:
    return "_".join(x for x in (schema, table, kind, f"{at:%Y%m%d_%H%M%S}") if x) + f".{ending}"


def save(folder: str, name: str, content) -> str:
    """Text as it is, anything else as JSON; the path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content, indent=2, ensure_ascii=False, default=str))
    return path
