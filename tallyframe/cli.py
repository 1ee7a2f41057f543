"""Command line: python -m tallyframe.cli validate|verify|types|ddl|apply|migrate|schema|tables|selftest, under spark-submit or alone.

A table is jdbc:NAME (of the source or the target in the settings), format:PATH (parquet, orc, json, csv) or a catalog name; a schema is jdbc:NAME or a catalog name.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tallyframe import config
from tallyframe.operators import ddl
from tallyframe.operators import recommend as R
from tallyframe.plans import report
from tallyframe.plans.engine import Engine, with_fallback
from tallyframe.sources import catalog, dictionary, migrate, tables


def _split(where: str) -> tuple[str, str]:
    kind, colon, rest = where.partition(":")
    return (kind, rest) if colon and kind in ("jdbc", *tables.FORMATS) else ("catalog", where)


def read(spark: SparkSession, where: str, settings: config.Connection, key: tuple[str, ...] | None = None) -> DataFrame:
    """A table; over JDBC in partitions if its key is known."""
    kind, rest = _split(where)
    if kind == "jdbc":
        return tables.read_jdbc(spark, settings, rest, key=key or None)
    if kind in tables.FORMATS:
        return tables.read_files(spark, rest, kind)
    return tables.read_table(spark, rest)


def there(spark: SparkSession, where: str, connection: config.Connection) -> bool:
    """Whether a table exists; files, and a name without a schema over JDBC, are taken to."""
    kind, rest = _split(where)
    if kind == "jdbc":
        schema, _, name = rest.replace('"', "").rpartition(".")
        return not schema or dictionary.exists(spark, connection, schema, name)
    return kind in tables.FORMATS or catalog.exists(spark, rest)


def tables_of(spark: SparkSession, where: str, connection: config.Connection) -> list[str]:
    kind, rest = _split(where)
    return dictionary.tables(spark, connection, rest) if kind == "jdbc" else catalog.tables(spark, rest)


def _write(df: DataFrame, where: str, settings: config.Settings, mode: str) -> None:
    kind, rest = _split(where)
    if kind == "jdbc":
        tables.write_jdbc(df, replace(settings.target, batchsize=settings.migration.batch_size), rest, truncate=mode == "overwrite")
    elif kind in tables.FORMATS:
        tables.write_files(df, rest, kind, mode)
    else:
        tables.write_table(df, rest, mode)


def _key(spark: SparkSession, where: str, connection: config.Connection, given: tuple[str, ...] | None) -> tuple[str, ...] | None:
    """The key that the caller gives, else that of the table's own dictionary."""
    kind, rest = _split(where)
    if given or kind in tables.FORMATS:
        return given
    if kind == "catalog":
        return catalog.table_key(spark, rest) or None
    schema, _, name = rest.replace('"', "").rpartition(".")
    return dictionary.keys(spark, connection, schema).pk(name) or None if schema else None


def _columns(x: str) -> tuple[str, ...]:
    return tuple(x.split(","))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyframe")
    p.add_argument("--config")
    p.add_argument("--profiles")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "verify", "types", "migrate"):
        c = sub.add_parser(name)
        c.add_argument("source")
        c.add_argument("target")
        c.add_argument("--table", default="public.t", help="schema.table for names in reports and statements")
        c.add_argument("--pk", type=_columns)
        c.add_argument("--columns", type=_columns)
        c.add_argument("--where")
        c.add_argument("--reports")
        c.add_argument("--frames", help="a folder that executors reach, for reports of any size")
        c.add_argument("--lobs", type=_columns, default=())
        c.add_argument("--truncate", action="store_true")
        c.add_argument("--create", action="store_true", help="make the target's table if there is none")
    c = sub.add_parser("ddl")
    c.add_argument("source")
    c.add_argument("--table", default="public.t")
    c.add_argument("--pk", type=_columns, default=())
    c.add_argument("--create", metavar="NAME", help="create this catalog table, or with jdbc:SCHEMA.TABLE this one in the target")
    c.add_argument("--drop", action="store_true")
    c = sub.add_parser("apply")
    c.add_argument("script", help="a file of statements to run in the target, in one transaction")
    sub.add_parser("selftest")
    c = sub.add_parser("tables")
    c.add_argument("schema")
    c.add_argument("--side", choices=("source", "target"), default="source")
    c = sub.add_parser("schema")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--only", type=_columns, default=())
    c.add_argument("--reports")
    return p


def _mapping(spark: SparkSession, source: DataFrame, schema: str, name: str, pk: tuple[str, ...]) -> str:
    """What a table that is not there yet would be made of, from the source's types alone."""
    rows = ddl.column_types(ddl.dictionary(source, schema, name), pk).orderBy("column_id").collect()  # a row for each column
    lines = [f"-- {schema}.{name} is not in the target; types from the source's dictionary"]
    lines += [f"-- {r.column_name}: {r.data_type}" + (f"({r.data_precision},{r.data_scale or 0})" if r.data_precision else "") + f" -> {r.target_type}" for r in rows]
    return "\n".join([*lines, ddl.create_table(ddl.dictionary(source, schema, name), pk).first().ddl])


def _create(spark: SparkSession, settings: config.Settings, where: str, source: DataFrame, pk: tuple[str, ...], drop: bool) -> None:
    kind, rest = _split(where)
    if kind == "jdbc" and "." in rest:
        schema, _, name = rest.replace('"', "").rpartition(".")
        for text in dictionary.create(spark, settings.target, ddl.dictionary(source, schema, name), schema, name, pk, drop):
            print(text)
    elif kind == "catalog":
        ddl.create_spark_table(spark, rest, source.schema, pk, drop)


def _in_schema(where: str, schema: str | None) -> str:
    """A table's place with the schema that the settings name, if it has none of its own."""
    kind, rest = _split(where)
    if kind in tables.FORMATS or not schema or "." in rest:
        return where
    return f"jdbc:{schema}.{rest}" if kind == "jdbc" else f"{schema}.{rest}"


def _schema(spark: SparkSession, settings: config.Settings, args) -> int:
    sides = [(args.source, settings.source), (args.target, settings.target)]
    both, missing = catalog.matching(*(tables_of(spark, where, c) for where, c in sides), args.only)
    names = {t.lower(): t for t in tables_of(spark, *sides[1])}
    kinds = [_split(where) for where, _ in sides]
    registry = dictionary.keys(spark, settings.source, kinds[0][1]) if kinds[0][0] == "jdbc" else None
    bad = 0
    for t in both:
        places = [f"jdbc:{dictionary.quoted(spark, c, rest, n)}" if kind == "jdbc" else f"{rest}.{n}" for (kind, rest), n, (_, c) in zip(kinds, (t, names[t.lower()]), sides, strict=True)]
        key = registry.pk(t) or None if registry else _key(spark, places[0], settings.source, None)
        frames = [read(spark, place, c) for place, (_, c) in zip(places, sides, strict=True)]
        try:
            out = with_fallback(Engine(settings), kinds[0][1], t, *frames, pk=key)
        except ValueError as wrong:  # a key that one side lacks; the other tables are still compared
            bad += 1
            print(f"{t}: NOT identical ({wrong})")
            continue
        bad += not out.identical
        if args.reports:
            out.save(args.reports)
        print(f"{t}: {'identical' if out.identical else 'NOT identical'}")
        out.release()
    for t in missing:
        print(f"{t}: not in {args.target}")
    return int(bool(bad or not both))  # nothing to compare is no success


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    settings = config.load(args.config, args.profiles) if args.config else config.Settings()
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "selftest":
        print(tables.self_test(spark).first().asDict())
        return 0
    if args.command == "tables":
        found = tables_of(spark, args.schema, getattr(settings, args.side))
        print("\n".join(found))
        return int(not found)
    if args.command == "apply":
        with open(args.script, encoding="utf-8") as f:
            print(dictionary.execute(spark, settings.target, dictionary.statements_of(f.read())), "statements ran")
        return 0
    if args.command == "schema":
        return _schema(spark, settings, args)
    schema, _, name = args.table.rpartition(".")
    if args.command == "ddl":
        source = read(spark, args.source, settings.source)
        print(ddl.create_table(ddl.dictionary(source, schema, name), args.pk).first().ddl)
        if args.pk:
            rows = spark.createDataFrame([(schema, name, f"pk_{name}", c, k) for k, c in enumerate(args.pk)], "schema_name string, table_name string, constraint_name string, column_name string, position int")
            print(ddl.primary_key(rows).first().ddl)
        if args.create:
            _create(spark, settings, args.create, source, args.pk, args.drop)
        return 0
    target_place = _in_schema(args.target, settings.migration.target_schema)
    key = _key(spark, args.source, settings.source, args.pk)
    source = read(spark, args.source, settings.source, key)
    if args.command == "migrate":
        if args.create or settings.migration.create_table and _split(target_place)[0] == "jdbc":
            _create(spark, settings, target_place, source, key or (), False)
        done = migrate.migrate(source, lambda df, mode: _write(df, target_place, settings, mode), lambda: read(spark, target_place, settings.target), key or (), args.truncate or settings.migration.truncate_before_insert)
        print(done)
        return int(not done.match)
    if not there(spark, target_place, settings.target):
        print(_mapping(spark, source, schema, name, key or ()))
        if args.create:
            _create(spark, settings, target_place, source, key or (), False)
        return int(args.command != "types")
    target = read(spark, target_place, settings.target, key)
    if args.command == "verify":
        pair = Engine(settings).pair(schema, name, source, target, key, args.columns, args.where)
        done = migrate.verify(pair)
        lacking = [*pair.missing, *pair.extra]
        print(done, f"columns of one side alone: {', '.join(lacking)}" if lacking else "")
        return int(not done.match or bool(lacking))
    if args.command == "types":
        pair = Engine(settings).pair(schema, name, source, target, key, args.columns, args.where)
        held = R.Keys(pair.keys)
        frames = R.alter_ddl(pair, schema, name, None, held), R.candidates(pair, schema, name, None, None, held), R.changeable(pair, None, held)
        kind, rest = _split(target_place)
        size = catalog.table_bytes(spark, rest) if kind == "catalog" else None
        print(report.ddl_script(schema, name, *([r.asDict() for r in d.orderBy("column_name").collect()] for d in frames), table_bytes=size))  # a row for each column
        return 0
    out = with_fallback(Engine(settings), schema, name, source, target, pk=key, columns=args.columns, where=args.where, lobs=args.lobs)
    run, aggregates = out.reports()
    print(report.readable(schema, name, run, aggregates))
    if args.reports:
        out.save(args.reports, frames=args.frames)
    return int(not report.final_verdict(run, aggregates))


if __name__ == "__main__":
    sys.exit(main())
