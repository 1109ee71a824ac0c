"""Command line: `python -m skylattice types|points|zones|search|copy|sync ...`. Errors end the run with a status that isn't 0."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skylattice.functions.geo import Bounds
from skylattice.functions.values import EVERYTHING
from skylattice.operators import catalog, poi, type_tree, zones
from skylattice.plans import live, pipelines
from skylattice.sources import asking, database, dimensions, map_search, sinks

#: Kinds of catalog objects in order of use.
KINDS = ("tables", "functions", "views")


def bounds(args: argparse.Namespace) -> Bounds:
    """A configured region by name, or four sides, which must all be there."""
    if args.region:
        name = dimensions.REGION_ALIASES.get(args.region, args.region)
        if name not in dimensions.REGIONS:
            raise SystemExit(f"no configured region {args.region}")
        return Bounds(*dimensions.REGIONS[name][:4])
    sides = (args.lat_min, args.lat_max, args.lng_min, args.lng_max)
    if any(s is None for s in sides):
        raise SystemExit("a region or all four bounds are needed")
    return Bounds(*sides)


def around(args: argparse.Namespace) -> tuple[float, float, float] | None:
    """The place and radius of a run around one place, which must all be there or none."""
    place = (args.lat, args.lng, args.radius_m)
    if all(x is None for x in place):
        return None
    if any(x is None for x in place):
        raise SystemExit("a place needs --lat, --lng and --radius-m")
    return place


def sync(spark: SparkSession, args: argparse.Namespace) -> None:
    """Tables first, then functions, then views, which may use both."""
    there = catalog.objects(spark, dict.fromkeys([args.source, *(args.schemas if args.list else [])]))
    kinds = [k for k in KINDS if args.only in ("all", k)]
    if args.list:
        there.where(F.col("kind").isin(*[k[:-1] for k in kinds])).show(1000, truncate=False)
        return
    catalog.answering(spark, args.target)
    named = any(getattr(args, k) for k in KINDS)
    for kind in kinds:
        # a run that names objects of one kind copies no others
        if named and args.only == "all" and not getattr(args, kind):
            continue
        names = catalog.chosen(getattr(args, kind), there, kind[:-1])
        if kind == "tables":
            catalog.sync_tables(spark, names, args.source, args.target, clean=not args.no_clean).show(1000, truncate=False)
        elif kind == "functions":
            print("functions:", *catalog.sync_functions(spark, catalog.function_signatures(spark, names, args.source), args.target))
        else:
            print("views:", *catalog.sync_views(spark, catalog.view_bodies(spark, names, args.source), args.target))


def search(spark: SparkSession, args: argparse.Namespace) -> dict[str, object]:
    """A live run; its report."""
    said = args.keyword[0] if args.keyword else None
    keywords = [k for k in args.keyword or [] if k and k.strip().strip("'\"").lower() not in EVERYTHING]
    if args.provider == "b" and said is not None and not keywords and said != "":  # provider B has no search for everything: one for each type
        named = type_tree.keywords(dimensions.type_tree(spark, "b")).orderBy("position").collect()  # a few dozen types
        keywords = [r["keyword"] for r in named]
    if args.region:
        tables = [spark.table(t) if t else None for t in (args.provinces, args.cities)]
        try:
            area, level, code, name = live.region(spark, args.region, *tables)
        except ValueError as e:
            raise SystemExit(str(e)) from e
    else:
        area, level, code, name = bounds(args), "bounds", None, "bounds"
    configured = dimensions.REGIONS.get(dimensions.REGION_ALIASES.get(args.region, args.region), ())[4:]
    cell_m = args.cell_m or dimensions.CELL_BY_LEVEL.get(level) or (configured[0] if level == "config" else dimensions.CELL_BY_LEVEL["city"])
    options = {"url": args.url, "kind": args.provider, "pause_s": str(args.pause_s)} | dict(o.split("=", 1) for o in args.option)
    run_ = asking.Run(spark, f"{args.folder}/first", options, args.parallel, args.per_batch)
    second = asking.Run(spark, f"{args.folder}/second", options, args.parallel, args.per_batch) if args.provider == "b" else None
    live.search(run_, second, area, cell_m, args.provider, keywords)
    if args.again and run_.again():
        run_.ask()
    table = args.table or live.target(args.code or code, keywords, said)
    report = live.save(live.points(run_, second, args.provider), run_, table, name, level, args.provider, keywords)
    print(json.dumps(report, ensure_ascii=False))
    return report


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="skylattice", description=__doc__)
    sub = main.add_subparsers(dest="command", required=True)
    types = sub.add_parser("types", help="a provider's types as a table")
    types.add_argument("provider", choices=("a", "b"))
    types.add_argument("--table")
    types.add_argument("--url", help="ask the provider; the shipped types where it fails or has none")
    types.add_argument("--option", action="append", default=[], help="name=value of the source")
    for name in ("points", "zones"):
        p = sub.add_parser(name, help=f"landed {name} of a region into a table")
        p.add_argument("input", help="JSON lines of records")
        p.add_argument("table")
        p.add_argument("--region")
        for side in Bounds._fields:
            p.add_argument(f"--{side.replace('_', '-')}", type=float)
        for place in ("--lat", "--lng", "--radius-m"):
            p.add_argument(place, type=float, help="a run around one place instead of a region")
        p.add_argument("--cell-m", type=float, default=dimensions.CELL_BY_LEVEL["city"])
        if name == "points":
            p.add_argument("--provider", choices=("a", "b"), default="a")
            p.add_argument("--keyword")
            p.add_argument("--city")
    search = sub.add_parser("search", help="search a region or a rectangle live; a run that was stopped goes on in its folder")
    search.add_argument("provider", choices=("a", "b"))
    search.add_argument("url")
    search.add_argument("folder", help="shared by driver and executors")
    search.add_argument("--region")
    for side in Bounds._fields:
        search.add_argument(f"--{side.replace('_', '-')}", type=float)
    search.add_argument("--provinces", help="a table with name, code and sides; so --cities")
    search.add_argument("--cities")
    search.add_argument("--code", help="of the region, where no table says it")
    search.add_argument("--table", help="instead of the region's own")
    search.add_argument("--keyword", action="append", help="several may be given; none or one that asks for everything: all types")
    search.add_argument("--cell-m", type=float, help="by the region's level unless said")
    search.add_argument("--option", action="append", default=[], help="name=value of the source: key_env, page_size, paging, headers, ...")
    search.add_argument("--pause-s", type=float, default=0.2, help="between requests of all tasks together")
    search.add_argument("--parallel", type=int, default=4)
    search.add_argument("--per-batch", type=int, default=1000)
    search.add_argument("--again", action="store_true", help="ask what failed once more")
    copy = sub.add_parser("copy", help="copy tables from one database to another; the first error stops")
    copy.add_argument("source", help="JDBC URL; user and password as SOURCE_USER, SOURCE_PASSWORD")
    copy.add_argument("target", help="JDBC URL; user and password as TARGET_USER, TARGET_PASSWORD")
    copy.add_argument("tables", nargs="+", help="name, or name:key with a numeric key that deals the rows out")
    copy.add_argument("--parts", type=int, default=16)
    copy.add_argument("--probe", help="a query that any database of this kind answers")
    sync = sub.add_parser("sync", help="copy tables, functions and views from one schema to another")
    sync.add_argument("source")
    sync.add_argument("target")
    sync.add_argument("--only", choices=("all", *KINDS), default="all", help="one kind of object")
    for kind in KINDS:
        sync.add_argument(f"--{kind}", nargs="*", default=[], help=f"these {kind} instead of all")
    sync.add_argument("--schemas", nargs="*", default=[], help="with --list: the schemas to list besides the source")
    sync.add_argument("--no-clean", action="store_true")
    sync.add_argument("--list", action="store_true")
    return main


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "types":
        tree = dimensions.type_tree(spark, args.provider)
        if args.url:
            map_search.register(spark)
            options = {"url": args.url, "kind": "types", "requests": json.dumps([{"idx": 1}])} | dict(o.split("=", 1) for o in args.option)
            tree = dimensions.types_or_shipped(spark.createDataFrame(spark.read.format("map_search").options(**options).load().collect(), map_search.SCHEMA), args.provider)  # a few dozen types, asked once
        flat = type_tree.flatten(tree).withColumn("provider", F.lit(args.provider))
        if args.table:
            sinks.save_table(flat, args.table)
        flat.orderBy("type_code").show(1000, truncate=False)
    elif args.command == "points":
        place = around(args)
        area = None if place else bounds(args)
        unify = poi.from_provider_a if args.provider == "a" else poi.from_provider_b
        points = poi.with_keyword(unify(spark.read.json(args.input)), args.keyword)
        if place:
            found = pipelines.points_around(points, *place)
        else:
            found = pipelines.region_points(points, area, args.cell_m, name=args.city, level="city" if args.city else None).drop("idx")
        sinks.save_table(found, args.table)
    elif args.command == "zones":
        place = around(args)
        area = None if place else bounds(args)
        found = zones.features(zones.at_levels(spark.read.schema(zones.SCHEMA).json(args.input)))
        found = pipelines.zones_around(found, *place) if place else pipelines.region_zones(found, area, args.cell_m)
        sinks.save_table(zones.table_rows(found), args.table)
    elif args.command == "search":
        search(spark, args)
    elif args.command == "copy":
        ends = [database.Database(spark, url, prefix, args.probe) for url, prefix in ((args.source, "SOURCE"), (args.target, "TARGET"))]
        try:
            database.copy_tables(*ends, [(n, k or None) for n, _, k in (t.partition(":") for t in args.tables)], args.parts).show(1000, truncate=False)
        except (ConnectionError, database.Stopped) as e:
            raise SystemExit(str(e)) from e
    else:
        sync(spark, args)


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    session = SparkSession.builder.appName("skylattice").getOrCreate()
    run(session)
    session.stop()
