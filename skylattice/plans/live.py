"""Live runs: a region or a rectangle searched by cells, resumable, down to the table and the report of the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.geo import Bounds, closed_polygon, fixed
from skylattice.operators import poi, regions, requests
from skylattice.operators.dedupe import first_wins
from skylattice.plans.pipelines import cells
from skylattice.sources import dimensions, sinks
from skylattice.sources.asking import Run

#: Fields of the providers' records that points are made of.
FIELDS = {
    "a": ("id", "name", "location", "typecode", "type", "address", "addr", "pname", "cityname", "adname"),
    "b": ("hotPointID", "id", "name", "lon", "lng", "longitude", "lat", "latitude", "typeCode", "typecode", "typeName", "type", "address", "addr", "province", "city", "county", "district"),
}


def asked(squares: DataFrame, provider: str, keywords: list[str], in_polygon: bool = True) -> DataFrame:
    """idx, kw and params: every cell with every keyword (none: one request without)."""
    words = squares.sparkSession.createDataFrame(list(enumerate(keywords or [""])), "kw int, keyword string")
    both = poi.cells_by_keyword(squares, words)
    word = F.col("keyword")
    if provider == "a":
        params = requests.a_in_polygon(closed_polygon(fixed), keyword=word)
    else:
        params = requests.b_in_polygon(word, number=fixed) if in_polygon else requests.b_in_bounds(word, number=fixed)
    return both.select("idx", "kw", params.alias("params"))


def unified(hits: DataFrame, provider: str) -> DataFrame:
    """Points of hits(idx, kw, page, pos, record), with their places: a record's fields by exact name, the record as it came."""
    held = hits.withColumn("fields", F.from_json("record", "map<string,string>"))
    named = [F.try_element_at("fields", F.lit(n)).alias(n) for n in FIELDS[provider]]
    unify = poi.from_provider_a if provider == "a" else poi.from_provider_b
    # the place travels as metadata, the only column that is passed on as it is
    flat = held.select(F.to_json(F.struct("idx", "kw", "page", "pos")).alias("at"), "record", *named)
    made = unify(flat, raw="record", metadata=F.col("_c0"))
    return made.withColumn("at", F.from_json("metadata", "idx long, kw int, page int, pos int")).select(*made.columns, "at.*")


def region(spark: SparkSession, name: str, provinces: DataFrame | None, cities: DataFrame | None) -> tuple[Bounds, str, str | None, str]:
    """Bounds, level, code and full name of a region: of tables(name, code, sides) if they are given, provinces first, else a configured one."""
    own = dimensions.REGION_ALIASES.get(name, name)
    sides = [(name, None, *map(float, dimensions.REGIONS[own][:4]))] if own in dimensions.REGIONS else []
    configured = spark.createDataFrame(sides, "name string, code string, lat_min double, lat_max double, lng_min double, lng_max double")
    tables = [t if t is not None else configured.where("false") for t in (provinces, cities)]
    found = regions.resolve(*tables, configured, name).first()  # one row
    if found is None:
        raise ValueError(f"no region {name}")
    return Bounds(*(float(found[s]) for s in regions.SIDES)), found["level"], found["code"], found["name"]


def search(run: Run, second: Run | None, bounds: Bounds, cell_m: float, provider: str, keywords: list[str]) -> None:
    """Plan and ask what isn't asked yet: every cell, and with a second run (provider B) the cells without a point once more by their rectangle."""
    squares = cells(run.spark, bounds, cell_m)
    run.plan(asked(squares, provider, keywords))
    run.ask()
    if second is not None:
        empty = squares.join(run.hits().select("idx").distinct(), "idx", "left_anti")
        second.plan(asked(empty, provider, keywords, in_polygon=False))
        second.ask()


def points(run: Run, second: Run | None, provider: str) -> DataFrame:
    """The first hit of each point in order of cell, keyword, page and place."""
    hits = run.hits()
    if second is not None:
        hits = poi.with_fallback(hits, second.hits(), "idx")
    return first_wins(unified(hits, provider), ["poi_id"], ["idx", "kw", "page", "pos"])


def target(code: str | None, keywords: list[str], asked_for: str | None) -> str | None:
    """The table that points go to: by the region's code, of its own where a keyword narrows them; none for an empty keyword."""
    if code is None or asked_for == "":
        return None
    return poi.target_table(code, ",".join(keywords))


def save(found: DataFrame, run: Run, table: str | None, name: str, level: str, provider: str, keywords: list[str]) -> dict[str, object]:
    """Filter, write and report: what was asked, what failed, what is left. Provider B's points aren't filtered by region."""
    kept = poi.in_region(found, name, level) if provider == "a" else found
    about = ", ".join(keywords) or "all"
    rows = sinks.save_table(kept.drop("idx", "kw", "page", "pos"), table, f"points of {name}, {about}") if table else 0
    counted, status = run.counts().agg(F.sum("requests"), F.sum("failed"), F.sum("empty"), F.sum("records")).first(), run.cells().first()
    named = dict(zip(("requests", "failed_requests", "empty_requests", "records"), (x or 0 for x in counted)))
    return {"region": name, "keywords": about, "table": table, "saved": rows, **named, **status.asDict()}
