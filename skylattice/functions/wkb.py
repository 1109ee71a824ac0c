"""Geometries as values: WKT and extended WKB to arrays of polygons and back, with the SRID.

A geometry is struct<kind, srid, polygons>: kind Point, Polygon or MultiPolygon, polygons as everywhere here (a point is one coordinate in one ring
of one polygon). WKT is read and written by column functions; the bytes of doubles need Python, so WKB goes through Arrow, batch by batch.

Defined results: null gives null, and so do text and bytes that are no such geometry (other kinds, cut off, with more than two dimensions). EMPTY has
no polygons. Spaces and letter case of WKT don't count; an SRID that isn't said is null.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.functions.geo import multipolygon_wkt

POLYGONS = "array<array<array<array<double>>>>"
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("srid", T.IntegerType()), T.StructField("polygons", T.ArrayType(RINGS))])
#: Numbers of kinds, and the mark of an SRID.
KINDS, SRID_MARK = {1: "Point", 3: "Polygon", 6: "MultiPolygon"}, 0x20000000
NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def from_wkt(text: Column) -> Column:
    """The geometry of a WKT, extended (`SRID=4326;...`) or not."""
    head = F.regexp_extract(text, r"(?i)^\s*(?:SRID\s*=\s*(\d+)\s*;)?\s*(POINT|POLYGON|MULTIPOLYGON)\s*(EMPTY|\(.*\))\s*$", 2)
    srid = F.regexp_extract(text, r"(?i)^\s*SRID\s*=\s*(\d+)\s*;", 1)
    kind = F.when(F.upper(head) == "POINT", "Point").when(F.upper(head) == "POLYGON", "Polygon").when(F.upper(head) == "MULTIPOLYGON", "MultiPolygon")
    body = F.regexp_extract(text, r"(?is)(EMPTY|\(.*\))\s*$", 1)
    for pattern, by in ((r"(?<![0-9])\.(?=[0-9])", "0."), (r"(?<=[0-9])\.(?![0-9])", ""), (r"(?<![eE])\+", "")):
        body = F.regexp_replace(body, pattern, by)  # JSON's numbers begin with a digit, don't end with a point and have no plus
    # as JSON: pairs of numbers to arrays, round brackets to square ones
    pairs = F.regexp_replace(F.regexp_replace(body, r"\s*([(),])\s*", "$1"), NUMBER + r"\s+" + NUMBER, "[$1,$2]")
    marked = F.translate(pairs, "()", "[]")
    # a point lacks three levels less the one its brackets make, a polygon one
    json = F.when(F.upper(body) == "EMPTY", "[]").when(kind == "Point", F.concat(F.lit("[["), marked, F.lit("]]"))).when(kind == "Polygon", F.concat(F.lit("["), marked, F.lit("]"))).otherwise(marked)
    # what is left of letters or lone numbers would be read as something else
    fine = kind.isNotNull() & ((F.upper(body) == "EMPTY") | ~F.regexp_replace(marked, r"\[" + NUMBER + "," + NUMBER + r"\]", "").rlike(r"[^\[\],]"))
    polygons = F.from_json(json, POLYGONS, {"mode": "PERMISSIVE"})
    return F.when(fine & polygons.isNotNull(), F.struct(kind.alias("kind"), F.when(srid != "", srid.cast("int")).alias("srid"), polygons.alias("polygons")))


def to_wkt(geometry: Column) -> Column:
    """WKT with six decimals, with the SRID in front where there is one."""
    whole = F.coalesce(multipolygon_wkt(geometry["polygons"]), F.lit("MULTIPOLYGON EMPTY"))
    inner = F.substring(whole, F.lit(len("MULTIPOLYGON(") + 1), F.length(whole) - len("MULTIPOLYGON()"))
    point = F.regexp_extract(whole, r"\(\(\((.*)\)\)\)", 1)
    empty = F.size(geometry["polygons"]) == 0
    text = F.when(empty, F.concat(F.upper(geometry["kind"]), F.lit(" EMPTY"))).when(geometry["kind"] == "Polygon", F.concat(F.lit("POLYGON"), inner)).when(geometry["kind"] == "Point", F.concat(F.lit("POINT("), point, F.lit(")"))).otherwise(whole)
    return F.when(geometry.isNotNull(), F.concat(F.coalesce(F.concat(F.lit("SRID="), geometry["srid"].cast("string"), F.lit(";")), F.lit("")), text))


def packed(geometry: dict | None) -> bytes | None:
    """Extended WKB, little-endian."""
    if geometry is None or geometry["kind"] not in KINDS.values() or geometry["polygons"] is None:
        return None
    number = {v: k for k, v in KINDS.items()}
    srid, polygons = geometry["srid"], geometry["polygons"]
    head = lambda kind, top: struct.pack("<BI", 1, number[kind] | (SRID_MARK if top and srid is not None else 0)) + (struct.pack("<i", srid) if top and srid is not None else b"")
    if geometry["kind"] == "Point":
        return head("Point", True) + (struct.pack("<2d", *polygons[0][0][0]) if polygons else struct.pack("<2d", *[float("nan")] * 2))
    rings = lambda p: struct.pack("<I", len(p)) + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in p)
    if geometry["kind"] == "Polygon":
        return head("Polygon", True) + (rings(polygons[0]) if polygons else struct.pack("<I", 0))
    return head("MultiPolygon", True) + struct.pack("<I", len(polygons)) + b"".join(head("Polygon", False) + rings(p) for p in polygons)


def unpacked(data: bytes | None) -> dict | None:
    """The geometry of extended WKB of either byte order."""
    if data is None:
        return None
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        found = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return found

    def head() -> tuple[str, str, int | None]:
        order = "<" if take("<B")[0] == 1 else ">"
        kind = take(order + "I")[0]
        return order, KINDS[kind & ~SRID_MARK], take(order + "i")[0] if kind & SRID_MARK else None

    def rings(order: str) -> list:
        found = []
        for _ in range(take(order + "I")[0]):
            n = take(order + "I")[0]
            if at + 16 * n > len(data):
                raise ValueError("cut off")
            flat = take(f"{order}{2 * n}d")
            found.append([list(p) for p in zip(flat[::2], flat[1::2])])
        return found

    try:
        order, kind, srid = head()
        if kind == "Point":
            x, y = take(order + "2d")
            polygons = [] if x != x else [[[[x, y]]]]
        elif kind == "Polygon":
            one = rings(order)
            polygons = [one] if one else []
        else:
            polygons = []
            for _ in range(take(order + "I")[0]):
                own, part, _ = head()
                if part != "Polygon":
                    return None
                polygons.append(rings(own))
        return {"kind": kind, "srid": srid, "polygons": polygons} if at == len(data) else None
    except (struct.error, KeyError, ValueError):
        return None


@F.arrow_udf(T.BinaryType())
def to_wkb(geometry: pa.Array) -> pa.Array:
    return pa.array([packed(g) for g in geometry.to_pylist()], pa.binary())


@F.arrow_udf(GEOMETRY)
def from_wkb(data: pa.Array) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("srid", pa.int32()), ("polygons", pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))])
    return pa.array([unpacked(d) for d in data.to_pylist()], kind)
