"""Structures as tables: a header-driven CIF reader, JSON molecules and graphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.pairs import lattice_vectors
from latticework.sources.text_tables import whole_files

CELL = ("a", "b", "c", "alpha", "beta", "gamma")
PARSED = (
    "struct_id string, a double, b double, c double, alpha double, beta double, gamma double, "
    "sites array<struct<symbol: string, label: string, fx: double, fy: double, fz: double, charge: double, occupancy: double>>, _error string"
)
MOLECULE = "sites array<struct<name: string, species: array<struct<element: string, occu: double>>, xyz: array<double>>>, lattice struct<matrix: array<array<double>>>"
NUMBER = re.compile(r"^([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?:\(\d+\))?$")


def _number(text: str | None) -> float | None:
    found = NUMBER.match(text or "")
    return float(found[1]) if found else None


def parse_cif(text: str) -> dict:
    """Cell and atoms of the first data block. Columns of the atom loop are found by their tags."""
    tokens = [m[1] or m[2] or m[0] if m[1] is not None or m[2] is not None else m[0] for m in re.finditer(r"'([^']*)'(?=\s|$)|\"([^\"]*)\"(?=\s|$)|\S+", re.sub(r"(?m)#.*$", "", text))]
    cell: dict[str, float | None] = {}
    atoms: list[dict[str, str]] = []
    i = 0
    while i < len(tokens):
        t = tokens[i].lower()
        if t == "loop_":
            i += 1
            tags = []
            while i < len(tokens) and tokens[i].startswith("_"):
                tags.append(tokens[i].lower())
                i += 1
            rows = []
            while i + len(tags) <= len(tokens) and tags and not re.match(r"(?i)^(loop_|data_|_)", tokens[i]):
                rows.append(dict(zip(tags, tokens[i : i + len(tags)])))
                i += len(tags)
            if "_atom_site_fract_x" in tags:
                atoms = rows
            continue
        if t.startswith("_cell_") and i + 1 < len(tokens):
            name = t.removeprefix("_cell_length_").removeprefix("_cell_angle_")
            if name in CELL:
                cell[name] = _number(tokens[i + 1])
            i += 1
        i += 1
    if not atoms or any(cell.get(c) is None for c in CELL):
        raise ValueError("no cell or no atoms")
    sites = []
    for row in atoms:
        label = row.get("_atom_site_label", "")
        symbol = re.match(r"[A-Za-z]+", row.get("_atom_site_type_symbol", label) or label)
        sites.append(
            {"symbol": symbol[0].capitalize() if symbol else None, "label": label, **{f"f{x}": _number(row[f"_atom_site_fract_{x}"]) for x in "xyz"},
             "charge": _number(row.get("_atom_site_charge")), "occupancy": _number(row.get("_atom_site_occupancy"))}
        )
    return {**{c: cell[c] for c in CELL}, "sites": sites}


SITE = pa.struct([("symbol", pa.string()), ("label", pa.string()), *[(c, pa.float64()) for c in ("fx", "fy", "fz", "charge", "occupancy")]])
ARROW = pa.schema([("struct_id", pa.string()), *[(c, pa.float64()) for c in CELL], ("sites", pa.list_(SITE)), ("_error", pa.string())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
            try:
                rows.append({"struct_id": name, **parse_cif(text)})
            except (ValueError, KeyError) as e:
                rows.append({"struct_id": name, "_error": str(e)})
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


def read_cif(spark: SparkSession, path: str, glob: str = "*.cif") -> tuple[DataFrame, DataFrame]:
    """(structures, sites) of the CIF files below path. A file that can't be parsed is a structure with _error and no sites."""
    found = whole_files(spark, path, glob).mapInArrow(_parsed, PARSED)
    structures = found.select("struct_id", *CELL, F.when(F.col("a").isNotNull(), lattice_vectors(*[F.col(c) for c in CELL])).alias("lattice"), "_error")
    sites = found.select("struct_id", lattice_vectors(*[F.col(c) for c in CELL]).alias("l"), F.posexplode("sites").alias("site_id", "s"))
    cart = [sum((F.col(f"s.f{x}") * F.col("l")[r][i] for r, x in enumerate("xyz")), F.lit(0.0)).alias(x) for i, x in enumerate("xyz")]
    return structures, sites.select("struct_id", "site_id", "s.symbol", "s.label", "s.fx", "s.fy", "s.fz", *cart, "s.charge", "s.occupancy")


def read_molecules(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(struct_id, site_id, symbol, x, y, z, lattice) of molecules and structures in JSON."""
    own = whole_files(spark, path, glob).select(F.col("name").alias("struct_id"), F.from_json("text", MOLECULE).alias("m"))
    return own.select("struct_id", "m.lattice.matrix", F.posexplode("m.sites").alias("site_id", "s")).select("struct_id", "site_id", F.col("s.species")[0]["element"].alias("symbol"), *[F.col("s.xyz")[i].alias(c) for i, c in enumerate("xyz")], F.col("matrix").alias("lattice"))


def bonds(pairs: DataFrame, sites: DataFrame, cutoffs: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(struct_id, i, j) both ways: site pairs closer than their symbols' cut-off. cutoffs: (symbol_1, symbol_2, cutoff), in either order."""
    both = cutoffs.select("symbol_1", "symbol_2", "cutoff").union(cutoffs.select("symbol_2", "symbol_1", "cutoff")).distinct()
    side = lambda s: sites.select(F.col("struct_id").alias(f"{s}s"), F.col("site_id").alias(f"{s}i"), F.col("symbol").alias(f"{s}y"))
    met = pairs.join(side("a"), (F.col("struct_id") == F.col("as")) & (F.col("site_id_a") == F.col("ai"))).join(side("b"), (F.col("struct_id") == F.col("bs")) & (F.col("site_id_b") == F.col("bi")))
    near = met.join(both, (F.col("ay") == F.col("symbol_1")) & (F.col("by") == F.col("symbol_2"))).where(F.col("distance") <= F.col("cutoff") + tolerance)
    return near.select("struct_id", F.col("site_id_a").alias("i"), F.col("site_id_b").alias("j")).union(near.select("struct_id", "site_id_b", "site_id_a")).distinct()
