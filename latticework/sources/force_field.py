"""Force fields as tables: atoms, mixing, and the definition files that simulators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.scalars import MIXING


def atom_table(spark: SparkSession, config: dict) -> DataFrame:
    """(molecule, atom, form, epsilon, sigma) of a nested configuration {molecule: {atom: [form, epsilon, sigma]}}."""
    rows = [(m, a, str(v[0]), *(float(x) for x in v[1:3])) for m, atoms in config.items() for a, v in atoms.items() if len(v) >= 3]
    return spark.createDataFrame(rows, "molecule string, atom string, form string, epsilon double, sigma double")


def check_same(config: dict, molecules: list[str]) -> None:
    """Raises if an atom that several molecules share has different parameters in them."""
    seen: dict[str, tuple] = {}
    for m in molecules:
        for a, v in config[m].items():
            if seen.setdefault(a, tuple(v)) != tuple(v):
                raise ValueError(f"{a} differs between molecules")


def mixed(atoms: DataFrame, rule: str = "Lorentz-Berthelot") -> DataFrame:
    """(atom_1, atom_2, epsilon, sigma) of every two atoms, each pair once. A force field's atoms are few: the right side is small."""
    if rule not in MIXING:
        raise ValueError(f"unknown mixing rule {rule}")
    own = atoms.select("atom", "epsilon", "sigma").distinct()
    a, b = (own.select(*[F.col(c).alias(f"{c}_{n}") for c in own.columns]) for n in (1, 2))
    eps, sigma = MIXING[rule](F.col("epsilon_1"), F.col("sigma_1"), F.col("epsilon_2"), F.col("sigma_2"))
    return a.join(b, F.col("atom_1") <= F.col("atom_2")).select("atom_1", "atom_2", eps.alias("epsilon"), sigma.alias("sigma"))


def mixing_lines(atoms: DataFrame, shifted: bool = False, tail: bool = True, rule: str = "Lorentz-Berthelot") -> DataFrame:
    """(value): the lines of a mixing-rules file, in order."""
    spark = atoms.sparkSession
    n = atoms.select("atom").distinct().count()
    head = ["# general rule for shifted vs truncated", "shifted" if shifted else "truncated", "# general rule tailcorrections", "yes" if tail else "no", "# number of defined interactions", str(n), "# type interaction, parameters"]
    body = atoms.select("atom", "form", "epsilon", "sigma").distinct().select(F.lit(1).alias("part"), F.col("atom").alias("o"), F.format_string("%s %s %.3f %.3f", "atom", "form", "epsilon", "sigma").alias("value"))
    first = spark.createDataFrame([(0, f"{i:03d}", x) for i, x in enumerate(head)], "part int, o string, value string")
    last = spark.createDataFrame([(2, "0", "# general mixing rule for Lennard-Jones"), (2, "1", rule)], "part int, o string, value string")
    return first.union(body).union(last).orderBy("part", "o").select("value")


def pseudo_atom_lines(atoms: DataFrame, masses: DataFrame) -> DataFrame:
    """(value): a line for each atom with its element's mass and charge. masses: (atom, element, mass, charge)."""
    met = atoms.select("atom").distinct().join(masses, "atom")
    return met.orderBy("atom").select(F.format_string("%s yes %s %s 0 %.4f %.4f 0.0 1.0 1.0 0 0 relative 0", "atom", "element", "element", "mass", "charge").alias("value"))
