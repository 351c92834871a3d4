"""Column functions: cleaning of published tables, units, names, key-value texts and force-field mixing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kJ/mol of a kelvin.
KELVIN = 8.314464919 / 1000
# Entries of the price table that aren't numbers.
NO_PRICE = ("Not traded.", "No reliable price available.")
NEGATIVE_PRICE = "Negative price."


def number_or_null(x: Column) -> Column:
    """x as a double; null where it isn't one, or NaN or infinite."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def clean_price(x: Column) -> Column:
    """A price text as a number: the middle of a range, 0 for a negative price, null where none is known."""
    ends = F.split(x, "–")
    middle = (number_or_null(ends[0]) + number_or_null(ends[1])) / 2
    return F.when(F.trim(x).isin(*NO_PRICE), F.lit(None).cast("double")).when(F.trim(x) == NEGATIVE_PRICE, 0.0).when(F.size(ends) == 2, middle).otherwise(number_or_null(x))


def clean_abundance(x: Column) -> Column:
    """An abundance text in parts per million as a fraction, without footnote marks and signs."""
    return number_or_null(F.regexp_replace(x, r"^[~≤\[\]i\s]+|[\[\]i\s]+$", "")) * 1e-6


def key_value(text: Column, label: str) -> Column:
    """The number after `label:` or `label` in a text, null if it isn't there."""
    return F.regexp_extract(text, rf"{label}:?\s+(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def token(text: Column, n: int) -> Column:
    """The n-th token from 0 of a text, as a number."""
    return number_or_null(F.try_element_at(F.split(F.trim(text), r"\s+"), F.lit(n + 1)))


def kelvin_to_kj(x: Column) -> Column:
    return x * KELVIN


def lorentz_berthelot(e1: Column, s1: Column, e2: Column, s2: Column) -> tuple[Column, Column]:
    return F.sqrt(e1 * e2), (s1 + s2) / 2


def jorgensen(e1: Column, s1: Column, e2: Column, s2: Column) -> tuple[Column, Column]:
    return F.sqrt(e1 * e2), F.sqrt(s1 * s2)


MIXING = {"Lorentz-Berthelot": lorentz_berthelot, "Jorgensen": jorgensen}


def shell_volume(inner: Column, outer: Column) -> Column:
    return 4 / 3 * math.pi * (outer * outer * outer - inner * inner * inner)


def name_part(name: Column, n: int) -> Column:
    return F.split(name, "_")[n]
