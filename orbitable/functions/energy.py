"""Energies, percent errors and equation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAS_CONSTANT_KCAL = 0.0019872041  # kcal / (mol K)
HARTREE_TO_EV = 27.2114
BOHR_TO_ANGSTROM = 0.529177249


def enantiomeric_excess(ddg: Column, temperature: float = 298.15) -> Column:
    return F.tanh(-ddg / (2 * GAS_CONSTANT_KCAL * temperature)) * 100


def excess_class(ddg: Column, temperature: float = 298.15, threshold: float = 35.0) -> Column:
    return F.abs(enantiomeric_excess(ddg, temperature)) >= threshold


def percent_error(actual: Column, predicted: Column) -> Column:
    return F.when(actual != 0, F.abs(actual - predicted) / F.abs(actual) * 100)


def equation_text(names: Column, coefficients: Column, intercept: Column) -> Column:
    """'y = + 0.12 a - 3.00 b + 1.50' from parallel arrays."""

    def term(value: Column) -> Column:
        sign = F.when(value < 0, "- ").otherwise("+ ")
        return F.concat(sign, F.format_string("%.2f", F.abs(value)))

    parts = F.zip_with(names, coefficients, lambda n, c: F.concat(term(c), F.lit(" "), n))
    return F.concat(F.lit("y = "), F.array_join(parts, " "), F.lit(" "), term(intercept))
