"""Rates, usage types and exact sums."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from costloom import constants as K
from costloom.functions import cases

MICROS = 1e6
NANOS = 1e9


def usage_type_of(pricing_model: Column) -> Column:
    return (
        F.when(pricing_model.isin(K.SPOT_MODELS), "Preemptible")
        .when(pricing_model.isin(K.COMMITTED_MODELS), "Committed")
        .otherwise("OnDemand")
    )


def family_of(machine_type: Column) -> Column:
    return F.split_part(machine_type, F.lit("-"), F.lit(1))


def estimated_compute_rate(vcpu_count: Column, memory_gb: Column) -> Column:
    return zero(vcpu_count) * F.lit(K.VCPU_HOUR_RATE) + zero(memory_gb) * F.lit(K.MEMORY_GB_HOUR_RATE)


def default_disk_rate(disk_type: Column) -> Column:
    known = ((disk_type == name, rate) for name, rate in K.DISK_GB_MONTH_RATES.items())
    return cases(known, K.OTHER_DISK_GB_MONTH_RATE)


def machine_class(machine_type: Column) -> Column:
    family = family_of(machine_type)
    return cases(((family.isin(families), name) for name, families in K.MACHINE_CLASSES.items()), "other")


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def in_units(value: Column, scale: float = MICROS) -> Column:
    """A money amount as a whole number of small units (micro-dollars by default)."""
    return F.round(value * F.lit(scale)).cast("bigint")


def exact_sum(value: Column, scale: float = MICROS) -> Column:
    """Sum of a double that does not depend on the order of the rows or on the partitioning.

    Adds whole small units as a decimal, which no realistic number of rows can overflow.
    """
    return F.sum(in_units(value, scale).cast("decimal(20,0)")).cast("double") / F.lit(scale)


def exact_avg(value: Column, scale: float = MICROS) -> Column:
    return F.try_divide(exact_sum(value, scale), F.count(value))
