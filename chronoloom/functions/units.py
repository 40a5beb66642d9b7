"""Units by their parts: prefix, base, power and quotient."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: prefixes, base units and units with a name of their own
PREFIXES = {"n": "nano", "u": "micro", "\u00b5": "micro", "m": "milli", "c": "centi", "k": "kilo", "M": "mega"}
BASES = {"V": "volt", "W": "watt", "A": "ampere", "g": "gram", "s": "second", "m": "metre", "Hz": "hertz", "Pa": "pascal", "T": "tesla"}
NAMED = {"1": "dimensionless", "bpm": "beat/minute", "degC": "degree_Celsius", "%": "percent"}


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def normal_unit(unit: Column) -> Column:
    """``mV`` to ``millivolt``, ``m/s^2`` to ``metre/second^2``; a unit that can't be read stays as it is, null stays null."""
    bases = "|".join(BASES)

    def part(p: Column) -> Column:
        base = F.regexp_extract(p, rf"^(?:[{''.join(PREFIXES)}])?({bases})(?:\^[0-9]+)?$", 1)
        whole = F.regexp_extract(p, rf"^({bases})(?:\^[0-9]+)?$", 1)
        power = F.regexp_extract(p, r"(\^[0-9]+)$", 1)
        prefix = F.when(whole != "", "").otherwise(F.coalesce(_lookup(PREFIXES, F.substring(p, 1, 1)), F.lit("")))
        return F.concat(prefix, _lookup(BASES, F.when(whole != "", whole).otherwise(base)), power)

    parts = F.transform(F.split(unit, "/"), part)
    read = F.when(F.forall(parts, lambda x: x.isNotNull()), F.array_join(parts, "/"))
    return F.coalesce(_lookup(NAMED, unit), read, unit)
