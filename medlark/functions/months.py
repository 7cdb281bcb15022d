"""French names of months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = {
    1: "janvier janv jan", 2: "février fevrier févr fevr fév fev", 3: "mars", 4: "avril avr", 5: "mai", 6: "juin", 7: "juillet juill juil",
    8: "août aout", 9: "septembre sept", 10: "octobre oct", 11: "novembre nov", 12: "décembre decembre déc dec",
}
MONTHS = {name: m for m, names in _MONTHS.items() for name in names.split()}


def month_number(name: Column) -> Column:
    table = F.create_map(*[x for n, m in MONTHS.items() for x in (F.lit(n), F.lit(m))])
    return F.try_element_at(table, F.lower(name))
