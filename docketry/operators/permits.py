"""Which cases a query may find: those that count at all, and of these what the query itself asks for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.checks import small

#: What a query may ask for; a null or an empty value asks for nothing.
FILTERS = ("risk_type", "regulator", "institution_type", "date_from", "date_to")
#: The column of cases that each filter looks at.
LOOKS_AT = {"risk_type": "risk_type_ids", "regulator": "regulator", "institution_type": "institution_type", "date_from": "publish_date", "date_to": "publish_date"}


def _fits(name: str, want: Column, have: Column) -> Column:
    if name == "risk_type":
        return F.array_contains(have, want)
    if name == "date_from":
        return have >= want.cast("date")
    return have <= want.cast("date") if name == "date_to" else have == want


@dataclass(frozen=True)
class Permit:
    """``cases``: (case_id, what filters look at) of the cases that count; ``asked``: (qid, filters), if there are any."""

    cases: DataFrame
    asked: DataFrame | None
    filters: tuple[str, ...]

    @classmethod
    def of(cls, queries: DataFrame, cases: DataFrame) -> Permit:
        """Cases that are ``related``, and the filters among the columns of ``queries``."""
        filters = tuple(f for f in FILTERS if f in queries.columns)
        looked_at = sorted({LOOKS_AT[f] for f in filters})
        return cls(cases.where("related").select("case_id", *looked_at), queries.select("qid", *filters) if filters else None, filters)

    def restrict(self, rows: DataFrame) -> DataFrame:
        """Rows (case_id, ...) of the cases that count."""
        return rows.join(self.cases.select("case_id"), "case_id", "left_semi")

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """Rows (qid, case_id, ...) whose case counts and is one that the query asks for."""
        if self.asked is None:
            return self.restrict(pairs)
        asked = small(self.asked.select("qid", *[F.nullif(F.col(f).cast("string"), F.lit("")).alias(f"asked_{f}") for f in self.filters]))
        found = pairs.join(self.cases.toDF("case_id", *[f"case_{c}" for c in self.cases.columns[1:]]), "case_id").join(asked, "qid")
        for f in self.filters:
            want = F.col(f"asked_{f}")
            found = found.where(want.isNull() | F.coalesce(_fits(f, want, F.col(f"case_{LOOKS_AT[f]}")), F.lit(False)))
        return found.select(*pairs.columns)
