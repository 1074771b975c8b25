"""Views that can be written to: changes to a view as changes to the table under it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.dml import Change

BASE, SEEN, PASSED, HIT = "__base", "__seen", "__passed", "__hit"


class View:
    """Columns and a condition over a table, or over another such view.

    ``columns`` maps names to column names of what lies below, which can be written, or to expressions,
    which can not; without it all columns are taken. ``check`` rejects rows that a write would put out of
    sight: ``"local"`` by the conditions of this view and of views below that check themselves,
    ``"cascaded"`` by the conditions of all views below.

    Writes give the new table and the rows written, as the view shows them. Each is one pass over the
    table; a rejected row ends the job that reads the result with an error. NULL conditions hide a row.
    Tables must not have columns named ``__base``, ``__seen``, ``__passed`` or ``__hit``.
    """

    def __init__(
        self, below: DataFrame | View, where: Column | None = None, columns: Mapping[str, str | Column] | None = None,
        check: str | None = None,
    ):
        if check not in (None, "local", "cascaded"):
            raise ValueError(f"unknown check option {check}")
        self.below, self.where, self.check = below, where, check
        names = below.names if isinstance(below, View) else below.columns
        self.columns = dict(columns) if columns else {n: n for n in names}

    @property
    def names(self) -> list[str]:
        return list(self.columns)

    @property
    def table(self) -> DataFrame:
        return self.below.table if isinstance(self.below, View) else self.below

    def rows(self) -> DataFrame:
        """What the view shows."""
        return self._frame(self.table).filter(SEEN).select(*self.names)

    def insert(self, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> Change:
        """Rows given by view columns; table columns without a value take their default or NULL."""
        targets = {self._target(n): n for n in rows.columns}
        value = lambda f: F.col(targets[f.name]) if f.name in targets else (defaults or {}).get(f.name, F.lit(None))
        added = rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in self.table.schema.fields])
        added = self._checked(added.withColumn(HIT, F.lit(True)))
        return Change(self.table.unionByName(added.drop(HIT)), self._written(added))

    def update(self, assign: Mapping[str, Column], where: Column | None = None) -> Change:
        """Visible rows for which ``where`` holds take the assigned values, all computed from the old row."""
        targets = {self._target(n): v for n, v in assign.items()}
        frame = self._frame(self.table).withColumn(HIT, self._reached(where))
        old = lambda f: F.col(BASE)[f.name]
        changed = frame.select(
            *[
                (F.when(F.col(HIT), targets[f.name].cast(f.dataType)).otherwise(old(f)) if f.name in targets else old(f)).alias(f.name)
                for f in self.table.schema.fields
            ],
            HIT,
        )
        changed = self._checked(changed)
        return Change(changed.drop(HIT), self._written(changed))

    def delete(self, where: Column | None = None) -> Change:
        """Visible rows for which ``where`` holds go; they are returned as they were."""
        frame = self._frame(self.table).withColumn(HIT, self._reached(where))
        return Change(frame.filter(~F.col(HIT)).select(f"{BASE}.*"), frame.filter(HIT).select(*self.names))

    def _reached(self, where: Column | None) -> Column:
        return F.col(SEEN) & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))

    def _target(self, name: str) -> str:
        """Table column that a view column stands for."""
        if name not in self.columns:
            raise ValueError(f"the view has no column {name}")
        source = self.columns[name]
        if not isinstance(source, str):
            raise ValueError(f"column {name} is an expression and cannot be written")
        return self.below._target(source) if isinstance(self.below, View) else source

    def _frame(self, table: DataFrame, checks: str | None = None) -> DataFrame:
        """Table rows beside what the view shows of them: view columns, the table row as ``__base``, whether
        the view shows it, and whether the check options from here down, and those asked for, let it pass."""
        asked = "cascaded" if checks == "cascaded" or self.check == "cascaded" else None
        if isinstance(self.below, View):
            frame = self.below._frame(table, asked)
        else:
            frame = table.select(*self.below.columns, F.struct(*table.columns).alias(BASE), F.lit(True).alias(SEEN), F.lit(True).alias(PASSED))
        own = F.lit(True) if self.where is None else F.coalesce(self.where, F.lit(False))
        checked = own if asked or self.check else F.lit(True)
        shown = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in self.columns.items()]
        return frame.select(*shown, BASE, (F.col(SEEN) & own).alias(SEEN), (F.col(PASSED) & checked).alias(PASSED))

    def _checks(self) -> bool:
        return bool(self.check) or isinstance(self.below, View) and self.below._checks()

    def _checked(self, rows: DataFrame) -> DataFrame:
        """The rows; reading one that is written and breaks a check option fails."""
        if not self._checks():
            return rows
        wrong = F.raise_error(F.lit("new row violates the check option of the view")).cast("boolean")
        fine = F.when(~F.col(f"{BASE}.{HIT}") | F.col(PASSED), F.lit(True)).otherwise(wrong)
        return self._frame(rows).filter(fine).select(f"{BASE}.*")

    def _written(self, rows: DataFrame) -> DataFrame:
        return self._frame(rows).filter(f"{BASE}.{HIT}").select(*self.names)
