"""What a load could not take as it stands: odd records, records and files that cannot be read, cells of another type."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.columns import field, strip_space
from tallyloom.functions.measures import actual_name
from tallyloom.functions.types import STRING, TypeBook
from tallyloom.sources import load
from tallyloom.sources.delimited import CELLS, FAULTY, FILE, MISFIT, RECORD, UNREADABLE
from tallyloom.sources.spec import LoadSpec, LoadStatus

OUTPUT = "load string, file string, reason string, field string, record string"


@dataclass(frozen=True)
class CheckedLoad:
    """A load with its second output. The counts of ``observation`` are there once ``rows`` have been run."""

    rows: DataFrame
    rejects: DataFrame
    status: LoadStatus
    observation: Observation

    def finished(self) -> LoadStatus:
        """The status with what was found; waits for ``rows`` to have been run, and looks up the names of faulty files."""
        counts = self.observation.get
        faulty: tuple = ()
        if counts.get("faulty"):
            found = self.rejects.where(F.col("reason") == FAULTY).select("file").distinct().orderBy("file")
            faulty = tuple(r["file"] for r in found.limit(LoadStatus.NAMED).collect())
        misfits = {k.removeprefix("misfit "): v for k, v in counts.items() if k.startswith("misfit ") and v}
        return replace(
            self.status, rejected_rows=counts.get("rejected", 0), faulty_files=faulty, n_faulty=counts.get("faulty", 0),
            misfits=tuple(sorted(misfits.items())),
        )


def load_checked(spark: SparkSession, spec: LoadSpec, types: TypeBook | None = None, root: str = "") -> CheckedLoad:
    """``load_table`` with the rejects of the source as rows (``OUTPUT``) and their counts in the status.

    One scan marks the records; rows leave out those that are none, rejects keep what is marked. Counts of
    the rows are observed as they pass, so they cost no scan of their own.
    """
    _, status = load.load_table(spark, spec, types, root)
    types = load.with_tags(types, [spec])
    kind = spec.source.resolved_kind()
    raw = load.read_marked(spark, spec, kind, root) if status.status == load.CONNECTED else None
    if raw is None:
        rows, _ = load.load_table(spark, spec, types, root)
        seen = Observation()
        return CheckedLoad(rows.observe(seen, F.lit(0).alias("rejected")), spark.createDataFrame([], OUTPUT), status, seen)
    cells = raw.drop(FILE, RECORD, "_reason")
    wanted = [(c, t) for c, t in _typed_cells(cells, spec, types) if t != STRING]
    serial = kind == "excel"
    checks = {c: load.cell(cells.schema[c], t, serial) for c, t in wanted}
    misfit = {c: (strip_space(field(c)) != "") & v.isNull() for c, v in checks.items()}
    seen = Observation()
    observed = raw.observe(
        seen, F.count_if(F.col("_reason").isin(CELLS, UNREADABLE)).alias("rejected"), F.count_if(F.col("_reason") == FAULTY).alias("faulty"),
        *(F.count_if(F.coalesce(m, F.lit(False))).alias(f"misfit {c}") for c, m in misfit.items()),
    )
    whole = observed.where(F.col("_reason").isNull() | (F.col("_reason") == CELLS)).select(*[field(c) for c in cells.columns])
    rows = load.shape(whole, spec, types, serial_dates=serial)
    null = F.lit(None).cast("string")
    entry = lambda reason, name, record: F.struct(reason.alias("reason"), name.alias("field"), record.alias("record"))
    listed = [F.when(F.col("_reason").isNotNull(), entry(F.col("_reason"), null, F.col(RECORD)))]
    listed += [F.when(m, entry(F.lit(MISFIT), F.lit(c), field(c))) for c, m in misfit.items()]
    rejects = raw.select(FILE, F.explode(F.array_compact(F.array(*listed))).alias("x")).select(
        F.lit(spec.name).alias("load"), F.col(FILE).alias("file"), "x.reason", "x.field", "x.record"
    )
    return CheckedLoad(rows, rejects, status, seen)


def _typed_cells(cells: DataFrame, spec: LoadSpec, types: TypeBook) -> list[tuple[str, str]]:
    names = {f.column.lower(): f.name for f in spec.fields if not f.measure}
    asked = [actual_name(cells.columns, f.column) for f in spec.physical()]
    read = cells.columns if spec.star or not spec.fields else [c for c in dict.fromkeys(asked) if c]
    text = {c.name for c in cells.schema if isinstance(c.dataType, T.StringType)}
    return [(c, types.type_of(names.get(c.lower(), c))) for c in read if c in text]


__all__ = ["CELLS", "CheckedLoad", "FAULTY", "MISFIT", "UNREADABLE", "load_checked"]
