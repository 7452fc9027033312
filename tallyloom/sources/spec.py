"""What a load says: its source, its fields, what is asked of the rows. Metadata only."""

from __future__ import annotations

from dataclasses import dataclass, field

from tallyloom.functions import fixed
from tallyloom.functions.measures import Measure


@dataclass(frozen=True)
class Source:
    """Where rows come from. ``kind`` follows from the path's extension when it is not given."""

    kind: str = ""
    path: str = ""
    options: dict = field(default_factory=dict)
    view: str = ""
    text: str = ""

    def resolved_kind(self) -> str:
        if self.kind:
            return self.kind
        suffix = self.path.rsplit(".", 1)[-1].strip().lower() if "." in self.path else ""
        return fixed.EXTENSION_KINDS.get(suffix, "unknown")


@dataclass(frozen=True)
class Field:
    """A field after loading: ``source`` is its column in the source, ``measure`` an aggregate."""

    name: str
    source: str = ""
    expression: str = ""
    is_derived: bool = False
    tags: tuple[str, ...] = ()
    measure: Measure | None = None

    @property
    def column(self) -> str:
        return self.source or self.name


@dataclass(frozen=True)
class LoadSpec:
    """One load. No fields means every column of the source, ``star`` every column and then the fields.

    ``unapplied_filter`` is a filter in the script's own language, which nothing here carries out.
    """

    name: str
    source: Source
    fields: tuple[Field, ...] = ()
    where: str = ""
    group_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    distinct: bool = False
    is_mapping: bool = False
    is_hidden: bool = False
    concatenate_to: str = ""
    star: bool = False
    unapplied_filter: str = ""

    def physical(self) -> list[Field]:
        """The fields that the source holds; all of them if every one is derived and none else asked for."""
        held = [f for f in self.fields if not f.is_derived]
        return held if held or self.star else list(self.fields)

    def dropped(self) -> list[Field]:
        """Derived fields that the load leaves out."""
        kept = self.physical()
        return [f for f in self.fields if f not in kept]


def spec_of(load) -> LoadSpec:
    """The spec of one parsed load, a row of ``operators.scripts.parse_loads``.

    The filter text is written in the script's own language; it is carried along for the reader to
    restate as ``where``, and the status of the load shows it.
    """
    fields = tuple(
        Field(f["field"], _bare(f["expression"]), f["expression"], f["is_derived"], tuple(f["tags"]))
        for f in load["fields"]
        if f["field"] != "*"
    )
    options = {o["key"]: True if o["value"] == "true" else o["value"] for o in load["options"]}
    source = Source(load["kind"], load["path"], options, load["resident"], load["inline_text"])
    return LoadSpec(
        load["table"], source, fields, distinct=load["is_distinct"], is_mapping=load["is_mapping"],
        is_hidden=load["is_hidden"], concatenate_to=load["target"],
        star=any(f["field"] == "*" for f in load["fields"]), unapplied_filter=load["filter"],
    )


def _bare(expression: str) -> str:
    text = expression.strip()
    wrapped = len(text) > 1 and (text[0], text[-1]) in (("[", "]"), ("'", "'"), ('"', '"'))
    return text[1:-1].strip() if wrapped else text


@dataclass(frozen=True)
class LoadStatus:
    """How a load went: ``connected``, or ``schema-only`` with the reason.

    The last four are known of checked loads only, once they have run: records of another form than theirs, the files that could
    not be read (the first ``NAMED`` of ``n_faulty`` by name), and per column the cells that do not fit its type.
    """

    NAMED = 1000

    table: str
    kind: str
    path: str
    status: str
    reason: str
    columns: tuple[str, ...]
    typed_columns: int
    dropped: tuple[tuple[str, str], ...]
    unapplied_filter: str = ""
    rejected_rows: int | None = None
    n_faulty: int | None = None
    faulty_files: tuple[str, ...] = ()
    misfits: tuple[tuple[str, int], ...] = ()
