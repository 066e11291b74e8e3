"""Column roles of edge tables, and the graph that the operators take."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ["edge_id", "from_id", "to_id", "d", "d_weighted", "time", "time_weighted", "from_x", "from_y", "to_x", "to_y", "component"]


#: The rows of ``Graph.standard`` that a route can take.
TRAVELLED = "w is not null and d is not null and not isnan(w) and not isnan(d) and from_id is not null and to_id is not null"


# The spellings under which tables of edges name their columns, lower case. An entry with a * stands for any rest of a name. The first
# entry with a match decides; what must match is that a table which other tools route on is understood without renaming.
FROM_NAMES = ["from_id", "from", "fr*", "*fr", "sta*", ".vx0*", "vx0*"]
TO_NAMES = ["to_id", "to", "to*", "*to", "sto*", ".vx1*", "vx1*"]
X_ENDINGS = ["*x", "*_x*", "*lon*"]
Y_ENDINGS = ["*y", "*_y*", "*lat*"]
DISTANCE_NAMES = ["d", "dist*"]
WEIGHT_NAMES = [["d_weighted", "w", "wt", "weight"], ["*weight*"], ["dw*", "d_w*"]]
TIME_NAMES = [["time"], ["*time"]]
TIME_WEIGHT_NAMES = [["time_weighted"], ["*time_w*", "*timew*", "*tw"]]
EDGE_NAMES = [["edge_id"], ["edge_"], ["*edge"]]
COMPONENT_NAMES = [["component"], ["*comp*"]]


def _like(name: str, entries: list[str]) -> bool:
    return any(fnmatchcase(name.lower(), e) for e in entries)


def _one(names: list[str], choices: list[list[str]], unlike: list[str] | None = None, what: str = "") -> str | None:
    """The one of ``names`` that is spelled like the first of ``choices`` with a match; several matches are an error for a column that is named by
    ``what``.
    """
    for entries in choices:
        hits = [n for n in names if _like(n, entries) and not _like(n, unlike or [])]
        if len(hits) == 1:
            return hits[0]
        if len(hits) > 1 and what:
            raise ValueError(f"unable to determine a unique {what} column of {hits}")
    return None


def _end_columns(names: list[str], entries: list[str]) -> tuple[str | None, str | None, str | None]:
    """The id, x and y columns of one end of the edges."""
    own = [n for n in names if _like(n, entries) and not n.lower().endswith("_z")]
    xs = [n for n in own if _like(n, X_ENDINGS) and not _like(n, ["*vx0", "*vx1"])]
    ys = [n for n in own if _like(n, Y_ENDINGS)]
    rest = [n for n in own if n not in xs and n not in ys]
    named = [n for n in rest if "id" in n.lower()] if len(rest) > 1 else rest
    both = bool(xs and ys)
    return (named or rest or [None])[0], xs[0] if both else None, ys[0] if both else None


def column_roles(names: list[str]) -> dict[str, str]:
    """Which of ``names`` plays which role: the ends of the edges first, then lengths and weights of what is left; ``d_weighted`` falls back to ``d``.
    """
    roles: dict[str, str | None] = {}
    for end, entries in (("from", FROM_NAMES), ("to", TO_NAMES)):
        roles[f"{end}_id"], roles[f"{end}_x"], roles[f"{end}_y"] = _end_columns(names, entries)
        if not roles[f"{end}_id"] and not roles[f"{end}_x"]:
            raise ValueError("unable to determine the columns of the ends of edges")
    used = {c for c in roles.values() if c}
    left = [n for n in names if n not in used]
    short = [n for n in left if n.startswith("d") and not _like(n, ["dz*", "dw*", "d_*", "de*", "du*"])]
    roles["d"] = _one(left, [[e] for e in DISTANCE_NAMES]) or (short[0] if len(short) == 1 else None)
    if roles["d"] is None:
        raise ValueError("unable to determine the distance column")
    left.remove(roles["d"])
    roles["d_weighted"] = _one(left, WEIGHT_NAMES, unlike=["*time*"]) or roles["d"]
    roles["time_weighted"], roles["time"] = _one(left, TIME_WEIGHT_NAMES), _one(left, TIME_NAMES)
    roles["edge_id"] = _one(left, EDGE_NAMES, what="edge id")
    roles["component"] = _one(left, COMPONENT_NAMES, what="component")
    return {k: v for k, v in roles.items() if v}


@dataclass(frozen=True)
class Graph:
    """A table of directed edges, one row each, and the roles of its columns. ``order``: the column that says which of equal edges comes first."""

    edges: DataFrame
    roles: dict[str, str]
    order: str | None = None
    attributes: dict = field(default_factory=dict)

    @classmethod
    def of(cls, edges: DataFrame, order: str | None = None, **attributes) -> Graph:
        roles = column_roles(edges.columns)
        if order is None:
            order = "ord" if "ord" in edges.columns else roles.get("edge_id")
        return cls(edges, roles, order, attributes)

    def __getitem__(self, role: str) -> Column:
        if role not in self.roles:
            if role in ("from_id", "to_id"):  # no ids: the coordinates name the vertex
                end = role[:-3]
                return F.concat_ws("-", F.format_number(self[f"{end}_x"], 10), F.format_number(self[f"{end}_y"], 10))
            raise ValueError(f"the graph has no column for {role}")
        return F.col(f"`{self.roles[role]}`")

    def has(self, role: str) -> bool:
        return role in self.roles

    @property
    def is_spatial(self) -> bool:
        return all(f"{e}_{a}" in self.roles for e in ("from", "to") for a in "xy")

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def standard(self, weight: str = "d_weighted", length: str = "d", extra: list[str] | None = None, whole: bool = False) -> DataFrame:
        """Only what a search needs: ``ord``, ``from_id``, ``to_id``, ``w``, ``d`` and ``extra``.

        Edges without a weight or length can't be travelled and are left out unless ``whole``; negative ones are an error at run time.
        """
        place = F.col(f"`{self.order}`") if self.order else F.monotonically_increasing_id()
        w, d = self[weight].cast("double"), self[length].cast("double")
        checked = lambda c: F.when(c < 0, F.raise_error(F.lit("negative weights are not allowed")).cast("double")).otherwise(c)
        out = self.edges.select(
            place.alias("ord"), self["from_id"].alias("from_id"), self["to_id"].alias("to_id"), checked(w).alias("w"), checked(d).alias("d"),
            *[F.col(f"`{c}`") for c in extra or []]
        )
        return out if whole else out.where(TRAVELLED)

    def require(self, role: str, message: str) -> None:
        if role not in self.roles:
            raise ValueError(message)
