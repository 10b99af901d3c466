"""A cube under care: its current version, saved roles and stored detections.

The store is a folder. Every change publishes the next numbered state record
(``state/00000001.json``, ...), which names the cube's files, the saved roles and the
stored detection table, if there is one. A state is whole or absent and its number is
given once, so readers see one state and two writers cannot both follow the same one.
Data files are never rewritten in place: a change writes new files and then publishes
the state that names them, so a job that reads the old version goes on reading it, and
one that dies on the way changes nothing.

What depends on the cube goes with it: coercing columns (P-04) writes a new version,
forgets saved roles and stored detections and infers the roles again; saving other roles
(V-09) forgets the stored detections. Staged selections (G-04) are a numbered log of
batches; each names the detections it was staged for, so a selection never outlives them.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ColumnRoles, ConflictError, CubeError, SchemaError, SchemaResult
from ..operators import detect as dt
from ..operators import profile as pf
from ..operators.policy import latest_selections
from ..sinks import records
from ..sinks import writers as wr
from ..sources.cube import coerce, read_cube, user_columns
from . import pipeline


@dataclass(frozen=True)
class State:
    """``number`` counts changes; ``event`` says what made this state."""

    number: int
    event: str
    cube: str
    roles: dict | None = None
    detections: str | None = None

    @property
    def saved_roles(self) -> ColumnRoles | None:
        return ColumnRoles(**self.roles) if self.roles else None


class CubeStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, cube: str) -> CubeStore:
        """Take the Parquet cube at ``cube`` under care; its files stay where they are."""
        store = cls(spark, root)
        read_cube(spark, cube)
        store._publish(State(1, "created", cube))
        return store

    # --- states ---------------------------------------------------------------------

    def _name(self, number: int) -> str:
        return f"{self.root}/state/{number:08d}.json"

    def history(self) -> list[State]:
        """All states, oldest first."""
        found = [records.read(self.spark, f"{self.root}/state/{n}") for n in
                 records.names(self.spark, f"{self.root}/state")]
        return [State(**r) for r in found if r]

    def state(self) -> State:
        last = records.names(self.spark, f"{self.root}/state")[-1:]
        record = records.read(self.spark, f"{self.root}/state/{last[0]}") if last else None
        if record is None:
            raise CubeError(f"There is no cube store at '{self.root}'.")
        return State(**record)

    def _publish(self, state: State) -> State:
        if not records.publish(self.spark, self._name(state.number), asdict(state)):
            raise ConflictError(f"The cube store at '{self.root}' was changed meanwhile.")
        return state

    def _follow(self, old: State, event: str, **changes) -> State:
        return self._publish(replace(old, number=old.number + 1, event=event, **changes))

    # --- the cube and its schema ------------------------------------------------------

    def read(self) -> DataFrame:
        return read_cube(self.spark, self.state().cube)

    def schema(self) -> SchemaResult:
        """V-22: findings for the saved roles, or for inferred ones if none are saved."""
        state = self.state()
        return pf.resolve_schema(read_cube(self.spark, state.cube), state.saved_roles)

    def save_roles(self, roles: ColumnRoles) -> SchemaResult:
        """V-09: check the roles and, if no check is hard, save them. Stored detections were
        made for other roles, so they are forgotten."""
        state = self.state()
        result = pf.validate_with_overrides(read_cube(self.spark, state.cube), roles)
        if result.ok:
            self._follow(state, "roles saved", roles=asdict(result.roles), detections=None)
        return result

    def coerce(self, columns: list[str]) -> SchemaResult:
        """P-04: a version of the cube in which ``columns`` are numbers (other text: missing).

        Saved roles and stored detections are of the old version and are forgotten; the
        result is inferred from the new one."""
        state = self.state()
        cube = read_cube(self.spark, state.cube)
        path = f"{self.root}/cube-{state.number + 1}-{uuid.uuid4().hex}"
        changed = coerce(cube, columns)
        wr.write_cleaned(changed.select(*[pf.q(c) for c in user_columns(changed)]), path)
        self._follow(state, "coerced", cube=path, roles=None, detections=None)
        return pf.infer_schema(read_cube(self.spark, path))

    # --- detections ---------------------------------------------------------------------

    def detections(self) -> DataFrame:
        """Stored detections of the current version and roles; made and stored if there are none."""
        state = self.state()
        if state.detections is None:
            result = self.schema()
            if not result.ok:
                raise SchemaError(result.hard_errors)
            path = f"{self.root}/detections-{state.number + 1}-{uuid.uuid4().hex}"
            wr.write_cleaned(dt.detect(read_cube(self.spark, state.cube), result.roles), path)
            state = self._follow(state, "detected", detections=path)
        return self.spark.read.parquet(state.detections)

    # --- staged selections (G-04) ---------------------------------------------------------

    def _log(self) -> list[dict]:
        """What was staged for the current detections since they were last cleared, oldest first."""
        folder, current = f"{self.root}/log", self.state().detections
        own = [r for n in records.names(self.spark, folder)
               if (r := records.read(self.spark, f"{folder}/{n}")) and r["detections"] == current]
        cleared = max((i for i, r in enumerate(own) if r["op"] == "clear"), default=-1)
        return own[cleared + 1:]

    def _append(self, op: str, events: DataFrame | None) -> None:
        """Write the events, then give them the next number in the log; a race only costs a try."""
        current, path = self.state().detections, None
        if current is None:
            raise CubeError("Detect before you stage: there are no stored detections.")
        if events is not None:
            path = f"{self.root}/events-{uuid.uuid4().hex}"
            wr.write_cleaned(events, path)
        number = len(records.names(self.spark, f"{self.root}/log")) + 1
        while not records.publish(self.spark, f"{self.root}/log/{number:08d}.json", {
                "number": number, "op": op, "detections": current, "events": path}):
            number += 1

    def stage(self, selections: DataFrame) -> None:
        """Stage ``selections(detection_id, fix[, attribution][, sel_ord])``; the last fix of a detection counts."""
        given = set(selections.columns)
        self._append("stage", selections.select(
            "detection_id", "fix",
            (F.col("attribution") if "attribution" in given else F.lit(None)).cast("string").alias("attribution"),
            (F.col("sel_ord") if "sel_ord" in given else F.lit(0)).cast("bigint").alias("sel_ord")))

    def unstage(self, detection_ids: DataFrame) -> None:
        self._append("unstage", detection_ids.select(
            "detection_id", F.lit(None).cast("string").alias("fix"), F.lit(None).cast("string").alias("attribution"),
            F.lit(0).cast("bigint").alias("sel_ord")))

    def clear(self) -> None:
        """Nothing that was staged so far counts any more."""
        self._append("clear", None)

    def selections(self) -> DataFrame:
        """Current selections, in the order they are applied in (batch, then ``sel_ord``)."""
        parts = [self.spark.read.parquet(r["events"]).withColumns({
            "op": F.lit(r["op"]), "sel_ord": F.col("sel_ord") + F.lit(r["number"] << 40)}) for r in self._log()]
        events = self.spark.createDataFrame(
            [], "detection_id string, fix string, attribution string, sel_ord bigint, op string")
        for part in parts:
            events = events.unionByName(part)
        return latest_selections(events)

    def apply(self, out_dir: str, **options) -> dict:
        """Apply the staged selections to the current version and commit both artifacts (S-07)."""
        return pipeline.clean_file(self.spark, self.state().cube, out_dir, roles=self.schema().roles, validate=False,
                                   detections=self.detections(), selections=self.selections(), **options)

    # --- upkeep -------------------------------------------------------------------------

    def vacuum(self) -> list[str]:
        """Delete versions, detections and staged events that the current state does not use.

        For times when no job reads an older version. Returns what was deleted."""
        state = self.state()
        used = [state.cube, state.detections, *[r["events"] for r in self._log()]]
        kept = {p.rsplit("/", 1)[-1] for p in used if p}
        fs, root, jvm = records.file_system(self.spark, self.root)
        gone = [n for n in records.names(self.spark, self.root)
                if n.startswith(("cube-", "detections-", "events-")) and n not in kept]
        for name in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, name), True)
        return gone
