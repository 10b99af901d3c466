"""Shared vocabulary: detector and fix names, column roles, schema result, errors.

Column names are metadata, so roles and schema findings live on the driver as
small dataclasses. Everything that touches cell values is a Spark Column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (must equal the reference's for identical results) --------
# Detector names, in the order detections are merged and listed.
NEGATIVE = "negative"
REFUND = "refund"
DOUBLE_BOOKING = "double_booking"
OUTLIER = "outlier"
DETECTORS = (NEGATIVE, REFUND, DOUBLE_BOOKING, OUTLIER)

# Fix names, in priority order (first wins when several are offered).
SET_TO_ZERO = "set_to_zero"
SPLIT_EVENLY = "split_evenly"
KEEP_AS_IS = "keep_as_is"
FIX_PRIORITY = (SET_TO_ZERO, SPLIT_EVENLY, KEEP_AS_IS)

# Detector a change is credited to when the selection names none:
# first detector of the list that flagged the cell.
FIX_ATTRIBUTION = {
    SET_TO_ZERO: (REFUND, NEGATIVE, OUTLIER),
    SPLIT_EVENLY: (DOUBLE_BOOKING,),
    KEEP_AS_IS: (OUTLIER, NEGATIVE, REFUND, DOUBLE_BOOKING),
}

# First action of each detector, used when staging from a detector's context.
DETECTOR_ACTION = {
    NEGATIVE: SET_TO_ZERO,
    REFUND: SET_TO_ZERO,
    DOUBLE_BOOKING: SPLIT_EVENLY,
    OUTLIER: KEEP_AS_IS,
}

PRIMARY = "primary"
REFUND_CASCADE = "refund_cascade"
DETECTIONS_FORMAT_VERSION = "v2"
# -----------------------------------------------------------------------------

# Internal column names added to a prepared cube. They are told apart from user
# columns by this list alone (never by a prefix); a cube that uses one of them is
# refused by the source, so no user column is ever taken for an internal one.
CELLS = "__cells"
ROW_ID = "__row_id"
ROW_INDEX = "__row_index"
FILE_PATH = "__file_path"
KEY = "__row_key"
FLAGS = "__flags"
ACTIONS = "__actions"
APPLIED = "__applied"
INTERNAL = frozenset({CELLS, ROW_ID, ROW_INDEX, FILE_PATH, KEY, FLAGS, ACTIONS, APPLIED})


@dataclass
class ColumnRoles:
    id_columns: list[str] = field(default_factory=list)
    time_columns: list[str] = field(default_factory=list)
    measure_columns: list[str] = field(default_factory=list)

    def is_empty(self) -> bool:
        return not (self.id_columns or self.time_columns or self.measure_columns)


@dataclass
class SchemaResult:
    roles: ColumnRoles
    hard_errors: list[str] = field(default_factory=list)
    soft_warnings: list[str] = field(default_factory=list)
    time_format: str | None = None
    coercible_columns: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.hard_errors


class CubeError(ValueError):
    """Base class for user-facing errors of this library."""


class SchemaError(CubeError):
    """Hard schema errors block detection and apply."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


class DuplicateColumnsError(CubeError):
    def __init__(self, duplicates: list[str]):
        names = ", ".join(f"'{n}'" for n in duplicates)
        super().__init__(
            f"The cube has more than one column named {names}; every column needs a name of its own."
        )
        self.duplicates = duplicates


class UnreadableInputError(CubeError):
    pass


class EmptyInputError(CubeError):
    pass


class ReservedNameError(CubeError):
    """The cube has a column under a name that this library needs for itself."""


class InvalidSelectionError(CubeError):
    """A selection names an unknown detection or a fix the detection does not allow."""


class AlreadyCleanedError(CubeError):
    pass


class ConflictError(CubeError):
    """Another writer changed the store between reading its state and publishing the next."""
