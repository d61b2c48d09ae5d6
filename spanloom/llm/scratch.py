"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

from ..operators.tables import drop, dropped, new_folder
from ..operators.tables import stored as written

__all__ = ["drop", "dropped", "new_folder", "written"]
