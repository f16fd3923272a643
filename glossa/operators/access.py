"""Who sees what: predicates to be applied at the scan, before any ranking or limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_access(level: Column, owner: Column, levels: Sequence[str] | None, user: str | None, personal_only: bool = False) -> Column:
    """An allowed level other than personal, or the user's own document, which ``personal_only`` is all of; ``None`` levels means open only, [] none."""
    allowed = [x for x in (["open"] if levels is None else levels) if x != "personal"]
    own = (owner == user) if user is not None else F.lit(False)
    if personal_only:
        return own
    return level.isin(allowed) | own if allowed else own


def work_access(level: Column, code: Column, levels: Sequence[str] | None) -> Column:
    """An allowed level or a level that names the work (``work:CODE``)."""
    given = ["open"] if levels is None else list(levels)
    named = [x.removeprefix("work:") for x in given if x.startswith("work:")]
    return level.isin([x for x in given if x not in ("personal",)]) | code.isin(named) if given else F.lit(False)
