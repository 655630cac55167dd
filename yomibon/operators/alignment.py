"""Where tokens stand in a text: by occurrence, by hints, and across two versions of a text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from ..functions.schema import LONGS
from ..functions.slices import by_row
from .offset_maps import aligned

#: Characters around a hint that are searched at least.
AROUND = 16
#: Characters before the cursor that a surface is looked for, besides its own length.
BACK = 8


def offset_mapper(source: str, target: str) -> Callable[[int], int]:
    """Offsets in target -> offsets in source: equal parts one to one, changed parts in proportion."""
    found = aligned(source, target)
    return lambda at: int(found.mapped(at))


def by_occurrence(text: str, surfaces: list[str]) -> list[int | None]:
    """Where each surface stands: the k-th token of a surface at its k-th occurrence; one beyond these behind the
    furthest token so far, else shortly before it, else nowhere."""
    following: dict[str, int] = {}
    found, cursor = [], 0
    for surface in (x.strip() for x in surfaces):
        at = text.find(surface, following.get(surface, 0)) if surface else -1
        if surface and at < 0:
            at = text.find(surface, cursor)
            if at < 0:
                at = text.find(surface, max(0, cursor - len(surface) - BACK), cursor)
        elif surface:
            following[surface] = at + len(surface)
        found.append(at if at >= 0 else None)
        cursor = max(cursor, at + len(surface)) if at >= 0 else cursor
    return found


def by_hint(text: str, readings: list[str], hints: list[int]) -> list[int | None]:
    """Where each reading stands: at its hint, around it, behind the one before, or anywhere; null if it is nowhere in the text."""
    found, cursor = [], 0
    for reading, hint in zip(readings, hints, strict=True):
        hint = max(0, min(hint, len(text)))
        around = max(len(reading), AROUND)
        places = (hint if text.startswith(reading, hint) else -1, text.find(reading, max(0, hint - around), hint + around + len(reading)), text.find(reading, cursor), text.find(reading))
        at = next((x for x in places if x >= 0), None) if reading else None
        found.append(at)
        cursor = cursor if at is None else at + len(reading)
    return found


@by_row(LONGS)
def occurrence_offsets(text: str | None, surfaces: list[str] | None) -> list | None:
    return None if text is None or surfaces is None else by_occurrence(text, surfaces)


@by_row(LONGS)
def hint_offsets(text: str | None, readings: list[str] | None, hints: list[int] | None) -> list | None:
    return None if text is None or readings is None else by_hint(text, readings, hints)


@F.pandas_udf(LONGS)
def mapped_offsets(sources: pd.Series, targets: pd.Series, offsets: pd.Series) -> pd.Series:
    """Offsets in a changed text -> those in the text it was made from."""

    def one(source, target, wanted):
        if source is None or target is None or wanted is None:
            return None
        return aligned(source, target).mapped(wanted).tolist()

    return pd.Series([one(*row) for row in zip(sources, targets, offsets, strict=True)])
