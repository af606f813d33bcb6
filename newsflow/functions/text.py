"""Text helpers for matching and display."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.clean import first_present


def search_text(title: Column, description: Column) -> Column:
    """Lower-cased title and description, joined by one blank."""
    return F.lower(
        F.concat(
            F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))
        )
    )


def needed_aliases(aliases: Sequence[str], decided: Sequence[str] = ()) -> list[str]:
    """Lower-cased aliases whose presence is not implied by another one.

    A text that contains "google" contains "goog", so only the shorter one has
    to be looked for. Aliases that contain one of ``decided`` go too.
    """
    lowered = list(dict.fromkeys(alias.lower() for alias in aliases))
    shorter = [*lowered, *decided]
    return [a for a in lowered if not any(b in a and b != a for b in shorter) and a not in decided]


def mentions(text: Column, aliases: Sequence[str], whole_words: bool = False) -> Column:
    """True where lower-cased ``text`` contains one of the aliases."""
    if whole_words:
        words = [rf"(?<![\p{{L}}\p{{N}}]){re.escape(a.lower())}(?![\p{{L}}\p{{N}}])" for a in aliases]
        hits = [text.rlike(word) for word in words]
    else:
        hits = [F.contains(text, F.lit(alias)) for alias in needed_aliases(aliases)]
    return reduce(or_, hits) if hits else F.lit(False)


def short_title(title: Column, length: int = 90) -> Column:
    """Title cut to ``length`` characters, with a stand-in when it is missing."""
    return F.substring(first_present(title, F.lit("Untitled")), 1, length)
