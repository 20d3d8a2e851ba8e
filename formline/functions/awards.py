"""Award text: what to skip, how to name it, which class it belongs to."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Skipped descriptions, description fragment to class, display priority,
# classes that make up the "individual award other than MVP" category.
SKIPPED_AWARDS = [
    "Sporting News",
    "IBM Award",
    "Olympic Appearance",
    "NBA Sportsmanship",
    "J. Walter Kennedy Citizenship",
    "NBA Comeback Player of the Year",
]
AWARD_CLASSES = {
    "NBA Finals Most Valuable Player": "Finals MVP",
    "NBA All-Star Most Valuable Player": "All-Star MVP",
    "NBA Most Valuable Player": "MVP",
    "NBA Champion": "Champion",
    "All-Defensive Team": "All-Defensive",
    "All-Rookie Team": "All-Rookie",
    "All-NBA": "All-NBA",
    "Olympic Gold Medal": "Olympic Gold",
    "Olympic Silver Medal": "Olympic Silver",
    "Olympic Bronze Medal": "Olympic Bronze",
    "NBA Rookie of the Year": "ROY",
    "NBA Defensive Player of the Year": "DPOY",
    "NBA Sixth Man of the Year": "6MOY",
    "NBA Most Improved Player": "MIP",
    "NBA Coach of the Year": "COY",
    "NBA All-Star": "All-Star",
    "NBA Cup Most Valuable Player": "NBA Cup MVP",
    "NBA Cup All-Tournament Team": "NBA Cup Team",
    "NBA Cup Champion": "NBA Cup",
    "NBA Player of the Month": "POM",
    "NBA Player of the Week": "POW",
    "NBA Rookie of the Month": "ROM",
}
AWARD_PRIORITY = [
    "Champion", "NBA Cup", "MVP", "Finals MVP", "DPOY", "ROY", "6MOY", "MIP", "All-Star",
    "All-NBA", "All-Defensive", "All-Rookie", "Olympic Gold", "Olympic Silver",
    "Olympic Bronze", "All-Star MVP", "NBA Cup MVP", "NBA Cup Team", "POM", "POW", "ROM",
]
INDIVIDUAL_AWARDS = [
    "Finals MVP", "DPOY", "ROY", "6MOY", "MIP", "NBA Cup MVP", "All-NBA", "All-Defensive", "All-Rookie",
]


def is_skipped(description: Column) -> Column:
    return description.rlike("|".join(re.escape(text) for text in SKIPPED_AWARDS))


def award_name(description: Column, team_number: Column) -> Column:
    """Description, followed by ``1st/2nd/3rd Team`` where a team number is given."""
    number = F.trim(team_number.cast("string"))
    suffix = F.when(number == "1", "st").when(number == "2", "nd").when(number == "3", "rd")
    return F.coalesce(F.concat(description, F.lit(" "), number, suffix, F.lit(" Team")), description)


def award_class(description: Column, lowered: Column | None = None) -> Column:
    """MVP variants by context, then the longest fragment contained, then any All-Star, else Other.

    The text is tested many times: pass plain columns (and the lower-case text, if
    there is one), not computed expressions.
    """
    lowered = F.lower(description) if lowered is None else lowered
    mvp = description.contains("Most Valuable Player") | description.contains("MVP")
    variant = (
        F.when(description.contains("All-Star"), "All-Star MVP").when(description.contains("Finals"), "Finals MVP")
        .when(description.contains("NBA Cup"), "NBA Cup MVP").when(~description.contains("Cup"), "MVP")
    )
    by_fragment = None
    for fragment in sorted(AWARD_CLASSES, key=len, reverse=True):
        test = lowered.contains(fragment.lower())
        by_fragment = F.when(test, AWARD_CLASSES[fragment]) if by_fragment is None else by_fragment.when(test, AWARD_CLASSES[fragment])
    plain_all_star = lowered.contains("all-star") & ~lowered.contains("mvp") & ~lowered.contains("most valuable player")
    return F.coalesce(F.when(mvp, variant), by_fragment.when(plain_all_star, "All-Star").otherwise("Other"))


def award_priority(award_type: Column) -> Column:
    """Position in the display order; unlisted classes come last."""
    place = F.array_position(F.array(*[F.lit(a) for a in AWARD_PRIORITY]), award_type)
    return F.when(place > 0, place).otherwise(F.lit(len(AWARD_PRIORITY) + 1).cast("bigint"))
