"""Where the keys of the 44-number action space lie in the raw columns of a two-armed recording."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTION, STATE = "action", "observation.state"

# Section, key, start, end, raw column. The raw widths and places are those of the recordings.
SLICES = (
    ("state", "left_pose", 0, 7, ACTION),
    ("state", "left_gripper", 10, 11, ACTION),
    ("state", "right_pose", 13, 20, ACTION),
    ("state", "right_gripper", 23, 24, ACTION),
    ("state", "electroSurgeryMode_left", 14, 15, STATE),
    ("state", "armlinkedtohaptic_left", 20, 21, STATE),
    ("state", "instrtype_left", 22, 23, STATE),
    ("state", "electroSurgeryMode_right", 15, 16, STATE),
    ("state", "armlinkedtohaptic_right", 21, 22, STATE),
    ("state", "instrtype_right", 23, 24, STATE),
    ("state", "translation_scaling", 12, 13, STATE),
    ("state", "rotation_scaling", 13, 14, STATE),
    ("state", "hapticengaged_left", 16, 17, STATE),
    ("state", "hapticengaged_right", 17, 18, STATE),
    ("state", "arm_0_color", 2, 3, STATE),
    ("state", "arm_1_color", 3, 4, STATE),
    ("state", "arm_2_color", 4, 5, STATE),
    ("state", "arm_3_color", 5, 6, STATE),
    ("action", "left_pose", 0, 7, ACTION),
    ("action", "left_gripper", 10, 11, ACTION),
    ("action", "right_pose", 13, 20, ACTION),
    ("action", "right_gripper", 23, 24, ACTION),
    ("action", "left_energy", 8, 9, ACTION),
    ("action", "right_energy", 21, 22, ACTION),
    ("action", "thumbstick_x_left", 11, 12, ACTION),
    ("action", "thumbstick_y_left", 12, 13, ACTION),
    ("action", "thumbstickBtn_left", 9, 10, ACTION),
    ("action", "thumbstick_x_right", 24, 25, ACTION),
    ("action", "thumbstick_y_right", 25, 26, ACTION),
    ("action", "thumbstickBtn_right", 22, 23, ACTION),
    ("action", "clutchBtn_left", 7, 8, ACTION),
    ("action", "clutchBtn_right", 20, 21, ACTION),
    ("action", "hapticengaged_left", 16, 17, STATE),
    ("action", "hapticengaged_right", 17, 18, STATE),
    ("action", "cond_hapticengaged_left", 16, 17, STATE),
    ("action", "cond_hapticengaged_right", 17, 18, STATE),
    ("action", "cond_armlinkedtohaptic_left", 20, 21, STATE),
    ("action", "cond_armlinkedtohaptic_right", 21, 22, STATE),
    ("action", "cond_arm_0_instrtype", 7, 8, STATE),
    ("action", "cond_arm_1_instrtype", 8, 9, STATE),
    ("action", "cond_arm_2_instrtype", 9, 10, STATE),
    ("action", "cond_arm_3_instrtype", 10, 11, STATE),
    ("action", "cond_arm_0_color", 2, 3, STATE),
    ("action", "cond_arm_1_color", 3, 4, STATE),
    ("action", "cond_arm_2_color", 4, 5, STATE),
    ("action", "cond_arm_3_color", 5, 6, STATE),
    ("action", "cond_electroSurgeryMode_left", 14, 15, STATE),
    ("action", "cond_electroSurgeryMode_right", 15, 16, STATE),
)


def table(spark: SparkSession) -> DataFrame:
    """section, key, start, end, column."""
    return spark.createDataFrame(list(SLICES), "section string, key string, start int, end int, column string")


def too_narrow(widths: dict[str, int]) -> list[str]:
    """The raw columns that are not as wide as the slices need, or missing."""
    need: dict[str, int] = {}
    for _, _, _, end, column in SLICES:
        need[column] = max(need.get(column, 0), end)
    return sorted(c for c, n in need.items() if widths.get(c, 0) < n)


def modality_json(widths: dict[str, int], force: bool = False) -> str:
    """The slices as a modality file. Raw columns that are too narrow are an error, unless forced. The raw column is named
    where it is not the section's own (``action`` for actions); every state slice names its own."""
    bad = too_narrow(widths)
    if bad and not force:
        raise ValueError(f"too narrow for the slices: {', '.join(bad)}")
    out: dict[str, dict] = {"state": {}, "action": {}}
    for section, name, start, end, column in SLICES:
        out[section][name] = {"start": start, "end": end, **({} if section == column else {"original_key": column})}
    return json.dumps(out)


def columns(section: str) -> dict[str, Column]:
    """section.key to its part of the raw column, for select or withColumns: one projection over two raw columns."""
    return {f"{s}.{k}": F.slice(F.col(f"`{c}`"), a + 1, b - a) for s, k, a, b, c in SLICES if s == section}
