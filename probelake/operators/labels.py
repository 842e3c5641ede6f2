"""Targets of the probing tasks from (correct, real_object)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TASKS = (-1, 0, 1, 2, 3)


def task_target(task: int, correct: Column, real: Column) -> Column:
    """0 true against all, 1 false against all, 2 neither against all, 3 true against false; -1 three classes (1 true, 0 false, 2 neither). Nulls give null where the rule reads them."""
    if task == 0:
        return correct.cast("int")
    if task == 1:
        return ((correct == 0) & (real == 1)).cast("int")
    if task == 2:
        return (real == 0).cast("int")
    if task == 3:
        return ((correct == 1) & (real == 1)).cast("int")
    if task == -1:
        return F.when(real == 0, 2).when(correct == 1, 1).when(correct == 0, 0)
    raise ValueError(f"task must be one of {TASKS}, not {task}")


def task_mask(task: int, real: Column) -> Column:
    """Rows the task trains and tests on."""
    if task not in TASKS:
        raise ValueError(f"task must be one of {TASKS}, not {task}")
    return real == 1 if task == 3 else F.lit(True)


def true_and_real(correct: Column, real: Column) -> Column:
    """Task 0 without its shortcut over generated data: correct and real."""
    return ((correct == 1) & (real == 1)).cast("int")


def combined_label(correct: Column, real: Column, fake: Column, fictional: Column) -> Column:
    """0 real and incorrect, 1 real and correct, 4 fake only, 2 incorrect fake or fictional, 3 correct fake or fictional, else 4; the first that holds."""
    made_up = (fake == 1) | (fictional == 1)
    return (
        F.when((real == 1) & (correct == 0), 0)
        .when((real == 1) & (correct == 1), 1)
        .when((fake == 1) & (real == 0) & (fictional == 0), 4)
        .when((correct == 0) & made_up, 2)
        .when((correct == 1) & made_up, 3)
        .otherwise(4)
    )


def signed(y: Column) -> Column:
    """0 and 1 as -1 and 1."""
    return F.when(y == 0, -1).otherwise(1)


def check_binary(*labels: Column) -> Column:
    """Raises for a row whose labels are other than 0, 1 and null; else null."""
    fine = F.lit(True)
    for y in labels:
        fine = fine & F.coalesce(y.isin(0, 1), F.lit(True))
    return F.assert_true(fine, F.lit("labels must be 0 or 1"))
