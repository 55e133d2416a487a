"""Text columns: scripts, ids from paths, formatted lines. Built-in expressions only.

Java's ``trim`` cuts every character up to U+0020 while Spark's ``trim`` cuts blanks, so
the characters to cut are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schemas import UP

# Patterns and texts that make results comparable.
STATEMENT_END = r";\s*?(--[^\n]*)?\r?\n"
ANSI_ESCAPE = r"\x1b\[[0-9;]*m"
DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
MARKER_DONE, MARKER_OPEN = "[✓]", "[ ]"
TAG_OK, TAG_SKIP, TAG_FAIL = "[OK]   ", "[SKIP] ", "[FAIL] "
NOTHING_DONE = "No migrations executed. All migrations are up to date."
ONE, MANY = " migration", " migrations"
WILL_BE, WOULD_BE = " will be ", " would be "
FORWARD, BACK = "executed.", "rolled back."
FORWARD_DONE = "Migration completed successfully. "
BACK_DONE = "Rollback completed successfully. "
OUTSIDE_TASKS = "Task file must be under tasks/ directory: "
# Every character that trimming cuts: U+0000 to U+0020.
BLANKS = "".join(map(chr, range(0x21)))


def _trimmed(value: Column) -> Column:
    return F.trim(value, F.lit(BLANKS))


def statements(script: Column) -> Column:
    """Array of the statements of a script, in order."""

    def clean(part: Column) -> Column:
        cut = _trimmed(part)
        return F.when(
            cut.endswith(";"), _trimmed(F.substring(cut, F.lit(1), F.length(cut) - 1))
        ).otherwise(cut)

    parts = F.transform(F.split(script, STATEMENT_END, -1), clean)
    return F.filter(parts, lambda part: part != "")


def split_statements(scripts: DataFrame, script: str = "script") -> DataFrame:
    """One row per statement: the other columns, ``statement_no`` from 1, ``statement``."""
    others = [c for c in scripts.columns if c != script]
    return scripts.select(*others, F.posexplode(statements(F.col(script)))).select(
        *others,
        (F.col("pos") + 1).alias("statement_no"),
        F.col("col").alias("statement"),
    )


def number_lines(scripts: DataFrame, script: str = "script") -> DataFrame:
    """One row per line, trailing empty lines included: ``line_no``, ``line``.

    ``line`` is the number padded to three places (wider numbers stay whole), a bar and
    the text.
    """
    others = [c for c in scripts.columns if c != script]
    number = F.col("line_no").cast("string")
    padded = F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit(" "))
    return (
        scripts.select(*others, F.posexplode(F.split(F.col(script), "\n", -1)))
        .select(*others, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("text"))
        .select(
            *others,
            "line_no",
            F.concat(F.lit("  "), padded, F.lit(" | "), F.col("text")).alias("line"),
        )
    )


def format_duration(ms: Column) -> Column:
    """Milliseconds below one second, else seconds with one decimal (half up)."""
    return F.when(
        ms >= 1000, F.format_string("%.1fs", ms.cast("double") / F.lit(1000.0))
    ).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def format_datetime(moment: Column) -> Column:
    """Date and time to the second, in the session's zone."""
    return F.date_format(moment, DATETIME_FORMAT)


def status_marker(executed: Column) -> Column:
    return F.when(executed, MARKER_DONE).otherwise(MARKER_OPEN)


def outcome_tag(outcome: Column) -> Column:
    """Tag of a node that was visited; null for one that was not reached."""
    return F.when(outcome == "OK", TAG_OK).when(outcome == "SKIP", TAG_SKIP).when(
        outcome == "FAIL", TAG_FAIL
    )


def status_line(
    executed: Column, node_id: Column, name: Column, duration_ms: Column, executed_at: Column
) -> Column:
    """Marker, id and name; an executed node also shows how long it took and when."""
    when_done = F.concat(
        F.lit(" ("),
        format_duration(duration_ms),
        F.lit(", "),
        format_datetime(executed_at),
        F.lit(")"),
    )
    return F.concat(
        status_marker(executed),
        F.lit(" "),
        node_id.cast("string"),
        F.lit(" - "),
        name,
        F.when(executed, F.coalesce(when_done, F.lit(""))).otherwise(""),
    )


def result_line(
    outcome: Column, node_id: Column, name: Column, duration_ms: Column, reason: Column
) -> Column:
    """Tag, id and name, then the time of a success or the reason of a skip."""
    took = F.when(outcome == "OK", F.concat(F.lit(" ("), duration_ms.cast("string"), F.lit("ms)")))
    why = F.when(outcome == "SKIP", F.concat(F.lit(" ("), reason, F.lit(")")))
    return F.concat(
        outcome_tag(outcome),
        F.lit(" "),
        node_id.cast("string"),
        F.lit(" - "),
        name,
        F.coalesce(took, F.lit("")),
        F.coalesce(why, F.lit("")),
    )


def _counted(total: Column) -> Column:
    return F.concat(total.cast("string"), F.when(total == 1, ONE).otherwise(MANY))


def count_message(total: Column, direction: str = "UP", dry_run: bool = False) -> Column:
    """How many nodes a run is about to touch (or would touch)."""
    verb = WOULD_BE if dry_run else WILL_BE
    return F.concat(_counted(total), F.lit(verb + (FORWARD if direction == UP else BACK)))


def completion_message(direction: Column, executed: Column, success: Column) -> Column:
    """Closing sentence of a successful run; null for a failed one."""
    up = direction == UP
    done = F.concat(
        F.when(up, FORWARD_DONE).otherwise(BACK_DONE),
        _counted(executed),
        F.lit(" "),
        F.when(up, FORWARD).otherwise(BACK),
    )
    return F.when(success, F.when(executed == 0, NOTHING_DONE).otherwise(done))


def task_id_from_path(path: Column, root: str = "") -> Column:
    """Path below ``<root>/tasks/`` without ``.yaml``; any other path raises."""
    base = f"{root.rstrip('/')}/tasks/"
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.substring(slashed, F.lit(len(base) + 1), F.length(slashed))
    return F.when(slashed.startswith(base), F.regexp_replace(below, r"\.yaml$", "")).otherwise(
        F.raise_error(F.concat(F.lit(OUTSIDE_TASKS), path))
    )


def target_id_from_path(path: Column) -> Column:
    """File name without ``.yaml``."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.yaml$", "")


def strip_ansi(value: Column) -> Column:
    """Text without colour escapes."""
    return F.regexp_replace(value, ANSI_ESCAPE, "")
