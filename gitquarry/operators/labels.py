"""Flag bug-fixing commits, optionally only those of matching projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitquarry.functions.text import BUGFIX_PATTERN, is_bugfix


def restrict_to_projects(commits: DataFrame, projects: DataFrame, vcs_systems: DataFrame,
                         project_like: str) -> DataFrame:
    """Keep commits whose VCS system belongs to a project whose name
    matches the LIKE pattern (wildcards active).

    The reference chains inner joins and keeps only commit columns; with
    unique ids that is a semi-join, which never duplicates a commit and lets
    AQE broadcast the (small, runtime-measured) project side.
    """
    project_ids = projects.filter(F.col("name").like(project_like)) \
        .select(F.col("_id").alias("project_id"))
    vcs_ids = vcs_systems.join(project_ids, "project_id", "left_semi") \
        .select(F.col("_id").alias("vcs_id"))
    return commits.join(vcs_ids, commits["vcs_system_id"] == vcs_ids["vcs_id"], "left_semi")


def label_bugfix(commits: DataFrame, pattern: str = BUGFIX_PATTERN,
                 projects: DataFrame | None = None, vcs_systems: DataFrame | None = None,
                 project_like: str | None = None, out_col: str = "bugfix") -> DataFrame:
    """Commits with a boolean ``bugfix`` column (null for a null message).

    Output columns: ``_id, vcs_system_id, message, bugfix``.
    """
    c = commits.select("_id", "vcs_system_id", "message")
    if project_like is not None:
        if projects is None or vcs_systems is None:
            raise ValueError("project_like needs projects and vcs_systems")
        c = restrict_to_projects(c, projects, vcs_systems, project_like)
    return c.withColumn(out_col, is_bugfix("message", pattern))
