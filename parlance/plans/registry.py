"""All registered jobs and their oracle SQL."""

from __future__ import annotations

from parlance.plans import context_jobs, jobs, models  # noqa: F401  (they register their jobs)


def all_jobs():
    return dict(jobs.JOBS)


def all_sql():
    return dict(jobs.SQL)
