"""A PySpark engine that selects, ranks and explains the files worth reading for a task."""

from __future__ import annotations


def get_context(spark, task, root=None, files=None, **options):
    """See lodestone.plans.context.get_context."""
    from .plans.context import get_context as run

    return run(spark, task, root, files, **options)
