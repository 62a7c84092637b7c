"""Operators for training data at large scale, and the queries that apply them.

``queries()`` and ``oracle_sql()`` are what ``__spark_entry__.py`` adds to the
queries of the library when this subpackage is there.
"""

from __future__ import annotations


def queries():
    from glossarium.llm import registry

    return registry.queries()


def oracle_sql():
    from glossarium.llm import registry

    return registry.oracle_sql()
