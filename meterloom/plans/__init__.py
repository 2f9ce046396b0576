"""The registered queries: ``queries.Q`` and ``queries.SQL``, which the other modules add to."""

from . import queries, more, injection  # noqa: F401, I001
