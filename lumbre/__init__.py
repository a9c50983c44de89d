"""Log and event analytics on PySpark.

``plans`` turn raw lines and schemas into columns, ``operators`` query tables,
``streaming`` runs the same work on streams, ``sources`` reads and writes.
"""

from lumbre.session import build_session, configure, table

__all__ = ["build_session", "configure", "table"]
