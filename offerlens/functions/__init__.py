"""Column-level building blocks: no DataFrame in or out, no shuffle."""
