"""Named queries over the driver tables and their ANSI-SQL equivalents."""
