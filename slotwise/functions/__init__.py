"""Column-level helpers: everything here returns a ``Column`` built from Spark built-ins."""
