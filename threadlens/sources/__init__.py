from .tables import TABLES, read_table  # noqa: F401
