from lumen.sources.tables import TABLES, table  # noqa: F401
