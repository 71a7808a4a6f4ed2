from stayrate.sources.checkpoints import materialise, scratch_path
from stayrate.sources.tables import (
    ARTICLES,
    CUSTOMERS,
    SCHEMAS,
    TRANSACTIONS,
    export_csv,
    read_tables,
)
from stayrate.sources.warehouse import retail_tables

__all__ = [
    "ARTICLES",
    "CUSTOMERS",
    "SCHEMAS",
    "TRANSACTIONS",
    "export_csv",
    "materialise",
    "read_tables",
    "retail_tables",
    "scratch_path",
]
