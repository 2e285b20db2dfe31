from .catalog import Catalog  # noqa: F401
from .delimited import load_dataset, read_schema, read_table, compile_dataset, write_dataset  # noqa: F401
