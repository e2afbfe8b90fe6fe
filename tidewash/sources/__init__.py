from .csv import CsvTable, LoadError, read_csv
from .specs import list_specs, load_spec, parse_specs
from .tables import read_table, stage_table

__all__ = ["CsvTable", "LoadError", "list_specs", "load_spec", "parse_specs", "read_csv", "read_table", "stage_table"]
