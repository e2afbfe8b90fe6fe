from .writers import (
    cut_cells,
    iso_timestamps,
    json_safe,
    spreadsheet_safe,
    write_csv,
    write_json,
    write_parquet,
)

__all__ = ["cut_cells", "iso_timestamps", "json_safe", "spreadsheet_safe", "write_csv", "write_json", "write_parquet"]
