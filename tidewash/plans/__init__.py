from .lineage import Event, lineage_table
from .rules import CleaningRules
from .run import CleaningResult, clean_csv, clean_table, write_outputs
from .steps import apply_steps, parse_steps, run_steps

__all__ = [
    "CleaningResult", "CleaningRules", "Event", "apply_steps", "clean_csv", "clean_table", "lineage_table", "parse_steps", "run_steps",
    "write_outputs",
]
