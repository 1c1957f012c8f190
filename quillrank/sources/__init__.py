from .tables import current_rows, read_table, stage_table

__all__ = ["current_rows", "read_table", "stage_table"]
