"""Readers, writers and model persistence."""
from quarry.sources.tables import TABLES, load, register  # noqa: F401
from quarry.sources.io import (read_csv, read_points, save_model, load_pipeline_model,  # noqa: F401,E402
                               submission, typed, write_csv, write_points)
