"""Where rows come from and where results go."""

from grainmill.sources.generators import constant_column, ramp, random_bits, random_ints, unique_ints
from grainmill.sources.results import append_csv, read_csv
from grainmill.sources.tables import TABLES, read_table

__all__ = ["TABLES", "append_csv", "constant_column", "ramp", "random_bits", "random_ints", "read_csv", "read_table", "unique_ints"]
