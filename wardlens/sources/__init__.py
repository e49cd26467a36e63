from wardlens.sources.tables import (  # noqa: F401
    SCHEMAS, read_table, read_parts, union_parts, write_table, read_json_map,
)
