"""Sources and sinks: the driver's tables, the panel loader, fixtures derived
from the driver tables, and Parquet / CSV / JSON / table sinks."""
