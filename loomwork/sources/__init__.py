"""Tables: versioned stores of Parquet files, and external Parquet tables."""
