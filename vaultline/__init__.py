"""vaultline: loading and governing historised warehouses with PySpark DataFrames."""
