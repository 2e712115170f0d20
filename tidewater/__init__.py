"""Time-series analytics as PySpark DataFrame operators: features, cleaning, forecasting, detection, reconciliation."""
