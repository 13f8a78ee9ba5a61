"""Panel analytics, demand forecasting and training-data preparation on PySpark."""
