"""Air-quality analytics on PySpark: cleaning, baselines, timelines, forest model and scoring."""
