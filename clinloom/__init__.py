"""clinloom: a Spark-first engine for dialogue-corpus cohort and evaluation analytics."""
