"""juryframe: a Spark-first engine for comparing and combining competing experts."""
