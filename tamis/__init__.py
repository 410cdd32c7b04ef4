"""tamis: verifiable allocation analytics and corpus preparation on PySpark."""
