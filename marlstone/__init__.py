"""marlstone: multi-source market analytics and corpus processing on PySpark."""
