"""Column functions: text metrics, Markdown, cost and requests. All run inside Spark's expressions."""
