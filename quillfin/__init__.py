"""quillfin: order-book and event time-series analytics as Spark plans."""
