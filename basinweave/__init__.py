"""basinweave: a Spark-first engine for source-grounded knowledge graphs and the corpora behind them."""

__version__ = "0.1.0"
