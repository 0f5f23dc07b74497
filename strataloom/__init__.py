"""Analytics over project context graphs, task logs and evaluation runs, expressed as Spark DataFrames."""
