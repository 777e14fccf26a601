"""caravel: analytics over question-answer corpora and evaluation runs, on Spark DataFrames."""
