"""Parsing, splitting, prompting, grading and comparing question-answering data on Spark."""
