"""granary: DataFrame-first analytics over mainframe source repositories and text corpora."""
