"""ionlake: a Spark-first engine for mass-spectrometry style measurement tables."""
