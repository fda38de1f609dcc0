"""Missing-cell analytics on Spark: clean, detect, profile, sample, prepare and assemble."""
