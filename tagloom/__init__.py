"""Point-name normalisation, vocabulary and labelling on Spark."""
