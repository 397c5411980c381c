"""Training-data operators: ten numbered operators, their queries and the corpus pipeline's stages."""
