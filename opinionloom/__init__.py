"""Review analytics as Spark jobs: text shaping, sentiment, aspects, emotion, sarcasm,
fusion, feedback and reporting, all as DataFrame -> DataFrame functions."""
