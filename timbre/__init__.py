"""timbre: speaker-voice (stylometry) analytics on Spark DataFrames."""
