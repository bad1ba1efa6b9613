"""pitchflow: match-tracking analytics as Spark DataFrame plans."""
