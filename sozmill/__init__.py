"""sozmill: speech-corpus curation and measurement expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
