"""granary: data preparation and analysis operators expressed as Spark plans."""
