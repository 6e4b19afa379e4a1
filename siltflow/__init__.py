"""siltflow: an analytics engine made of DataFrame-to-DataFrame operators on Spark."""
