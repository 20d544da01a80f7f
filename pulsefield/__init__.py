"""pulsefield: spatiotemporal event analytics as Spark DataFrame operators."""
