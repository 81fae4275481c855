"""haggle: offer-negotiation analytics as Spark jobs."""
