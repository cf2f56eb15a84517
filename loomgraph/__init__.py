"""Knowledge-graph, retrieval and corpus analytics as Spark DataFrame jobs."""
