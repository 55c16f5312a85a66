"""crawlframe: corpus, link-graph and site-quality operators as Spark DataFrame functions."""
