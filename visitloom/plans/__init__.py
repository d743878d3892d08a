"""Complete jobs: the registered queries over the test tables."""
