"""A PySpark engine for hybrid retrieval and question answering over noisy mixed-script text."""
