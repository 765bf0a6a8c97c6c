"""DataFrame -> DataFrame building blocks shared by the table jobs."""
