"""millrace: moving, reshaping, reconciling and translating tabular data as Spark jobs."""
