"""Operations of large-scale training-data pipelines, as Spark jobs."""
