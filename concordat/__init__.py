"""Filed-versus-observed verification as set-based Spark jobs."""
