"""Point-in-time panel research on Spark: tables in, tables out."""
