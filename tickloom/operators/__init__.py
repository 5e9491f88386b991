"""Building blocks of the ingest job, each a DataFrame in and a DataFrame out."""
