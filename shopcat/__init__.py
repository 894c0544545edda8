"""Shop-page catalog on Spark: pages in, merged books and dated offers out."""
