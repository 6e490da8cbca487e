"""Operations for large training-data pipelines: filtering, de-duplication, packing, archives and search."""
