"""Where catalogs come from."""
